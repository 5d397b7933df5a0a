"""The extraction rules text by text, to compare with."""

from __future__ import annotations

from collections.abc import Iterator

from pairlens.functions.extract import (
    _AFTER_WORD,
    _BEFORE_UNIT,
    _COMPARISON,
    _CURRENCY,
    _MULTIPLES,
    _NEGATION,
    _ORDINAL_UNITS,
    _ORDINAL_WORDS,
    _PERCENT,
    _SIGNS,
    _UNIT,
    _YEAR,
    NOT_NAMES,
    PROPER_NAMES,
    PROPER_NAMES_NARROW,
    VERSUS,
)


def _number(text: str) -> tuple[float, str, bool] | None:
    """(value, its digits, multiplied or not) of a number with thousands marks and a k or m behind."""
    digits = text.strip("$%").replace(",", "")
    times = _MULTIPLES.get(digits[-1:].lower(), 1)
    digits = digits[:-1] if times > 1 else digits
    try:
        return float(digits) * times, digits, times > 1
    except ValueError:
        return None


def _context(text: str, at: int) -> dict:
    near = _COMPARISON.search(text[max(0, at - 30) : at + 50].lower())
    negated = bool(_NEGATION.search(text[max(0, at - 50) : at].lower()))
    return {
        "comparison": _SIGNS.get(near[1], near[1]) if near else ">=",
        "is_negated": negated,
        "negation_context": text[max(0, at - 100) : at + 50].strip() if negated else None,
    }


def _unit_at(text: str, at: int) -> str:
    found = _UNIT.search(text[at : at + 80].lower())
    return found[1].rstrip("s") if found else "numeric"


def _readings(text: str) -> Iterator[tuple[int, float, str]]:
    """(position, value, unit) of every threshold, pass by pass."""
    for pattern, unit in ((_CURRENCY, "dollars"), (_PERCENT, "percentage")):
        for m in pattern.finditer(text):
            if read := _number(m[0]):
                yield m.start(), read[0], unit
    for pattern in (_AFTER_WORD, _BEFORE_UNIT):
        for m in pattern.finditer(text):
            read = _number(m[1])
            if read is None or (not read[2] and _YEAR.match(read[1].split(".")[0])):
                continue
            unit = _unit_at(text, m.start())
            behind = text[m.end() : m.end() + 20].lower()
            if pattern is _BEFORE_UNIT and unit in _ORDINAL_UNITS and any(w in behind for w in _ORDINAL_WORDS):
                continue  # "Game 3 Winner" numbers a game
            yield m.start(), read[0], unit


def thresholds_of(text: str) -> list[dict]:
    """Thresholds in order of discovery; the first of a value and unit counts."""
    found: dict[tuple[float, str], dict] = {}
    for at, value, unit in _readings(text):
        if (value, unit) not in found:
            found[value, unit] = {"value": value, "unit": unit, **_context(text, at)}
    return list(found.values())


def names_of(text: str, narrow: bool = False) -> list[dict]:
    """Proper names, then the sides of "X vs Y"; the first spelling counts."""
    hits = [(m[1].strip(), True) for m in (PROPER_NAMES_NARROW if narrow else PROPER_NAMES).finditer(text)]
    hits += [(side.strip(), False) for m in VERSUS.finditer(text) for side in m.groups()]
    found: dict[str, dict] = {}
    for name, proper in hits:
        if len(name) >= 3 and name.lower() not in NOT_NAMES and name not in found:
            kind = "person" if proper and 2 <= len(name.split()) <= 4 else "other"
            found[name] = {"name": name, "entity_type": kind, "aliases": []}
    return list(found.values())
