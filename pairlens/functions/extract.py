"""Rule-based extraction from contract texts.

Thresholds need the text around a match: positions come from :mod:`pairlens.functions.scan`, so all rules are
column expressions.  Each distinct text should be extracted once: see
:func:`pairlens.plans.matching.extracted`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions import scan
from pairlens.schemas import ENTITY, THRESHOLD

# Patterns and word lists of the rules.
_NUMBER = r"[\d,]+(?:\.\d+)?"
_CURRENCY = re.compile(rf"\${_NUMBER}(?:k|K|m|M)?")
_PERCENT = re.compile(rf"{_NUMBER}%")
_AFTER_WORD = re.compile(
    r"(?:above|below|over|under|exceed(?:s|ing)?|reach(?:es|ing)?|hit(?:s|ting)?|at\s+least|at\s+most|more\s+than|less\s+than|greater\s+than|fewer\s+than)"
    rf"\s+({_NUMBER}(?:k|K|m|M)?)",
    re.IGNORECASE,
)
_UNITS = (
    r"(?:points?|goals?|yards?|runs?|games?|wins?|losses?|seats?|degrees?|cents?|bps|basis\s+points?|rebounds?|assists?|"
    r"touchdowns?|strikeouts?|sacks?|interceptions?|aces?|kills?|blocks?)"
)
_BEFORE_UNIT = re.compile(rf"({_NUMBER})\s+{_UNITS}", re.IGNORECASE)
_UNIT = re.compile(rf"[\d,.]+[kKmM]?\s+({_UNITS})", re.IGNORECASE)
_YEAR = re.compile(r"^(?:19|20)\d{2}$")
_COMPARISON = re.compile(r"(above|below|at least|at most|exactly|>|<|>=|<=)")
_SIGNS = {"above": ">", "below": "<", "at least": ">=", "at most": "<=", "exactly": "=="}
_NEGATION = re.compile(
    r"not\s+(?:to\s+)?exceed|not\s+(?:to\s+)?(?:go\s+)?above|not\s+(?:to\s+)?(?:go\s+)?below|"
    r"unless\s+(?:it\s+)?(?:is\s+)?(?:above|below|exceeds?)|except\s+(?:if|when|where)|no\s+more\s+than|less\s+than"
)
_ORDINAL_UNITS = ("game", "games", "map", "maps", "match", "matches", "win", "wins")
_ORDINAL_WORDS = ("winner", "loser", "victor", "champion", "result", "outcome", "ner", "ser")
_MULTIPLES = {"k": 1_000, "m": 1_000_000}

#: Two or more capitalised words, with particles and suffixes between and behind.
PROPER_NAMES = re.compile(
    r"\b([A-Z][a-z]+(?:-[A-Z][a-z]+)*(?:\s+(?:(?:de|von|van|al|el|bin|of|the|and|del|di|la|le)\s+)?[A-Z][a-z]+(?:-[A-Z][a-z]+)*)+(?:\s+(?:Jr|Sr|II|III|IV)\.?)?)(?!\w)"
)
#: The narrower form: adjacent capitals need a particle between them or none at all.
PROPER_NAMES_NARROW = re.compile(
    r"\b([A-Z][a-z]+(?:\s+(?:de|von|van|al|el|bin|of|the|and|del|di|la|le)\s+)?(?:[A-Z][a-z]+(?:-[A-Z][a-z]+)*)(?:\s+(?:Jr|Sr|II|III|IV)\.?)?)\b"
)
VERSUS = re.compile(r"([A-Z][A-Za-z\s]+?)\s+(?:vs?\.?|versus)\s+([A-Z][A-Za-z\s]+?)(?:\s|,|\.|$)", re.IGNORECASE)
NOT_NAMES = frozenset(
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could may might must can yes no not this that it its if then".split()
) | {"market", "statement", "resolution", "criteria", "outcomes", "end", "date", "trading", "question", "resolves", "officially", "holds", "position", "market statement", "resolution criteria", "end date"}

#: Known data sources in order of precedence; a pattern without capitals is searched in lower case.
SOURCES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Coinbase", ("coinbase", r"cb\.usd")),
    ("Binance", ("binance",)),
    ("Kraken", ("kraken",)),
    ("CoinGecko", ("coingecko",)),
    ("CoinMarketCap", ("coinmarketcap", "cmc")),
    ("Bloomberg", ("bloomberg",)),
    ("Reuters", ("reuters",)),
    ("Yahoo Finance", (r"yahoo\s+finance",)),
    ("TradingView", ("tradingview",)),
    *((name, (rf"\b{name}\b",)) for name in ("NBA", "NFL", "MLB", "NHL", "MLS", "FIFA", "UEFA", "ATP", "WTA", "PGA", "ICC", "ESPN")),
    ("AP", (r"\bAssociated\s+Press\b", r"\bAP\s+News\b")),
    ("FiveThirtyEight", ("fivethirtyeight", "538")),
    ("RealClearPolitics", ("realclearpolitics", "rcp")),
    ("official results", (r"official\s+results", r"official\s+outcome")),
    ("election results", (r"election\s+results", "electoral")),
    ("government data", (r"government\s+data", r"\bfederal\b", r"\bcensus\b")),
    ("BLS", (r"\bBLS\b", r"Bureau\s+of\s+Labor")),
    ("BEA", (r"\bBEA\b", r"Bureau\s+of\s+Economic")),
    ("NOAA", (r"\bNOAA\b",)),
)
PROVENANCE = (
    r"(?i)(?:according\s+to|based\s+on|sourced?\s+from|resolved?\s+(?:by|via)|determined\s+by|reported\s+by|per)\s+"
    r"([A-Z][\w\s]{0,30}?)(?:\.|,|;|\s+and\s|\s+or\s|\s+at\s|$)"
)


#: For Java: digits, words and blanks of all of Unicode, as in Python.
_UNICODE = "(?U)"
_READING = "struct<at:int,value:double,unit:string>"


def _java(pattern: re.Pattern) -> str:
    return (_UNICODE + ("(?i)" if pattern.flags & re.IGNORECASE else "")) + pattern.pattern


def _value(number: Column) -> Column:
    """(value, digits, times) of a number with thousands marks and a k or m behind; the value is null where there are no digits."""

    def read(bare: Column) -> Column:
        times = F.coalesce(*[F.when(F.lower(F.right(bare, F.lit(1))) == mark, n) for mark, n in _MULTIPLES.items()], F.lit(1))
        digits = F.when(times > 1, F.left(bare, F.length(bare) - 1)).otherwise(bare)
        return F.struct((digits.try_cast("double") * times).alias("value"), digits.alias("digits"), times.alias("times"))

    return scan.let(F.replace(F.regexp_replace(number, r"^[$%]+|[$%]+$", ""), F.lit(","), F.lit("")), read)


def _unit_at(text: Column, at: Column) -> Column:
    found = F.regexp_extract(F.lower(F.substr(text, at + 1, F.lit(80))), _java(_UNIT), 1)
    return scan.let(found, lambda f: F.when(f == "", "numeric").otherwise(F.regexp_replace(f, "s+$", "")))


def _threshold(text: Column, at: Column, value: Column, unit: Column) -> Column:
    signs = F.create_map(*[F.lit(x) for pair in _SIGNS.items() for x in pair])
    near = F.regexp_extract(F.lower(scan.around(text, at, 30, 50)), _java(_COMPARISON), 1)
    negated = F.lower(scan.around(text, at, 50, 0)).rlike(_java(_NEGATION))

    def built(c: Column) -> Column:
        context = F.when(c["negated"], scan.stripped(scan.around(text, at, 100, 50)))
        comparison = F.when(c["near"] == "", ">=").otherwise(F.coalesce(F.element_at(signs, c["near"]), c["near"]))
        return F.struct(value.alias("value"), unit.alias("unit"), comparison.alias("comparison"), c["negated"].alias("is_negated"), context.alias("negation_context"))

    return scan.let(F.struct(near.alias("near"), negated.alias("negated")), built)


def _readings(text: Column) -> Column:
    """(at, value, unit) of every threshold, pass by pass."""

    def reading(at: Column, value: Column, unit: Column) -> Column:
        return F.struct(at.alias("at"), value.alias("value"), unit.alias("unit")).cast(_READING)

    def marked(unit: str) -> Callable[[Column], Column]:
        return lambda x: reading(x["at"], _value(x["hit"])["value"], F.lit(unit))

    def numbered(pattern: re.Pattern) -> Callable[[Column], Column]:
        def read_one(x: Column) -> Column:
            both = F.struct(_value(F.regexp_extract(x["hit"], _java(pattern), 1)).alias("read"), _unit_at(text, x["at"]).alias("unit"))
            return scan.let(both, lambda y: judged(x, y["read"], y["unit"]))

        def judged(x: Column, read: Column, unit: Column) -> Column:
            skipped = (read["times"] == 1) & F.substring_index(read["digits"], ".", 1).rlike(_java(_YEAR))
            if pattern is _BEFORE_UNIT:
                # "Game 3 Winner" numbers a game.
                behind = F.lower(F.substr(text, x["at"] + F.length(x["hit"]) + 1, F.lit(20)))
                skipped = skipped | (unit.isin(*_ORDINAL_UNITS) & _any([F.contains(behind, F.lit(w)) for w in _ORDINAL_WORDS]))
            return reading(x["at"], F.when(~skipped, read["value"]), unit)

        return read_one

    rules = [(_CURRENCY, marked("dollars")), (_PERCENT, marked("percentage")), (_AFTER_WORD, numbered(_AFTER_WORD)), (_BEFORE_UNIT, numbered(_BEFORE_UNIT))]
    passes = [F.transform(scan.hits(text, _java(pattern)), read) for pattern, read in rules]
    return F.filter(F.concat(*passes), lambda x: x["value"].isNotNull())


def thresholds(statement: Column, criteria: Column) -> Column:
    """Thresholds in order of discovery; the first of a value and unit counts."""

    def once(found: Column, x: Column) -> Column:
        known = F.exists(found, lambda y: (y["value"] == x["value"]) & (y["unit"] == x["unit"]))
        return F.when(known, found).otherwise(F.concat(found, F.array(x)))

    def read(text: Column) -> Column:
        first = F.aggregate(_readings(text), F.array().cast(f"array<{_READING}>"), once)
        return F.transform(first, lambda x: _threshold(text, x["at"], x["value"], x["unit"]))

    both = F.concat_ws(" ", F.coalesce(statement, F.lit("")), F.coalesce(criteria, F.lit("")))
    return scan.let(both, read).cast(f"array<{THRESHOLD}>")


def regex_entities(statement: Column, criteria: Column, narrow: bool = False) -> Column:
    """Proper names, then the sides of "X vs Y"; the first spelling counts."""
    text = F.concat_ws(" ", F.coalesce(statement, F.lit("")), F.coalesce(criteria, F.lit("")))
    named = "struct<name:string,proper:boolean>"

    def all_of(pattern: re.Pattern, group: int, proper: bool) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(group)), lambda n: F.struct(scan.stripped(n).alias("name"), F.lit(proper).alias("proper")).cast(named))

    sides = F.flatten(F.zip_with(all_of(VERSUS, 1, False), all_of(VERSUS, 2, False), lambda x, y: F.array(x, y)))
    every = F.concat(all_of(PROPER_NAMES_NARROW if narrow else PROPER_NAMES, 1, True), sides)
    kept = F.filter(every, lambda x: (F.length(x["name"]) >= 3) & ~F.lower(x["name"]).isin(*sorted(NOT_NAMES)))

    def once(found: Column, x: Column) -> Column:
        return F.when(F.exists(found, lambda y: y["name"] == x["name"]), found).otherwise(F.concat(found, F.array(x)))

    def entity(x: Column) -> Column:
        words = F.size(F.split(x["name"], f"[{scan.BLANKS}]+"))
        kind = F.when(x["proper"] & words.between(2, 4), "person").otherwise("other")
        return F.struct(x["name"].alias("name"), kind.alias("entity_type"), F.array().cast("array<string>").alias("aliases"))

    first = F.aggregate(kept, F.array().cast(f"array<{named}>"), once)
    return F.transform(first, entity).cast(f"array<{ENTITY}>")


#: Entity types by the labels of customary named-entity models; other labels (dates, money, numbers) are no entities.
LABELS = {"PERSON": "person", "ORG": "organization", "GPE": "location", "LOC": "location", "FAC": "location", "NORP": "other", "EVENT": "other", "PRODUCT": "other", "WORK_OF_ART": "other"}


def of_labels(found: list[tuple[str, str]]) -> list[dict]:
    """Entities of a model's (text, label) spans: known labels, no common words, the first of equal texts."""
    named: dict[str, str | None] = {}
    for name, label in found:
        if name.lower() not in NOT_NAMES:
            named.setdefault(name, LABELS.get(label))
    return [{"name": n, "entity_type": kind, "aliases": []} for n, kind in named.items() if kind]


def labelling(load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]]) -> Callable[[], Callable[[list[str]], list[list[dict]]]]:
    """A loader for :func:`model_entities` from one whose model gives (text, label) spans."""

    def loaded() -> Callable[[list[str]], list[list[dict]]]:
        model = load()
        return lambda texts: [of_labels(found) for found in model(texts)]

    return loaded


def model_entities(text: Column, load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> Column:
    """Entities of a named-entity model; ``load`` runs once per Python worker.  Texts under ten characters have none."""

    @F.pandas_udf(f"array<{ENTITY}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            short = [t is None or len(t) < 10 for t in batch]
            found = iter(model([t for t, s in zip(batch, short, strict=True) if not s]))
            yield pd.Series([[] if s else next(found) for s in short])

    return run(text)


def merged_entities(first: Column, second: Column) -> Column:
    """Both lists in order; of names equal but for case the first counts."""
    empty = f"CAST(array() AS array<{ENTITY}>)"
    both = F.concat(F.coalesce(first, F.expr(empty)), F.coalesce(second, F.expr(empty)))
    return F.aggregate(both, F.expr(empty), lambda acc, e: F.when(F.exists(acc, lambda x: F.lower(x["name"]) == F.lower(e["name"])), acc).otherwise(F.concat(acc, F.array(e))))


def data_source(criteria: Column, statement: Column) -> Column:
    """The first known source in either text, else the phrase behind a provenance word."""
    text = F.concat_ws(" ", F.when(criteria != "", criteria), F.when(statement != "", statement))

    def known(of: Column) -> Column:
        lower = F.lower(of)
        hits = [F.when(_any([(lower if p.islower() else of).rlike(p) for p in patterns]), name) for name, patterns in SOURCES]
        return F.coalesce(*hits)

    cited = F.trim(F.regexp_extract(text, PROVENANCE, 1))
    return F.coalesce(known(text), F.when(F.length(cited) > 1, cited))


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found
