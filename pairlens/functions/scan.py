"""Matches of a pattern with their positions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python knows it, for the inside of a character class.
BLANKS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hits(text: Column, pattern: str) -> Column:
    """array of (at, hit): every match of a pattern that is never empty, from left to right, with its start in characters.

    What lies between matches and the matches themselves come from one scan order, so their lengths add up to positions.
    """
    empty = F.array().cast("array<struct<at:int,hit:string>>")

    def placed(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at, hit = acc["end"] + F.length(F.get(parts["gaps"], i)), F.get(parts["found"], i)
            out = F.concat(acc["out"], F.array(F.struct(at.alias("at"), hit.alias("hit"))))
            return F.struct((at + F.length(hit)).alias("end"), out.alias("out"))

        begin = F.struct(F.lit(0).alias("end"), empty.alias("out"))
        positions = F.aggregate(F.sequence(F.lit(0), F.size(parts["gaps"]) - 2), begin, step, lambda acc: acc["out"])
        return F.when(F.size(parts["gaps"]) > 1, positions).otherwise(empty)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def around(text: Column, at: Column, before: int, behind: int) -> Column:
    """The characters of ``text`` from ``before`` ahead of a position (as many as there are) to ``behind`` after it."""
    first = F.greatest(at - before, F.lit(0))
    return F.substr(text, first + 1, at + behind - first)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
