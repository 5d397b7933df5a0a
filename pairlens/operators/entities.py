"""Scores of two lists of entities."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions import scan
from pairlens.operators.aliases import SPELLINGS

FUZZY = 0.5
MISMATCH_PENALTY = 0.3

#: The built-in spellings by name; another table goes in as a parameter.
ALIASES: dict[str, tuple[str, ...]] = SPELLINGS


def alias_lookup(aliases: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Lower-case alias to canonical name; of colliding aliases the last one counts."""
    return {a.lower(): name for name, own in (aliases if aliases is not None else ALIASES).items() for a in (name, *own)}


def canonical_name(name: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The canonical name of an alias, else the name in lower case; the table goes along as one literal."""
    table = F.from_json(F.lit(json.dumps(alias_lookup(aliases))), "map<string,string>")
    return F.coalesce(F.element_at(table, F.lower(name)), F.lower(name))


def _words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), f"[{scan.BLANKS}]+"), lambda w: w != ""))


def _overlap(a: Column, b: Column) -> Column:
    """The share of common words in all words of two lists; 0 if either is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def _named(entities: Column, aliases: dict[str, tuple[str, ...]] | None) -> Column:
    """(name, i): the canonical names of each entity, itself first, then its aliases."""

    def names(e: Column, i: Column) -> Column:
        own = F.concat(F.array(e["name"]), F.coalesce(e["aliases"], F.array().cast("array<string>")))
        return F.transform(own, lambda n: F.struct(canonical_name(n, aliases).alias("name"), i.alias("i")))

    return F.flatten(F.transform(entities, names))


def entity_score(a: Column, b: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(score, matched, mismatched) of two arrays of entities: equal canonical names first, then the best overlap, each entity once.

    Both steps are folds over the first list that carry the pairs found so far.  Without entities on a side the score is a half.
    """
    empty = F.array().cast("array<struct<i:int,j:int>>")

    def free(pairs: Column, side: str, at: Column) -> Column:
        return ~F.exists(pairs, lambda p: p[side] == at)

    def equal(names: Column) -> Column:
        # Of names that occur again the first entity counts.
        first = scan.let(F.transform(names["a"], lambda y: y["name"]), lambda own: F.filter(names["a"], lambda x, k: F.array_position(own, x["name"]) == k + 1))

        def step(pairs: Column, x: Column) -> Column:
            def taken(j: Column) -> Column:
                fits = j.isNotNull() & free(pairs, "i", x["i"]) & free(pairs, "j", j)
                return F.when(fits, F.concat(pairs, F.array(F.struct(x["i"].alias("i"), j.alias("j"))))).otherwise(pairs)

            return scan.let(F.get(F.filter(names["b"], lambda y: y["name"] == x["name"]), F.lit(0))["i"], taken)

        return F.aggregate(first, empty, step)

    def near(words: Column) -> Callable[[Column, Column], Column]:
        def step(pairs: Column, i: Column) -> Column:
            open_ = F.filter(F.sequence(F.lit(0), F.size(words["b"]) - 1), lambda j: free(pairs, "j", j))
            # Equal overlaps go to the entity that stands first.
            best = F.array_max(F.transform(open_, lambda j: F.struct(_overlap(F.get(words["a"], i), F.get(words["b"], j)).alias("overlap"), (-j).alias("j"))))

            def taken(found: Column) -> Column:
                more = F.concat(pairs, F.array(F.struct(i.alias("i"), (-found["j"]).alias("j"))))
                return F.when(found["overlap"] >= FUZZY, more).otherwise(pairs)

            return F.when(free(pairs, "i", i), scan.let(best, taken)).otherwise(pairs)

        return step

    def scored(pairs: Column) -> Column:
        total = F.greatest(F.size(a), F.size(b))
        wrong = F.size(F.filter(pairs, lambda p: ~F.get(a, p["i"])["entity_type"].eqNullSafe(F.get(b, p["j"])["entity_type"])))
        score = F.greatest(F.lit(0.0), F.size(pairs) / total - wrong / total * MISMATCH_PENALTY)
        return F.struct(score.alias("score"), F.size(pairs).alias("matched"), wrong.alias("mismatched"))

    names = F.struct(_named(a, aliases).alias("a"), _named(b, aliases).alias("b"))
    words = F.struct(*[F.transform(side, lambda e: _words(e["name"])).alias(n) for n, side in (("a", a), ("b", b))])
    fuzzy = scan.let(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.size(w["a"]) - 1), scan.let(names, equal), near(w), scored))
    none = F.struct(F.lit(0.5).alias("score"), F.lit(0).alias("matched"), F.lit(0).alias("mismatched"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), fuzzy).otherwise(none)
