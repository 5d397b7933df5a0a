"""Scores of candidate pairs and the verdict, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.functions.text import micros

EPS = 1e-9
DAY_MICROS = 86_400_000_000


def nli_normalised(entailment: Column, neutral: Column, contradiction: Column) -> list[Column]:
    """The three shares, adding up to one; a missing label counts 0 and three zeros stay."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in (entailment, neutral, contradiction)]
    total = parts[0] + parts[1] + parts[2]
    return [F.when(total > 0, p / total).otherwise(p) for p in parts]


def nli_both_ways(forward: list[Column], reverse: list[Column]) -> list[Column]:
    """The cautious merge of two directions: least entailment, most of the others."""
    return [F.least(forward[0], reverse[0]), F.greatest(forward[1], reverse[1]), F.greatest(forward[2], reverse[2])]


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def nli_confidence(e: Column, n: Column, c: Column) -> tuple[Column, Column]:
    """(confidence, match type) of a merged triple."""
    middle = (n > 0.3) | e.between(0.4, 0.7)
    score = F.when(e >= 0.7, e).when(middle, 0.6 * e + 0.4 * n).when(c > 0.5, 1 - c).otherwise(e)
    return _unit(score), F.when(e >= 0.7, "full_match").when(middle, "partial_match").otherwise("no_match")


def rerank_score(primary: Column, secondary: Column, settings: Settings = Settings()) -> tuple[Column, Column]:
    """(score, match type) from the score of the main event and the mean of the clauses (null if none)."""
    blended = F.when(secondary.isNull(), primary).otherwise(0.7 * primary + 0.3 * secondary)
    low = primary < settings.least_primary
    kind = F.when(low, "no_match").when(blended >= 0.7, F.when(primary > 0.7, "full_match").otherwise("partial_match")).otherwise("no_match")
    return F.when(low, primary).otherwise(blended), kind


def days_apart(a: Column, b: Column) -> Column:
    """Whole days between two times: floored before the sign is dropped, so the order counts."""
    return F.abs(F.floor((micros(a) - micros(b)) / F.lit(float(DAY_MICROS))))


def date_score(a: Column, b: Column, deadline_differs: Column | None = None, settings: Settings = Settings()) -> Column:
    days = days_apart(a, b)
    score = F.when(days == 0, 1.0).when(days <= settings.date_tolerance_days, 0.9).when(days <= 7, 0.7).when(days <= 30, 0.4).otherwise(0.3)
    if deadline_differs is not None:
        score = F.when(deadline_differs, F.least(score, F.lit(0.5))).otherwise(score)
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(score)


def date_gap_class(a: Column, b: Column) -> Column:
    days = F.abs(micros(a) - micros(b)) / F.lit(float(DAY_MICROS))
    return F.when(days < 1, "same").when(days < 7, "possibly_same").otherwise("different")


def source_score(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.5).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(0.0)


def threshold_value_score(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """How near a value is to ``a``, relative to ``a`` alone."""
    gap, size = F.abs(a - b), F.abs(a)
    return F.when(gap <= size * tolerance, 1.0).when(gap <= size * 0.05, 0.8).when(gap <= size * 0.10, 0.5).otherwise(0.0)


def threshold_score(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Of two arrays of thresholds: the share of A's that some B meets in unit, comparison, negation and value."""
    def best(x: Column) -> Column:
        like = F.filter(b, lambda y: y["unit"].eqNullSafe(x["unit"]) & (y["comparison"] == x["comparison"]) & (y["is_negated"] == x["is_negated"]))
        return F.coalesce(F.array_max(F.transform(like, lambda y: threshold_value_score(x["value"], y["value"], tolerance))), F.lit(0.0))

    met = F.size(F.filter(a, lambda x: best(x) > 0.5))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(met / F.greatest(F.size(a), F.size(b)))


def weighted_score(parts: dict[str, tuple[Column, Column]], settings: Settings = Settings()) -> Column:
    """Weighted mean of the informative parts, name to (score, informative); 0.5 if there is none."""
    def total(value) -> Column:
        found = F.lit(0.0)
        for name, (score, informative) in parts.items():
            found = found + F.when(informative, value(score) * settings.weights[name]).otherwise(0.0)
        return found

    weight = total(lambda _: F.lit(1.0))
    return F.when(weight > 0, total(lambda s: s) / weight).otherwise(0.5)


def verdict(ce: Column, entity: Column, threshold: Column, date: Column, weighted: Column, entity_informative: Column, threshold_informative: Column, esports: Column | bool = False, multi_outcome: Column | bool = False, settings: Settings = Settings()) -> tuple[Column, Column]:
    """(verdict, confidence) by the ordered decision table; comparisons with >= allow for EPS."""
    esports = F.lit(esports) if isinstance(esports, bool) else esports
    multi = F.lit(multi_outcome) if isinstance(multi_outcome, bool) else multi_outcome
    relaxed = esports & (ce > 0.75)
    tolerance = F.when(relaxed, 0.6).otherwise(settings.entity_tolerance)
    early = multi & entity_informative & (entity < 0.4)
    critical = (entity_informative & (entity < tolerance * 0.5 - EPS)) | (threshold_informative & (threshold < 0.3 - EPS)) | (date < F.when(relaxed, 0.3).otherwise(0.5) - EPS)
    equivalent = (
        (weighted >= F.when(relaxed, 0.75).otherwise(settings.equivalent_at) - EPS)
        & (~entity_informative | (entity >= tolerance - EPS))
        & (~threshold_informative | (threshold >= 0.8 - EPS))
        & (date >= F.when(relaxed, 0.6).otherwise(0.8) - EPS)
        & (ce >= 0.7 - EPS)
    )
    found = (
        F.when(ce < 0.5, "not_equivalent")
        .when(early, "not_equivalent")
        .when(critical, "not_equivalent")
        .when(equivalent, "equivalent")
        .when(weighted < settings.not_equivalent_below - EPS, "not_equivalent")
        .otherwise("needs_review")
    )
    return found, F.when(ce < 0.5, ce).when(early, F.least(entity, threshold, date)).otherwise(weighted)


#: Labels that name a side of a binary market.
SIDES = {"yes": "YES", "y": "YES", "true": "YES", "1": "YES", "no": "NO", "n": "NO", "false": "NO", "0": "NO"}


def outcome_mapping(a: Column, b: Column) -> Column:
    """Labels of A to those of B: by side for two outcomes each (empty if a label has none), by position for more."""
    sides = F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair])

    def side(x: Column) -> Column:
        return F.element_at(sides, F.lower(F.trim(x)))

    keyed = F.transform(a, lambda x: F.struct(x.alias("k"), side(x).alias("v")))
    known = F.forall(a, lambda x: side(x).isNotNull()) & F.forall(b, lambda x: side(x).isNotNull())
    binary = F.when(known, F.map_from_entries(keyed)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    n = F.least(F.size(a), F.size(b))
    by_place = F.map_from_arrays(F.slice(a, 1, n), F.slice(b, 1, n))
    return F.when((F.size(a) == 2) & (F.size(b) == 2), binary).otherwise(by_place)


def is_inverted(mapping: Column) -> Column:
    def crossed(e: Column) -> Column:
        k, v = F.lower(F.trim(e["key"])), F.lower(F.trim(e["value"]))
        return ((k == "yes") & (v == "no")) | ((k == "no") & (v == "yes"))

    return F.exists(F.map_entries(mapping), crossed)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def extraction_confidence(statement: Column, criteria: Column, outcomes: Column, date: Column, entities: Column, thresholds: Column, source: Column) -> Column:
    """Mean of seven field scores."""
    parts = [
        F.when(F.coalesce(statement, F.lit("")) != "", 1.0).otherwise(0.5),
        F.when(criteria.isNotNull() & (criteria != ""), 1.0).otherwise(0.0),
        F.when(F.size(outcomes) > 0, 1.0).otherwise(0.5),
        F.when(date.isNotNull(), 1.0).otherwise(0.0),
        F.when(F.size(entities) > 0, 0.8).otherwise(0.0),
        F.when(F.size(thresholds) > 0, 0.9).otherwise(0.0),
        F.when(source.isNotNull() & (source != ""), 0.7).otherwise(0.0),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def failed_fields(statement: Column, date: Column, entities: Column, thresholds: Column, source: Column) -> Column:
    named = {
        "statement": F.length(F.coalesce(statement, F.lit(""))) < 10,
        "resolution_date": date.isNull(),
        "entities": F.size(entities) < 1,
        "thresholds": F.size(thresholds) < 1,
        "data_source": source.isNull(),
    }
    return F.filter(F.array(*[F.when(c, k) for k, c in named.items()]), lambda k: k.isNotNull())


def unit_vector(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def resized(vector: Column, dimensions: int) -> Column:
    """The first components, or zeros added; not normalised again."""
    return F.when(F.size(vector) >= dimensions, F.slice(vector, 1, dimensions)).otherwise(F.concat(vector, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(dimensions) - F.size(vector), F.lit(1))), lambda _: F.lit(0.0).cast("float"))))


def instructed(text: Column, instruction: str) -> Column:
    return F.concat(F.lit(f"{instruction}\n"), text) if instruction else text
