"""From market events to verified pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.config import VENUES, Settings
from pairlens.functions import discovery, extract, scores, text
from pairlens.operators import dedup, entities, persist, rerank, retrieve

#: Venues with a text builder; register a column function to add one.
BUILDERS: dict[str, Callable[[], Column]] = {
    v: lambda: text.canonical_text(F.col("title"), F.col("resolution_criteria"), F.col("description"), F.col("end_date"), F.transform("outcomes", lambda o: o["label"])) for v in ("kalshi", "polymarket")
}


def canonicalised(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with canonical text and hashes, and those of venues that have no builder."""
    chosen = F.coalesce(*[F.when(F.col("venue") == v, build()) for v, build in BUILDERS.items()])
    known = F.col("venue").isin(*BUILDERS) & F.col("title").isNotNull()
    rows = events.where(known).withColumn("canonical_text", chosen)
    hashes = {"content_hash": text.content_hash(F.col("canonical_text")), "identity_hash": text.identity_hash(F.col("venue"), F.col("venue_market_id"))}
    return rows.withColumns(hashes), events.where(~F.coalesce(known, F.lit(False)))


def vector_points(markets: DataFrame, encode: Callable = rerank.LexicalEncoder) -> DataFrame:
    """Points of market events for a vector index: (point_id, vector, venue, venue_market_id, title, content_hash).

    Venues without a text builder and events without a title give none.
    """
    rows, _ = canonicalised(markets)
    vector = rerank.embedded(F.col("canonical_text"), encode)
    return rows.select(persist.point_id(F.col("identity_hash")).alias("point_id"), vector.alias("vector"), "venue", "venue_market_id", "title", "content_hash")


def extracted(texts: DataFrame, narrow_names: bool = False, load_names: Callable | None = None) -> DataFrame:
    """Specs of (content_hash, canonical_text): each distinct text is read once.

    ``load_names`` loads a named-entity model whose entities come before those of the patterns.
    """
    once = texts.select("content_hash", "canonical_text").dropDuplicates(["content_hash"])
    t = F.col("canonical_text")
    rows = once.withColumns(
        {
            "statement": text.parse_statement(t),
            "resolution_criteria": text.parse_criteria(t),
            "outcome_labels": text.parse_outcomes(t),
            "resolution_date": text.parse_date(text.parse_end_date(t)),
            "event_date": text.event_date(t),
        }
    )
    s, c = F.col("statement"), F.col("resolution_criteria")
    both = F.trim(F.concat_ws(" ", F.coalesce(s, F.lit("")), F.coalesce(c, F.lit(""))))
    named = extract.model_entities(both, load_names) if load_names else F.array().cast(f"array<{extract.ENTITY}>")
    rows = rows.withColumns(
        {
            "thresholds": extract.thresholds(s, c),
            "entities": extract.merged_entities(named, extract.regex_entities(s, c, narrow_names)),
            "data_source": extract.data_source(c, s),
            "clauses": text.secondary_clauses(c),
        }
    )
    parts = ("entities", "thresholds", "data_source")
    return rows.withColumns(
        {
            "confidence": scores.extraction_confidence(s, c, F.col("outcome_labels"), F.col("resolution_date"), *[F.col(p) for p in parts]),
            "failed_fields": scores.failed_fields(s, F.col("resolution_date"), *[F.col(p) for p in parts]),
        }
    ).drop("canonical_text")


#: Below this confidence a fallback is asked, and what it gives back is trusted this far.
ASK_BELOW, FALLBACK_CONFIDENCE = 0.7, 0.9


def with_fallback(specs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]] | None = None) -> DataFrame:
    """Specs whose unsure rows get their thresholds from a model (statement in, thresholds out); off without one.

    Sure rows never reach the model: they are split off before it runs.
    """
    if load is None:
        return specs

    @F.pandas_udf(f"array<{extract.THRESHOLD}>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model([s or "" for s in batch]))

    unsure = specs.where(F.col("confidence") < ASK_BELOW)
    asked = unsure.withColumns({"thresholds": ask(F.col("statement")), "confidence": F.lit(FALLBACK_CONFIDENCE)})
    return specs.where(F.col("confidence") >= ASK_BELOW).unionByName(asked)


def verified(pairs: DataFrame, settings: Settings = Settings(), aliases: dict[str, tuple[str, ...]] | None = None, esports: bool = False) -> DataFrame:
    """``pairs``: market_a_id, market_b_id, score, and for both sides <field>_a, <field>_b of the specs.

    Adds the five scores, weighted score, verdict, confidence and outcome mapping.
    """
    f = lambda name, s: F.col(f"{name}_{s}")
    rows = pairs.withColumn("_e", entities.entity_score(f("entities", "a"), f("entities", "b"), aliases))
    rows = rows.withColumns(
        {
            "entity_score": F.col("_e.score"),
            "threshold_score": scores.threshold_score(f("thresholds", "a"), f("thresholds", "b"), settings.threshold_tolerance),
            "date_score": scores.date_score(f("resolution_date", "a"), f("resolution_date", "b"), settings=settings),
            "source_score": scores.source_score(f("data_source", "a"), f("data_source", "b")),
            "entity_informative": (F.size(f("entities", "a")) > 0) | (F.size(f("entities", "b")) > 0),
            "threshold_informative": (F.size(f("thresholds", "a")) > 0) | (F.size(f("thresholds", "b")) > 0),
            "source_informative": f("data_source", "a").isNotNull() | f("data_source", "b").isNotNull(),
            "multi": ~((F.size(f("outcome_labels", "a")) == 2) & (F.size(f("outcome_labels", "b")) == 2)),
        }
    )
    parts = {
        "cross_encoder": (F.col("score"), F.lit(True)),
        "threshold": (F.col("threshold_score"), F.col("threshold_informative")),
        "entity": (F.col("entity_score"), F.col("entity_informative")),
        "date": (F.col("date_score"), F.lit(True)),
        "source": (F.col("source_score"), F.col("source_informative")),
    }
    rows = rows.withColumn("weighted_score", scores.weighted_score(parts, settings))
    verdict, confidence = scores.verdict(F.col("score"), F.col("entity_score"), F.col("threshold_score"), F.col("date_score"), F.col("weighted_score"), F.col("entity_informative"), F.col("threshold_informative"), esports, F.col("multi"), settings)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    early = (F.col("score") < 0.5) | (F.col("multi") & F.col("entity_informative") & (F.col("entity_score") < 0.4))
    mapping = F.when(early, empty).otherwise(scores.outcome_mapping(f("outcome_labels", "a"), f("outcome_labels", "b")))
    return rows.withColumns({"verdict": verdict, "confidence": confidence, "outcome_mapping": mapping, "pair_key": scores.pair_key(F.col("market_a_id"), F.col("market_b_id"))}).drop("_e", "multi")


def verify_by_id(matches: DataFrame, specs: DataFrame, settings: Settings = Settings(), aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Verified pairs of (market_a_id, market_b_id, score) with specs stored as ``<market id>_spec``.

    ``specs``: spec_id and the fields of :func:`extracted`; pairs that lack a spec are left out.
    """
    rows = matches
    for s in "ab":
        side = specs.select(*[F.col(c).alias("_spec" if c == "spec_id" else f"{c}_{s}") for c in specs.columns])
        rows = rows.withColumn("_spec", F.concat(f"market_{s}_id", F.lit("_spec"))).join(side, "_spec").drop("_spec")
    return verified(rows, settings, aliases)


def persistable(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("verdict").isin("equivalent", "needs_review"))


def match(events: DataFrame, strategy: str = "normal", encode: Callable = rerank.LexicalEncoder, judge: Callable = rerank.LexicalScorer, settings: Settings = Settings(), aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Verified pairs of a table of market events, each unordered pair once, the later arrival as query."""
    taken = dedup.ttl_dedup(events.where(discovery.accepts(strategy)), ["venue", "venue_market_id"], "received_at", ["title"], settings.dedup_ttl_seconds)
    rows, _ = canonicalised(taken)
    rows = retrieve.valid_candidates(rows, VENUES).withColumn("id", F.xxhash64("identity_hash"))
    vectors = rows.select("id", "venue", "content_hash", "canonical_text").withColumn("vector", rerank.embedded(F.col("canonical_text"), encode))
    found = retrieve.similar(vectors, "id", "venue", "vector", settings=settings)
    once = retrieve.one_direction(found, rows.select("id", "received_at"))
    specs = extracted(rows)
    side = rows.select("id", "venue", "venue_market_id", "content_hash").join(specs, "content_hash")
    a, b = (side.select(F.col("id").alias(i), *[F.col(c).alias(f"{c}_{s}") for c in side.columns if c != "id"]) for i, s in (("query_id", "a"), ("candidate_id", "b")))
    pairs = once.join(a, "query_id").join(b, "candidate_id")
    reranked = rerank.rerank(pairs.withColumns({"event_a": F.col("statement_a"), "event_b": F.col("statement_b")}).drop("pair_key"), judge, settings)
    market = {"market_a_id": F.concat_ws(":", "venue_a", "venue_market_id_a"), "market_b_id": F.concat_ws(":", "venue_b", "venue_market_id_b")}
    return verified(reranked.withColumns(market), settings, aliases, strategy == "esports")
