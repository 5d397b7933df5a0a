"""Second scoring of candidates: main event, then clause against clause."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.functions import scores

NLI = "struct<entailment:double,neutral:double,contradiction:double>"
Scorer = Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]


class LexicalScorer:
    """A stand-in for a language inference model: shared words entail, the rest is neutral.

    It makes the plumbing testable and claims nothing about match quality.
    """

    def __call__(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        out = []
        for a, b in pairs:
            x, y = set(a.lower().split()), set(b.lower().split())
            share = len(x & y) / len(x) if x else 0.0
            out.append((share, (1 - share) * 0.7, (1 - share) * 0.3))
        return out


class LexicalEncoder:
    """A stand-in for an embedding model: counts of hashed words, at unit length."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for text in texts:
            v = np.zeros(self.dimensions, np.float32)
            for word in text.lower().split():
                v[zlib.crc32(word.encode()) % self.dimensions] += 1
            length = float(np.linalg.norm(v))
            out.append((v / length if length else v).tolist())
        return out


def nli(a: Column, b: Column, load: Callable[[], Scorer] = LexicalScorer) -> Column:
    """The model's triple for each pair of texts; ``load`` runs once per Python worker."""

    @F.pandas_udf(NLI)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for left, right in batches:
            yield pd.DataFrame(model([(x or "", y or "") for x, y in zip(left, right, strict=True)]), columns=["entailment", "neutral", "contradiction"])

    return run(a, b)


def embedded(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]] = LexicalEncoder) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model([t or "" for t in batch]))

    return run(text)


def _triple(c: str) -> list[Column]:
    return scores.nli_normalised(F.col(f"{c}.entailment"), F.col(f"{c}.neutral"), F.col(f"{c}.contradiction"))


def confidence_of(forward: str, reverse: str | None = None) -> tuple[Column, Column]:
    triple = scores.nli_both_ways(_triple(forward), _triple(reverse)) if reverse else _triple(forward)
    return scores.nli_confidence(*triple)


#: Rows that one task groups.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """``rows`` by ``key`` in as many tasks as their counted number needs, so that a larger table means more
    tasks and not larger ones; groups and ranks within ``key`` need no further shuffle.  For tables, whose count is cheap."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // (task_rows or TASK_ROWS))), key)


def best_match_mean(pairs: DataFrame, keys: list[str], clause: str, confidence: str, most: tuple[str, ...] = ()) -> DataFrame:
    """Per key: the mean over its clauses of each one's best confidence (0 at least), and the highest value of the columns ``most``."""
    tops = [F.max(c).alias(c) for c in most]
    best = pairs.groupBy(*keys, clause).agg(F.greatest(F.max(confidence), F.lit(0.0)).alias("_best"), *tops)
    return best.groupBy(*keys).agg(F.avg("_best").alias("secondary"), *tops)


def kept(scored: DataFrame, query: str, settings: Settings = Settings(), tie: tuple[str, ...] = ()) -> DataFrame:
    """The candidates of a query from ``least_rerank`` on, best first, ``rerank_keep`` at most."""
    order = W.partitionBy(query).orderBy(F.col("score").desc(), *tie)
    return scored.where(F.col("score") >= settings.least_rerank).withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.rerank_keep)


def rerank(pairs: DataFrame, load: Callable[[], Scorer] = LexicalScorer, settings: Settings = Settings()) -> DataFrame:
    """``pairs``: query_id, candidate_id, similarity, event_a, event_b, clauses_a, clauses_b (arrays).

    Adds primary, secondary, score and match_type, and keeps the best of each query.
    Clauses are only scored for pairs whose main event passes.
    """
    keys = ["query_id", "candidate_id"]
    first = pairs.withColumn("_f", nli(F.col("event_a"), F.col("event_b"), load)).withColumn("_r", nli(F.col("event_b"), F.col("event_a"), load))
    first = first.withColumn("primary", confidence_of("_f", "_r")[0]).drop("_f", "_r")
    open_ = first.where(F.col("primary") >= settings.least_primary)
    clauses = open_.select(*keys, F.posexplode("clauses_a").alias("clause", "a"), "clauses_b").select(*keys, "clause", "a", F.explode("clauses_b").alias("b"))
    clauses = clauses.withColumn("_f", nli(F.col("a"), F.col("b"), load)).withColumn("confidence", confidence_of("_f")[0])
    secondary = best_match_mean(clauses, keys, "clause", "confidence")
    joined = first.join(secondary, keys, "left")
    score, kind = scores.rerank_score(F.col("primary"), F.col("secondary"), settings)
    return kept(joined.withColumns({"score": score, "match_type": kind}), "query_id", settings, ("similarity", "candidate_id"))
