"""Market reaction latency: events matched to the first price update behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.functions.text import micros


def first_reactions(events: DataFrame, snapshots: DataFrame, window_ms: float = 5_000.0, keys: Sequence[str] = (), seq: Sequence[str] = ()) -> DataFrame:
    """For each event the first snapshot 0 to ``window_ms`` later: snapshot_ts and latency_ms; others have none and go.

    ``events``: event_id, event_ts and the keys; ``snapshots``: snapshot_ts, the keys and
    ``seq`` for ties.  Time is cut into buckets of the window's length.  Both tables are read
    together backwards in time, bucket by bucket, with the last snapshot seen at hand; an event
    behind all snapshots of its bucket takes the first of the next bucket.  So each row is
    sorted once and no event meets more than two snapshots.
    """
    width = int(window_ms * 1000)

    def bucket(ts: str) -> Column:
        return F.floor(micros(ts) / F.lit(width))

    rest = [c for c in snapshots.columns if c not in keys]
    left = events.where("event_ts IS NOT NULL").select(bucket("event_ts").alias("_b"), *keys, F.struct("event_id", "event_ts").alias("_e"), micros("event_ts").alias("_at"))
    right = snapshots.where("snapshot_ts IS NOT NULL").select(bucket("snapshot_ts").alias("_b"), *keys, F.struct(*rest).alias("_s"), micros("snapshot_ts").alias("_at"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(seq)])
    both = left.unionByName(right, allowMissingColumns=True)
    # Backwards: at one time snapshots come before events, the one with the smallest ``seq`` last.
    backwards = [F.col("_at").desc(), F.col("_e").isNotNull(), *[F.col(f"_o{i}").desc() for i in range(len(seq))]]
    seen = F.last("_s", ignorenulls=True).over(W.partitionBy("_b", *keys).orderBy(*backwards).rowsBetween(W.unboundedPreceding, 0))
    own = both.withColumn("_x", seen).where("_e IS NOT NULL").select("_b", *keys, "_e", "_x")
    # Null keys equal each other here as they do within a bucket.
    names = {k: f"_k{i}" for i, k in enumerate(["_b", *keys])}
    firsts = right.groupBy((F.col("_b") - 1).alias("_k0"), *[F.col(k).alias(names[k]) for k in keys]).agg(F.min_by("_s", F.struct("_at", *[f"_o{i}" for i in range(len(seq))])).alias("_n"))
    found = own.join(firsts, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left").withColumn("_x", F.coalesce("_x", "_n"))
    gap = micros("_x.snapshot_ts") - micros("_e.event_ts")
    return found.where(gap.between(0, width)).select("_e.event_id", "_e.event_ts", *keys, (gap / 1000.0).alias("latency_ms"), *[F.col(f"_x.{c}").alias(c) for c in rest])


def latency_stats(samples: DataFrame, order: Sequence[str], last: int = 1000) -> DataFrame:
    """Count, extremes, mean and upper median of the last samples."""
    recent = samples.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    values = F.sort_array(F.collect_list("latency_ms"))
    stats = recent.agg(F.count("*").alias("count"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"), F.avg("latency_ms").alias("mean"), values.alias("v"))
    return stats.select("count", "min", "max", "mean", F.get("v", F.floor(F.col("count") / 2).cast("int")).alias("median"))


def detected(rows: DataFrame, before: Column, after: Column, latency_ms: Column, most_ms: float = 2_000.0, least_move: float = 0.02, least_confidence: float = 0.6) -> DataFrame:
    """Rows whose price moved enough, soon enough: price_move_pct, confidence, actionable, alert."""
    move = F.abs(after - before) / before
    confidence = 0.6 * F.greatest(F.lit(0.0), 1 - latency_ms / most_ms) + 0.4 * F.least(F.lit(1.0), move / (2 * least_move))
    found = rows.where((before > 0) & (after > 0) & (latency_ms <= most_ms)).withColumns({"price_move_pct": move, "confidence": confidence})
    found = found.where((F.col("price_move_pct") >= least_move) & (F.col("confidence") >= least_confidence))
    found = found.withColumn("actionable", latency_ms < most_ms * 0.5)
    return found.withColumn("alert", F.col("actionable") & (F.col("confidence") >= 0.7))


def ingestion_latency(events: DataFrame) -> DataFrame:
    return events.withColumn("ingestion_ms", (micros("ingestion_timestamp") - micros("event_timestamp")) / 1000.0)


def moving_average(values: Column, old: float = 0.9) -> Column:
    """Exponential average of an array in order, started by its first value and again after a zero."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: F.when(acc == 0, x).otherwise(old * acc + (1 - old) * x))


def moving_averages(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, old: float = 0.9) -> DataFrame:
    """:func:`moving_average` of each key's values, none below zero, in ``order``: (keys, ema), without gathering them.

    A value counts (1 - old) * old ** k, k being the number of values after it; the first that isn't zero
    counts old ** (k + 1) more.
    """
    after = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])) - 1
    ranked = rows.select(*keys, F.col(value).cast("double").alias("_v"), after.alias("_k"))
    started = F.when(F.col("_v") != 0, F.col("_k"))
    first = F.max_by("_v", started) * F.pow(F.lit(old), F.max(started) + 1)
    weighted = F.sum((1 - old) * F.pow(F.lit(old), F.col("_k")) * F.col("_v"))
    return ranked.groupBy(*keys).agg((weighted + F.coalesce(first, F.lit(0.0))).alias("ema"))


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    by = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")
