"""First-seen and time-to-live deduplication, fan-in of sources."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.functions.text import micros


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row a key and partition."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(rows.columns)


def ttl_dedup(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = (), ttl_seconds: float | None = 3600) -> DataFrame:
    """Rows that come more than the time to live after the last row kept of their key; without one, the first.

    A kept row starts the clock and later ones never restart it, so this is a fold.  Rows are
    read in sorted batches with the last kept time alone as state, whatever a key's size; from a
    kept row a search leads to the next one, so the rows between cost nothing.  A row without a
    time is kept and starts no clock.
    """
    if not ttl_seconds:
        return first_seen(rows, keys, [ts, *order])
    limit = int(ttl_seconds * 1_000_000)
    # One key column: equal keys meet, and null parts equal each other.
    key = F.to_json(F.struct(*keys))
    sorted_ = rows.withColumns({"_key": key, "_us": micros(ts)}).repartition("_key").sortWithinPartitions("_key", "_us", *order)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, kept_at = None, None
        for batch in batches:
            mask = np.zeros(batch.num_rows, bool)
            if batch.num_rows:
                parts = pc.run_end_encode(batch["_key"])
                times, known = batch["_us"].fill_null(0).to_numpy().tolist(), batch["_us"].is_valid().to_numpy(zero_copy_only=False)
                at = 0
                for key_here, end in zip(parts.values.to_pylist(), parts.run_ends.to_pylist(), strict=True):
                    if key_here != key_now:
                        key_now, kept_at = key_here, None
                    while at < end and not known[at]:
                        mask[at] = True
                        at += 1
                    if kept_at is not None:
                        at = bisect_right(times, kept_at + limit, at, end)
                    while at < end:
                        mask[at], kept_at = True, times[at]
                        at = bisect_right(times, kept_at + limit, at, end)
                    at = end
            yield batch.filter(pa.array(mask)).drop_columns(["_key", "_us"])

    return sorted_.mapInArrow(keep, rows.schema)


def fan_in(*sources: DataFrame) -> DataFrame:
    """All sources by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key."""
    by = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def changed_markets(updates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct markets of the tokens that changed."""
    return updates.join(tokens, "token_id").select("venue_market_id").distinct()
