"""Deduplication with a time to live for keys of any size.

A row is kept if it comes more than the time to live after the last one kept, so whether it is depends on all
rows before it.  Here a key's time line is cut into slices that are worked on side by side.  After a gap
longer than the time to live a row is kept for certain, and from there on every later one is known by jumps; so a
slice with such a gap tells the next one where it begins.  Slices without a gap hand on what each
possible beginning leads to, and these jumps are composed with themselves, doubling their reach, until
none is left.  Only distinct times travel, and one key runs in as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.folders import written
from pairlens.functions.text import micros
from pairlens.operators import dedup

#: Distinct times that a group of slices holds on average, at most.
GROUP_ROWS = 1 << 16


class Line:
    """The times of a group in order: by unit (a key's slice) and time, with the first time behind each one's time to live."""

    def __init__(self, keys: np.ndarray, slices: np.ndarray, at: np.ndarray, ttl: int, width: int):
        names, rank = np.unique(slices, return_inverse=True)
        self.order = np.lexsort((at, rank, keys))
        self.key, self.slice, self.at = keys[self.order], slices[self.order], at[self.order]
        unit = keys[self.order] * max(1, len(names)) + rank[self.order]
        n = len(unit)
        first = np.append(True, unit[1:] != unit[:-1])[:n]
        step = np.diff(self.at, prepend=self.at[:1])
        #: Kept for certain: nothing within the time to live before it.
        self.sure = first | (step > ttl)
        clock = np.cumsum(np.where(self.sure, ttl + 1, step))
        self.next = np.searchsorted(clock, clock + ttl, "right")
        begin = np.flatnonzero(first)
        self.end = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))
        own = np.flatnonzero(np.floor_divide(self.at, width) == self.slice)
        units, at_ = np.unique(unit[own], return_index=True)
        #: Of each unit with times of its own: their first row and the one behind their last.
        self.low, self.high = own[at_], (own[np.append(at_[1:], len(own)) - 1] + 1 if len(own) else own)

    def chain(self, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """What is kept below ``stop`` from ``start`` on, step by step, then where each chain ends."""
        passed, at = [], start.copy()
        while (inside := at < stop).any():
            passed.append(at[inside])
            at[inside] = self.next[at[inside]]
        return [*passed, at]


def _lines(group: pa.Table, ttl: int, width: int) -> tuple[Line, pa.Array]:
    codes = pa.chunked_array(group["_key"]).combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return Line(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), group["slice"].to_numpy(), group["at"].to_numpy(), ttl, width), codes.dictionary


_HEADS = "kind int, _key string, slice long, at long, to long"


def _heads(group: pa.Table, ttl: int, width: int) -> pa.Table:
    """kind 0: a time that is kept first in its slice for certain; 1: the first certain one behind a slice's head; 2: a time
    that may be kept first (at) and the one that it leads to in the next slice (to)."""
    line, names = _lines(group, ttl, width)
    out = []

    def put(kind: int, rows: np.ndarray, slices: np.ndarray, at: np.ndarray, to: np.ndarray | None = None) -> None:
        named = names.take(pa.array(line.key[rows]))
        out.append(pa.table([pa.array(np.full(len(rows), kind, np.int32)), named, pa.array(slices), pa.array(line.at[at]), pa.nulls(len(rows), pa.int64()) if to is None else pa.array(line.at[to])], names=["kind", "_key", "slice", "at", "to"]))

    low, high = line.low, line.high
    head = low[line.sure[low]]
    put(0, head, line.slice[head], head)
    sure = np.append(np.flatnonzero(line.sure), len(line.sure))
    first, last = sure[np.searchsorted(sure, low)], sure[np.maximum(np.searchsorted(sure, high) - 1, 0)]
    known = first < high
    put(1, low[known], line.slice[low[known]], first[known])
    ends = line.chain(last[known], high[known])[-1]
    ahead = ends < line.end[low[known]]
    put(0, low[known][ahead], line.slice[low[known][ahead]] + 1, ends[ahead])
    # Without a certain one, any time up to the first beyond the head's reach may be kept first.
    low, high = low[~known], high[~known]
    reach = [np.arange(a, min(b, a + np.searchsorted(line.at[a:b], k * width + ttl) + 1)) for a, b, k in zip(low, high, line.slice[low], strict=True)]
    start = np.concatenate(reach) if reach else low
    unit = np.repeat(np.arange(len(low)), [len(r) for r in reach])
    to = line.chain(start, high[unit])[-1]
    ahead = to < line.end[low[unit]]
    put(2, start[ahead], line.slice[start[ahead]] + 1, start[ahead], to[ahead])
    return pa.concat_tables(out).combine_chunks()


def _kept(times: pa.Table, starts: pa.Table, ttl: int, width: int) -> pa.Table:
    """The times kept in each slice from its first one on."""
    if not times.num_rows or not starts.num_rows:
        return pa.table({"_key": pa.array([], pa.string()), "at": pa.array([], pa.int64())})
    line, names = _lines(times, ttl, width)
    first = set(zip(starts["_key"].to_pylist(), starts["slice"].to_pylist(), starts["at"].to_pylist(), strict=True))
    keys = names.to_pylist()
    begin, stop = [], []
    for low, high in zip(line.low.tolist(), line.high.tolist(), strict=True):
        # A first time lies within the reach of the slice's head or is a certain one.
        found = [i for i in range(low, high) if (keys[line.key[i]], int(line.slice[i]), int(line.at[i])) in first]
        if found:
            begin.append(found[0])
            stop.append(high)
    if not begin:
        return pa.table({"_key": pa.array([], pa.string()), "at": pa.array([], pa.int64())})
    rows = np.concatenate(line.chain(np.array(begin), np.array(stop))[:-1])
    return pa.table({"_key": names.take(pa.array(line.key[rows])), "at": pa.array(line.at[rows])})


def _reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(_key, slice, at): ``roots`` (_key, slice, at) and all that ``edges`` (_key, at, slice, to) reach from them."""
    found = roots
    jumps = written(edges, "ttl-jumps")
    starts = written(roots.select("_key", "at").join(jumps.select("_key", "at"), ["_key", "at"], "left_semi").distinct(), "ttl-starts")
    while not starts.isEmpty() and not jumps.isEmpty():
        new = written(starts.join(jumps, ["_key", "at"]).select("_key", "slice", F.col("to").alias("at")).distinct(), "ttl-reached")
        found = found.union(new)
        starts = written(starts.union(new.select("_key", "at")).distinct(), "ttl-starts")
        twice = jumps.select("_key", F.col("at").alias("from"), F.col("to").alias("at")).join(jumps, ["_key", "at"])
        jumps = written(twice.select("_key", F.col("from").alias("at"), "slice", "to"), "ttl-jumps")
    return found


def kept_times(times: DataFrame, ttl: int, slices: int = 16) -> DataFrame:
    """The times (_key, at) that are more than ``ttl`` microseconds after the last one kept of their key.

    A slice is ``slices`` times as long as the time to live, three times at least.
    """
    width = max(3, slices) * ttl
    times = written(times.select("_key", "at").distinct(), "ttl-times")
    groups = max(2 * int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")), times.count() // GROUP_ROWS + 1)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("g", F.pmod(F.xxhash64("_key", "slice"), F.lit(groups)))

    into = F.expr(f"pmod(at, {width}L)")
    own = F.expr(f"(at - pmod(at, {width}L)) div {width}L")
    # A slice also sees what follows within two times to live, and what comes one before it.
    where = F.array_compact(F.array(own, F.when(into < 2 * ttl + 1, own - 1), F.when(into >= width - ttl, own + 1)))
    around = dealt(times.withColumn("slice", F.explode(where)))
    heads = written(around.groupBy("g").applyInArrow(lambda t: _heads(t, ttl, width), _HEADS), "ttl-heads")
    sure = _reached(heads.where("kind = 2").select("_key", "at", "slice", "to"), heads.where("kind = 0").select("_key", "slice", "at"))
    least = [F.min(F.when(F.col("kind") == kind, F.col("at"))) for kind in (0, 1)]
    known = sure.withColumn("kind", F.lit(0)).union(heads.where("kind = 1").select("_key", "slice", "at", "kind"))
    starts = known.groupBy("_key", "slice").agg(F.coalesce(*least).alias("at"))
    right = dealt(written(starts, "ttl-firsts"))
    return around.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(lambda a, b: _kept(a, b, ttl, width), "_key string, at long")


def ttl_dedup(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = (), ttl_seconds: float = 3600, slices: int = 16) -> DataFrame:
    """The rows of :func:`pairlens.operators.dedup.ttl_dedup`, with one key in many tasks.

    Of rows at a time that is kept the first in ``order`` stays; a row without a time is kept and starts no clock.
    """
    ttl = int(ttl_seconds * 1_000_000)
    if ttl <= 0:
        raise ValueError("without a time to live the first row of a key stays: use first_seen")
    keyed = rows.withColumns({"_key": F.to_json(F.struct(*keys)), "_us": micros(ts)})
    known = keyed.where("_us IS NOT NULL")
    kept = kept_times(known.select("_key", F.col("_us").alias("at")), ttl, slices).withColumnsRenamed({"at": "_us"})
    # Rows at one time: partial aggregation keeps one a partition.
    firsts = dedup.first_seen(known.join(kept, ["_key", "_us"], "left_semi").select(known.columns), ["_key", "_us"], order or [ts])
    return firsts.unionByName(keyed.where("_us IS NULL")).select(rows.columns)
