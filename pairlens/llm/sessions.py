"""Sessions of clicks, split at final clicks, at gaps and at a greatest length.

A client's time line is cut into slices, and a group holds many slices of many clients, so a
client with a third of all clicks is dealt out like the others.  A session ends for certain at
a hard break (the click before is final, or a gap lies between); only the greatest length makes
a start depend on the start before it.  So a first pass finds, for each slice, its first start:
certain where its head is a hard break or where the slice before has one, else reached from
such a start by chains of starts across slices without a hard break, followed by doubling.
The second pass cogroups the timely clicks of each slice with its late ones: numpy jumps from
start to start, to the first click beyond start + longest or to the next hard break, and late
clicks find their session by binary search.

Defined results: clicks without id, client or time take no part; of rows that share an id the
least by time, arrival (null first), client, final and value counts; a null arrival is timely; a null
kind or value makes no click final; a value that is null, not finite or beyond 2**62 hundredths adds
nothing; ties in time go by id; late clicks before a client's first session, or of a client
without timely clicks, join none; an empty table gives no rows; other columns are ignored.
A group holds whole slices of a client (at least longest + gap), so what one client does
within a slice must fit into a task's memory, as its path must.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import partitions, power_of_two, saved

MINUTE = 60_000_000
#: Clicks that a group of slices holds on average, at most.
GROUP_ROWS = 65_536
#: Stands behind every time, so that a late click comes after the last start of its slice.
AFTER = (1 << 63) - 1


@dataclass(frozen=True)
class Rules:
    """When a session ends, in microseconds; ``slice_`` is the width that time lines are cut to."""

    gap: int = 10 * MINUTE
    longest: int = 40 * MINUTE
    lateness: int = 360 * MINUTE
    slice_: int = 360 * MINUTE

    def __post_init__(self) -> None:
        if not 0 < self.gap or not 0 <= self.longest or self.slice_ < self.gap + self.longest:
            raise ValueError("a slice must be as long as a gap and a session together")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is read as UTC."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(F.col(f"`{name}`"))
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name}` AS TIMESTAMP_NTZ))")


def error_of_60(kind: Column, value: Column) -> Column:
    return (kind == "error") & (value >= 60)


def cents(value: Column) -> Column:
    scaled = 100 * value.cast("double") + F.lit(0.5)
    return F.when(F.abs(scaled) < float(1 << 62), F.floor(scaled)).otherwise(0)


def narrowed(clicks: DataFrame, rules: Rules, final: Column | None = None) -> DataFrame:
    """(id, client, at, late, final, cents), one row per click id."""
    last = error_of_60(F.col("kind"), F.col("value")) if final is None else final
    at, arrived = micros(clicks, "ts"), micros(clicks, "arrived_at")
    rows = clicks.where(F.col("click_id").isNotNull() & F.col("client_id").isNotNull() & F.col("ts").isNotNull())
    first = F.struct(at.alias("at"), arrived.alias("arrived"), F.col("client_id").cast("long").alias("client"), F.coalesce(last, F.lit(False)).alias("final"), cents(F.col("value")).alias("cents"))
    once = rows.groupBy(F.col("click_id").cast("long").alias("id")).agg(F.min(first).alias("c")).select("id", "c.*")
    late = F.coalesce(F.col("arrived") - F.col("at") > rules.lateness, F.lit(False))
    return once.select("id", "client", "at", late.alias("late"), "final", "cents")


def slice_of(at: str, rules: Rules) -> Column:
    return F.expr(f"({at} - pmod({at}, {rules.slice_}L)) div {rules.slice_}L")


def dealt(rows: DataFrame, groups: int) -> DataFrame:
    """``rows`` with the group that their slice belongs to."""
    return rows.withColumn("g", F.pmod(F.xxhash64("client", "slice"), F.lit(groups)))


def around(timely: DataFrame, rules: Rules) -> DataFrame:
    """Each click in its slice, in the one before if that one's last session may hold or see it, and in the one after if its head must see it."""
    into = F.pmod(F.col("at"), F.lit(rules.slice_))
    own = slice_of("at", rules)
    where = F.array(
        own,
        F.when(into < rules.gap + rules.longest, own - 1),
        F.when(into > rules.slice_ - rules.gap, own + 1),
    )
    return timely.withColumn("slice", F.explode(F.array_compact(where)))


class Line:
    """The clicks of a group in order: by unit (a client's slice), time and id."""

    def __init__(self, unit: np.ndarray, slice_: np.ndarray, at: np.ndarray, id_: np.ndarray, final: np.ndarray, rules: Rules):
        self.order = np.lexsort((id_, at, unit))
        self.unit, self.slice, self.at, self.id, self.final = (x[self.order] for x in (unit, slice_, at, id_, final))
        n = len(self.unit)
        self.first = np.append(True, self.unit[1:] != self.unit[:-1])[:n]
        step = np.diff(self.at, prepend=self.at[:1])
        self.gap = ~self.first & (step >= rules.gap)
        self.after_final = ~self.first & np.append(False, self.final[:-1])[:n]
        self.hard = self.first | self.gap | self.after_final
        # Time that runs on within a stretch and leaps over a session's length at a hard break.
        clock = np.cumsum(np.where(self.hard, rules.longest + 1, step))
        self.next = np.searchsorted(clock, clock + rules.longest, "right")
        begin = np.flatnonzero(self.first)
        self.end = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n))) if n else begin
        self.place = np.floor_divide(self.at, rules.slice_) - self.slice
        self.own = self.place == 0

    def chain(self, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """All positions below ``stop`` on the chains from ``start``, step by step, then where each chain ends."""
        passed, at = [], start.copy()
        while (inside := at < stop).any():
            passed.append(at[inside])
            at[inside] = self.next[at[inside]]
        return [*passed, at]


_HEADS = "kind int, client long, slice long, last long, id long, at long, to long, to_at long"


def _heads(group: pa.Table, rules: Rules) -> pa.Table:
    """Of each slice: its last time, what is certain of first starts, and the chains across it.

    kind 0: the slice's last time, with its first start if its head is a hard break; 1: the first
    hard break behind its head; 2: a first start that the slice before makes certain; 3: a start
    that is possible (id) and the one it leads to in the next slice (to).
    """
    col = {c: group[c].to_numpy() for c in ("client", "slice", "at", "id", "final")}
    clients, c = np.unique(col["client"], return_inverse=True)
    slices, s = np.unique(col["slice"], return_inverse=True)
    line = Line(c * len(slices) + s, col["slice"], col["at"], col["id"], col["final"].astype(bool), rules)
    rows = np.flatnonzero(line.own)
    units, low = np.unique(line.unit[rows], return_index=True)
    low, high = rows[low], rows[np.append(low[1:], len(rows)) - 1] + 1 if len(rows) else rows
    client, slice_ = clients[units // len(slices)], slices[units % len(slices)]
    out = []

    def put(kind: int, which: np.ndarray, shift: int = 0, last: np.ndarray | None = None, at: np.ndarray | None = None, to: np.ndarray | None = None) -> None:
        def seen(values: np.ndarray, index: np.ndarray | None) -> pa.Array:
            return pa.nulls(len(which), pa.int64()) if index is None else pa.array(values[np.maximum(index, 0)], pa.int64(), mask=index < 0)

        out.append(pa.table([pa.array(np.full(len(which), kind, np.int32)), pa.array(client[which]), pa.array(slice_[which] + shift), pa.nulls(len(which), pa.int64()) if last is None else pa.array(last), seen(line.id, at), seen(line.at, at), seen(line.id, to), seen(line.at, to)], names=["kind", "client", "slice", "last", "id", "at", "to", "to_at"]))

    every = np.arange(len(units))
    put(0, every, last=line.at[high - 1], at=np.where(line.hard[low], low, -1))
    # The breaks of each unit's own rows: first, last.
    breaks = np.append(np.flatnonzero(line.hard), len(line.hard))
    first = breaks[np.searchsorted(breaks, low)]
    last = breaks[np.maximum(np.searchsorted(breaks, high) - 1, 0)]
    broken = first < high
    put(1, every[broken], at=first[broken])
    reached = line.chain(last[broken], high[broken])[-1]
    ahead = reached < line.end[high[broken] - 1]
    put(2, every[broken][ahead], shift=1, at=reached[ahead])
    # Without a break, any click up to the first beyond the head's reach may be a start.
    open_ = np.flatnonzero(~broken)
    reach = [np.arange(a, min(b, a + np.searchsorted(line.at[a:b], k * rules.slice_ + rules.longest) + 1)) for a, b, k in zip(low[open_], high[open_], slice_[open_], strict=True)]
    start = np.concatenate(reach) if reach else low[:0]
    which = np.repeat(open_, [len(r) for r in reach]) if reach else open_
    to = line.chain(start, high[which])[-1]
    ahead = to < line.end[high[which] - 1]
    put(3, which[ahead], shift=1, at=start[ahead], to=to[ahead])
    return pa.concat_tables(out).combine_chunks()


def reached_by(edges: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Tables (client, slice, id, at) of all that ``edges`` reach from ``roots`` (id), by doubling the jumps."""
    jumps = saved(edges.select("id", F.struct("client", "slice", F.col("to").alias("id"), F.col("to_at").alias("at")).alias("t")), "session-jumps")
    starts, parts = saved(roots.select("id").join(jumps.select("id"), "id", "left_semi"), "session-roots"), []
    while not starts.isEmpty() and not jumps.isEmpty():
        parts.append(saved(starts.join(jumps, "id").select("t.*").distinct(), "session-reached"))
        starts = saved(starts.union(parts[-1].select("id")).distinct(), "session-roots")
        twice = jumps.select(F.col("id").alias("from"), F.col("t.id").alias("id")).join(jumps, "id")
        jumps = saved(twice.select(F.col("from").alias("id"), "t"), "session-jumps")
    return parts


_SESSIONS = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path string"


def _sessions(timely: pd.DataFrame, other: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """The sessions that start in the slices of a group; ``other`` holds late clicks (n) and first starts (id)."""
    if not len(timely) or not len(other):
        return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in _SESSIONS.split(", ")})
    n = len(timely)
    both = {c: np.concatenate([timely[c].to_numpy(np.int64), other[c].to_numpy(np.int64)]) for c in ("client", "slice")}
    clients, c = np.unique(both["client"], return_inverse=True)
    slices, s = np.unique(both["slice"], return_inverse=True)
    unit = c * len(slices) + s
    line = Line(unit[:n], both["slice"][:n], *(timely[x].to_numpy() for x in ("at", "id", "final")), rules)
    entry = other["n"].to_numpy(np.int64) == 0
    units, first_at, first_id, last = (x[entry] for x in (unit[n:], *(other[x].to_numpy(np.int64) for x in ("at", "id", "last"))))
    order = np.argsort(units, kind="stable")
    units, first_at, first_id, last = units[order], first_at[order], first_id[order], last[order]
    # Where each first start stands in the line.
    place = {key: i for i, key in enumerate(zip(line.unit.tolist(), line.id.tolist(), strict=True))} if len(units) else {}
    begin = np.array([place[k] for k in zip(units.tolist(), first_id.tolist(), strict=True)], np.int64)
    own = np.flatnonzero(line.own)
    stop = own[np.searchsorted(line.unit[own], units, "right") - 1] + 1 if len(units) else units
    start = np.sort(np.concatenate(line.chain(begin, stop)[:-1])) if len(units) else begin
    u = line.unit[start]
    end = np.minimum(line.next[start], line.end[start])
    seen = end < line.end[start]
    nxt = np.minimum(end, n - 1)
    more = line.at[end - 1] < last[np.searchsorted(units, u)]
    why = np.select([line.final[end - 1], seen & line.gap[nxt], seen, more], ["end", "gap", "length", "gap"], "none")
    # Late clicks: the last start of their unit at or before them.
    late = ~entry
    late_unit, late_at, weight = unit[n:][late], other["at"].to_numpy(np.int64)[late], other["n"].to_numpy(np.int64)[late]
    times, rank = np.unique(np.concatenate([line.at[start], late_at]), return_inverse=True)
    key = np.concatenate([u, late_unit]) * len(times) + rank
    joined = np.searchsorted(key[: len(start)], key[len(start) :], "right") - 1
    fits = (joined >= 0) & (u[np.maximum(joined, 0)] == late_unit) if len(start) else np.zeros(len(late_at), bool)
    n_late = np.zeros(len(start), np.int64)
    np.add.at(n_late, joined[fits], weight[fits])
    total = np.append(0, np.cumsum(timely["cents"].to_numpy(np.int64)[line.order]))
    names = list(map(str, line.id.tolist()))
    return pd.DataFrame(
        {
            "client_id": clients[u // len(slices)],
            "session_id": line.id[start],
            "start_us": line.at[start],
            "end_us": line.at[end - 1],
            "n_clicks": end - start,
            "n_late": n_late,
            "value_cents": total[end] - total[start],
            "closed_by": pd.Series(why, dtype=object),
            "path": pd.Series([",".join(names[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=object),
        }
    )


def first_starts(timely: DataFrame, rules: Rules, groups: int) -> DataFrame:
    """(client, slice, last, at, id): the last time of each slice with timely clicks, and its first start, null if it has none."""
    lines = dealt(around(timely.select("client", "at", "id", "final"), rules), groups)
    heads = saved(lines.groupBy("g").applyInArrow(lambda t: _heads(t, rules), _HEADS), "session-heads")
    known = heads.where((F.col("kind") == 0) | (F.col("kind") == 2)).where(F.col("id").isNotNull()).select("client", "slice", "id", "at")
    edges = heads.where("kind = 3")
    if not edges.isEmpty():
        known = reduce(DataFrame.union, reached_by(edges, known), known)
    first = F.struct("at", "id")
    rows = heads.where("kind < 2").select("client", "slice", "last", F.when(F.col("kind") == 1, first).alias("break"), F.lit(None).cast("struct<at:bigint,id:bigint>").alias("sure"))
    sure = known.select("client", "slice", F.lit(None).cast("long").alias("last"), F.lit(None).cast("struct<at:bigint,id:bigint>").alias("break"), first.alias("sure"))
    found = rows.union(sure).groupBy("client", "slice").agg(F.max("last").alias("last"), F.coalesce(F.min("sure"), F.min("break")).alias("first"))
    return found.select("client", "slice", "last", "first.at", "first.id")


def sessions(clicks: DataFrame, rules: Rules | None = None, final: Column | None = None) -> DataFrame:
    """One row per session of ``clicks`` (click_id, ts, arrived_at, client_id, kind, value), with its path of click ids.

    ``final`` says which clicks end a session at once; by default errors with a value of 60 or more.
    """
    rules = rules or Rules()
    rows = saved(narrowed(clicks, rules, final), "session-clicks")
    groups = power_of_two(max(2 * partitions(clicks.sparkSession), rows.count() // GROUP_ROWS))
    timely = rows.where("NOT late").drop("late")
    # Late clicks count by time: however many share one, a row goes on.
    late = rows.where("late").withColumn("slice", slice_of("at", rules)).groupBy("client", "slice", "at").agg(F.count("*").alias("n"))
    heads = first_starts(timely, rules, groups)
    none = F.lit(None).cast("long")
    # A client's slices, one row each: the last time of all, and the nearest slice before that has a start.
    line = W.partitionBy("client").orderBy("slice")
    units = saved(
        heads.union(late.select("client", "slice", none, none, none).distinct())
        .groupBy("client", "slice")
        .agg(F.max("last").alias("last"), F.max("at").alias("first"), F.max("id").alias("id"))
        .withColumns(
            {
                "last": F.max("last").over(W.partitionBy("client")),
                "before": F.last(F.when(F.col("id").isNotNull(), F.col("slice")), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)),
            }
        ),
        "session-units",
    )
    here = F.coalesce(F.col("at") >= F.col("first"), F.lit(False))
    placed = (
        late.join(units.select("client", "slice", "first", "before"), ["client", "slice"])
        .select("client", F.when(here, F.col("slice")).otherwise(F.col("before")).alias("slice"), F.when(here, F.col("at")).otherwise(F.lit(AFTER)).alias("at"), "n")
        .where("slice IS NOT NULL")
        .groupBy("client", "slice", "at")
        .agg(F.sum("n").alias("n"))
    )
    zero = F.lit(0).cast("long")
    other = placed.select("client", "slice", "at", "n", zero.alias("id"), zero.alias("last")).union(
        units.where("id IS NOT NULL").select("client", "slice", F.col("first"), zero, "id", "last")
    )
    left, right = dealt(around(timely, rules), groups), dealt(saved(other, "session-late"), groups)
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(lambda a, b: _sessions(a, b, rules), _SESSIONS)
