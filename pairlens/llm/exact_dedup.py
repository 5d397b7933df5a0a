"""Exact deduplication with counting quotient filters.

Every partition inserts the 64-bit fingerprints of its texts into a counting quotient
filter (quotients are implied by position, remainders are stored, copies are counters).
Filters are cut into ranges of quotients and merged range by range, which loses nothing
since both sides list their remainders in order.  Only fingerprints whose merged count
exceeds one send their documents on to the comparison of whole texts.

Defined results: a null text counts as empty; empty texts equal each other; a repeated
doc_id is judged row by row and each row returned; among equal doc_ids that hold the kept
text every such row is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import SPACE, fresh, if_small, partitions, power_of_two, saved

#: Fingerprints that a merged range of quotients holds on average, at most.
RANGE_ROWS = 32_768


class CountingQuotientFilter:
    """A filter over ``bits``-bit fingerprints with ``2**q`` home slots.

    ``remainders`` and ``counters`` lie in slots; ``occupied`` marks the quotients in use
    and ``run_end`` the slot where a quotient's run ends, as in a rank-and-select filter.
    """

    def __init__(self, q: int, bits: int, occupied: np.ndarray, run_end: np.ndarray, used: np.ndarray, remainders: np.ndarray, counters: np.ndarray):
        self.q, self.bits = q, bits
        self.occupied, self.run_end, self.used = occupied, run_end, used
        self.remainders, self.counters = remainders, counters

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints and their counts."""
        n = len(prints)
        q = max(1, min(bits - 1, int(max(1, n) * 4 // 3).bit_length()))
        r = np.uint64(bits - q)
        quotients = (prints >> r).astype(np.int64)
        # A run starts at its home slot or right behind the run before it.
        index = np.arange(n)
        slots = np.maximum.accumulate(quotients - index) + index if n else index
        size = max(1 << q, int(slots[-1]) + 1 if n else 0)
        occupied, used, run_end = (np.zeros(size, bool) for _ in range(3))
        remainders, counters = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[quotients], used[slots] = True, True
        if n:
            run_end[slots[np.append(quotients[1:] != quotients[:-1], True)]] = True
        remainders[slots] = prints & ((np.uint64(1) << r) - np.uint64(1))
        counters[slots] = counts
        return cls(q, bits, occupied, run_end, used, remainders, counters)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, with counts: the k-th run belongs to the k-th quotient in use."""
        slots = np.flatnonzero(self.used)
        run = np.concatenate([[0], np.cumsum(self.run_end[slots])[:-1]]).astype(np.int64) if len(slots) else slots
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotients << np.uint64(self.bits - self.q)) | self.remainders[slots], self.counters[slots]

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.items(), other.items()
        both, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = np.zeros(len(both), np.int64)
        np.add.at(counts, index, np.concatenate([m, n]))
        return CountingQuotientFilter.build(both, counts, self.bits)


def merged(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter | None:
    """One filter of all: merges those of like size, so each entry is copied a logarithmic number of times."""
    stack: list[CountingQuotientFilter] = []
    for new in filters:
        stack.append(new)
        while len(stack) > 1 and len(stack[-2].used) <= 2 * len(stack[-1].used):
            new = stack.pop()
            stack[-1] = stack[-1].merge(new)
    while len(stack) > 1:
        new = stack.pop()
        stack[-1] = stack[-1].merge(new)
    return stack[0] if stack else None


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def fingerprint(text: Column, bits: int = 64) -> Column:
    """The top ``bits`` bits of a 64-bit hash, as a long."""
    hashed = F.xxhash64(text)
    return hashed if bits == 64 else F.shiftrightunsigned(hashed, 64 - bits)


def repeated_fingerprints(prints: DataFrame, column: str, rows: int, bits: int = 64) -> DataFrame:
    """The distinct values of ``column`` that occur more than once, as column ``fp``.

    Partitions hand on quotient ranges of their filters, so a fingerprint costs one
    entry a partition however often it occurs.
    """
    ranges = power_of_two(max(2 * partitions(prints.sparkSession), rows // RANGE_ROWS))
    shift = np.uint64(bits - min(bits, ranges.bit_length() - 1))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inserted = (np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True) for b in batches if b.num_rows)
        filter_ = merged(CountingQuotientFilter.build(*x, bits) for x in inserted)
        if filter_ is None:
            return
        values, counts = filter_.items()
        homes = values >> shift if shift < 64 else np.zeros(len(values), np.uint64)
        starts = np.flatnonzero(np.append(True, homes[1:] != homes[:-1]))
        ends = np.append(starts[1:], len(values))
        for at in range(0, len(starts), 4096):
            part = range(at, min(at + 4096, len(starts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(homes[starts[part]].view(np.int64)),
                    pa.array([values[starts[i] : ends[i]].tobytes() for i in part], pa.binary()),
                    pa.array([counts[starts[i] : ends[i]].astype("<i8").tobytes() for i in part], pa.binary()),
                ],
                names=["home", "prints", "counts"],
            )

    def merge(group: pa.Table) -> pa.Table:
        parts = zip(group["prints"].to_pylist(), group["counts"].to_pylist(), strict=True)
        filter_ = merged(CountingQuotientFilter.build(np.frombuffer(p, np.uint64), np.frombuffer(c, "<i8"), bits) for p, c in parts)
        values, counts = filter_.items()
        return pa.table({"fp": pa.array(values[counts > 1].view(np.int64))})

    built = prints.select(column).mapInArrow(build, "home long, prints binary, counts binary")
    return built.groupBy("home").applyInArrow(merge, "fp long")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col(text_column))
    narrow = saved(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("norm")).select(
            "doc_id", fingerprint(F.col("norm"), bits).alias("fp"), F.sha2("norm", 256).alias("text_sha256")
        ),
        "dedup-prints",
    )
    repeated = saved(repeated_fingerprints(narrow, "fp", narrow.count(), bits), "dedup-repeated")
    routed = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("norm"))
        .withColumn("fp", fingerprint(F.col("norm"), bits))
        .join(if_small(repeated, repeated.count(), 8), "fp", "left_semi")
    )
    # Whole texts are the grouping key: rows fall together only if every byte agrees.
    equal = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = (
        equal.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("fp", "text_sha256")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
        .where(F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256 digest")).isNull())
        .drop("texts")
    )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return narrow.join(classes, ["fp", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with one row of each group of equal texts: the one with the smallest id."""
    judged = saved(exact_dedup(docs, id_column, text_column).select("doc_id", "text_sha256", "kept"), "dedup-judged")
    dropped = judged.where(~F.col("kept")).select("doc_id", "text_sha256")
    twice = saved(judged.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256"), "dedup-twice")
    # The caller's columns stay as they are, whatever their names.
    id_, digest = fresh(docs, "id", "digest")
    marked = docs.withColumns({id_: F.col(id_column).cast("long"), digest: F.sha2(normalised(F.col(text_column)), 256)})

    def named(rows: DataFrame) -> tuple[DataFrame, Column]:
        other = rows.toDF("other_doc_id", "other_text_sha256").alias("other")
        return other, F.col(id_).eqNullSafe(F.col("other.other_doc_id")) & (F.col(digest) == F.col("other.other_text_sha256"))

    rest = marked.join(*named(dropped), "left_anti")
    if not twice.isEmpty():
        # The same id and text more than once: such rows are told apart by nothing, any one stays.
        once = rest.join(*named(twice), "left_semi").dropDuplicates([id_, digest])
        rest = rest.join(*named(twice), "left_anti").unionByName(once)
    return rest.drop(id_, digest)
