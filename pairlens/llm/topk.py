"""Exact top-k inner products by no-random-access aggregation.

Vectors are quantised to integers.  Queries come in blocks and meet candidates in blocks;
in each cell every component has its list of candidates sorted by value.  A query reads
all lists in step, from the end that its component's sign favours.  What has been read of a
candidate bounds its score: the sum so far, less or more at most the product of the lengths
of the unread parts of both vectors (the candidates' lengths are known).  A candidate that no
list has shown yet is also bounded by the sum of the lists' frontiers.  Reading stops when
no outsider can reach the k-th lower bound and the candidates that still can are fewer than
those a list would show in one more round; they get their final scores, and cells are merged
by rank.  Bounds are rounded outwards, so the result is exact.

Blocks are bounded in bytes: their rows shrink as vectors grow.

Defined results: a vector that is null, holds a null or a non-finite component takes no
part, nor does one without an id; vectors meet those of the same length only; rows that share
an id are rows of their own, as queries and as candidates; equal scores go to the smaller id;
scores are 64-bit integers, so components must stay below 2**25 in size; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.common import partitions, saved

SCALE = 1024
K = 10
#: Bytes of the vectors of a block of queries and of candidates; sorted lists take three times as much.
QUERY_BYTES, CANDIDATE_BYTES = 1 << 18, 1 << 22
#: Rounds in which a list would be read to its end.
ROUNDS = 32


def quantised(vector: Column) -> Column:
    """Integers floor(SCALE * x); null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


class SortedLists:
    """The candidates of a cell, sorted by each component; ``read`` and ``resolved`` count list entries and final scores."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.place = {row: at for at, row in enumerate(rows[order].tolist())}
        self.squares = (self.vectors * self.vectors).sum(1)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.read = self.resolved = 0

    def top(self, query_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` but the query's own row, in order."""
        n, lists = len(self.ids), np.flatnonzero(query)
        rival = np.ones(n, bool)
        if query_row in self.place:
            rival[self.place[query_row]] = False
        open_ = rival
        if rival.sum() > k and len(lists):
            weights = query[lists].astype(float)
            rising, falling = weights < 0, weights > 0
            total, squares = float((weights * weights).sum()), self.squares.astype(float)
            lengths = np.sqrt(total * squares)
            # Sums of floats stay within this share of the product of the lengths.
            error = 1e-12 + 1e-15 * len(lists)
            summed, unread_query, unread, outside = np.zeros(n), np.full(n, total), squares.copy(), np.ones(n, bool)
            step = max(1, -(-n // ROUNDS))
            for depth in range(0, n, step):
                end = min(n, depth + step)
                # One pass over what the lists show in this round, those read from their end turned round.
                low, high = (lists[rising], slice(depth, end)), (lists[falling], slice(n - end, n - depth))
                rows = np.concatenate([self.order[low], self.order[high][:, ::-1]]).ravel()
                values = np.concatenate([self.values[low], self.values[high][:, ::-1]]).astype(float)
                w = np.concatenate([weights[rising], weights[falling]])[:, None]
                gains = w * values
                summed += np.bincount(rows, gains.ravel(), n)
                unread_query -= np.bincount(rows, np.broadcast_to(w * w, gains.shape).ravel(), n)
                unread -= np.bincount(rows, (values * values).ravel(), n)
                outside[rows] = False
                frontier, size = gains[:, -1].sum(), np.abs(gains[:, -1]).sum()
                self.read += (end - depth) * len(lists)
                far = np.sqrt((np.maximum(unread_query, 0) + error * total) * (np.maximum(unread, 0) + error * squares)) + 1 + error * lengths
                upper = summed + far
                upper[outside] = np.minimum(upper[outside], frontier + 1 + error * size)
                reached = np.partition((summed - far)[rival], -k)[-k]
                open_ = rival & (upper >= reached)
                if not (open_ & outside).any() and open_.sum() <= max(k, step):
                    break
        left = np.flatnonzero(open_)
        self.resolved += len(left)
        scores = self.vectors[left] @ query
        best = np.lexsort((left, -scores))[:k]
        return self.ids[left[best]], scores[best]


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row that ``queries`` selects.

    ``queries`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    one = vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector_column)).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    # Numbers of rows are fixed by the write.
    rows = saved(one.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asked = rows.where(queries)
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_bytes = 8 * max(1, width)
    candidate_blocks = max(partitions(spark), -(-count * row_bytes // CANDIDATE_BYTES))
    query_blocks = -(-asked.count() * row_bytes // QUERY_BYTES)

    def block(blocks: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(max(1, blocks)).cast("long"))

    def each(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long")))

    def cell(q: Column, c: Column) -> Column:
        return (q * candidate_blocks + c).alias("cell")

    left = asked.withColumn("q", block(query_blocks, 1)).withColumn("c", each(candidate_blocks))
    right = rows.withColumn("c", block(candidate_blocks, 2)).withColumn("q", each(query_blocks))

    def search(queries_: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        for width, asked_ids, asked_rows, asked_vectors in _by_width(queries_):
            for other, ids, numbers, vectors_ in _by_width(candidates):
                if other != width:
                    continue
                lists = SortedLists(ids, numbers, vectors_)
                for query_id, row, query in zip(asked_ids.tolist(), asked_rows.tolist(), asked_vectors, strict=True):
                    best, scores = lists.top(row, query, k)
                    found.append((np.full(len(best), query_id, np.int64), np.full(len(best), row, np.int64), best, scores))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), columns, strict=True)))

    columns = [cell(F.col("q"), F.col("c")), "vec_id", "row", "v"]
    grid = left.select(*columns).groupBy("cell").cogroup(right.select(*columns).groupBy("cell"))
    best = W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (
        grid.applyInArrow(search, "query_id long, row long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _by_width(rows: pa.Table):
    """(length, ids, numbers of rows, vectors) for each length of vector among ``rows``."""
    if not rows.num_rows:
        return
    lists = rows["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    for width in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == width)
        yield width, ids[own], numbers[own], flat[starts[own][:, None] + np.arange(width)].astype(np.int64).reshape(len(own), width)
