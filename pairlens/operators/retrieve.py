"""Exact similarity retrieval across venues, in blocks of matrices.

Rows fall into blocks by hash; every query block meets every block of rows in a cell of a
grid, where one matrix product scores them and a partial selection keeps the best.  Blocks
are bounded in bytes, so a larger table means more cells, not larger ones; a row is sent twice
for each block, and vectors travel in the type they come in.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.config import Settings

#: Bytes of a block's vectors; a cell holds two blocks and 256 rows of scores.
BLOCK_BYTES, BLOCK_ROWS = 1 << 26, 1 << 16
#: Pairs whose exact scores are computed at once.
_EXACT = 1 << 14


def similar(rows: DataFrame, id_column: str, venue_column: str, vector_column: str, k: int | None = None, least: float | None = None, settings: Settings = Settings(), block_rows: int | None = None) -> DataFrame:
    """query_id, rank, candidate_id, similarity: the best ``k`` rows of other venues by cosine, from ``least`` on.

    Scores are rounded to six places; equal ones go to the smaller id.  Vectors that are
    null, hold a null or have no length match nothing.
    """
    k, least = settings.top_k if k is None else k, settings.least_similarity if least is None else least
    v = F.col(vector_column)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0)
    base = rows.where(usable).select(F.col(id_column).cast("long").alias("id"), F.col(venue_column).cast("string").alias("venue"), v.alias("v"))
    count, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # Small tables still give every core a cell.
    fewest = 1 if block_rows else math.isqrt(rows.sparkSession.sparkContext.defaultParallelism - 1) + 1
    block_rows = block_rows or min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, width))))
    blocks = max(fewest, -(-count // block_rows))

    def block(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks).cast("long"))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    cell = (F.col("q") * blocks + F.col("c")).alias("cell")
    queries = base.withColumn("q", block(1)).withColumn("c", every).select(cell, "id", "venue", "v")
    others = base.withColumn("c", block(2)).withColumn("q", every).select(cell, "id", "venue", "v")

    found = queries.groupBy("cell").cogroup(others.groupBy("cell")).applyInArrow(partial(best_of, k=k, least=least), "query_id long, candidate_id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "similarity")


def best_of(left: pa.Table, right: pa.Table, k: int, least: float) -> pa.Table:
    """The best ``k`` rows of ``right`` of another venue for each row of ``left``, from ``least`` and from the row's own ``last`` (if any) on.

    Products of single precision choose what may be among them, with a margin for their rounding; only that is scored exactly.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if left.num_rows and right.num_rows:
        (qi, qv, qm), (ci, cv, cm) = _matrix(left), _matrix(right)
        width = max(qm.shape[1], cm.shape[1])
        qm, cm = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (qm, cm))
        order = np.argsort(ci, kind="stable")
        ci, cv, cm = ci[order], cv[order], cm[order]
        venue = np.unique(np.concatenate([qv, cv]), return_inverse=True)[1].astype(np.int32)
        qv, cv = venue[: len(qv)], venue[len(qv) :]
        floor = np.full(len(qi), least)
        if "last" in left.column_names:
            floor = np.maximum(floor, left["last"].to_numpy())
        # Twice the largest error of a product of unit vectors in single precision, and the rounding of scores.
        margin = 2e-6 + 2.4e-7 * width
        rough, turned = qm.astype(np.float32), np.ascontiguousarray(cm.astype(np.float32).T)
        for at in range(0, len(qi), 256):
            part = slice(at, at + 256)
            s = rough[part] @ turned
            s[(qv[part][:, None] == cv) | (qi[part][:, None] == ci)] = -np.inf
            lowest = (floor[part] - margin)[:, None].astype(np.float32)
            open_ = (s >= lowest) & np.isfinite(s)
            # Where floors leave many, the k-th of all is asked for.
            if 0 < k < s.shape[1] and np.count_nonzero(open_) > 8 * k * len(s):
                open_ &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - np.float32(margin)
            r, c = np.nonzero(open_)
            exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", qm[part][r[a : a + _EXACT]], cm[c[a : a + _EXACT]]) for a in range(0, len(r), _EXACT))])
            exact = np.round(exact, 6)
            enough = exact >= floor[part][r]
            r, c, exact = r[enough], c[enough], exact[enough]
            # Ties of the last one go to the smaller id, so nothing gives a query more than k rows.
            rank = np.lexsort((c, -exact, r))
            r, c, exact = r[rank], c[rank], exact[rank]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((qi[part][r[kept]], ci[c[kept]], exact[kept]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": columns[0], "candidate_id": columns[1], "similarity": columns[2]})


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = rows["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts = lists.offsets.to_numpy()
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    m = np.zeros((len(lengths), lengths.max()))
    m[row, np.arange(starts[0], starts[-1]) - starts[row]] = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    venues = np.array([v if v is not None else "" for v in rows["venue"].to_pylist()], dtype=object)
    return rows["id"].to_numpy(), venues, m


def by_identity(rows: DataFrame, identity: str) -> DataFrame:
    return rows.where(F.col("identity_hash") == identity).limit(1)


def valid_candidates(rows: DataFrame, venues: tuple[str, ...]) -> DataFrame:
    """Candidates with all that later steps need; a missing title is the text's second line."""
    needed = F.col("venue").isin(*venues)
    for c in ("canonical_text", "venue_market_id", "identity_hash"):
        needed = needed & F.col(c).isNotNull() & (F.col(c) != "")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.get(F.split("canonical_text", "\n"), F.lit(1)))
    return rows.where(needed).withColumn("title", title)


def one_direction(found: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """Each unordered pair once, from the row that arrived later (without arrivals: the one with the better rank)."""
    key = F.concat_ws("_", F.least("query_id", "candidate_id"), F.greatest("query_id", "candidate_id"))
    rows = found.withColumn("pair_key", key)
    if received is not None:
        rows = rows.join(received.select(F.col("id").alias("query_id"), "received_at"), "query_id")
        first = F.max_by(F.struct("query_id", "candidate_id", "similarity"), F.struct("received_at", "query_id"))
    else:
        first = F.min_by(F.struct("query_id", "candidate_id", "similarity"), F.struct("rank", "query_id"))
    return rows.groupBy("pair_key").agg(first.alias("x")).select("pair_key", "x.*")
