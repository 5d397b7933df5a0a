"""Exact similarity retrieval that skips cells of a metric index.

Vectors fall to the nearest of some centroids, chosen from a bounded sample; a cell knows its radius.  On
unit vectors a cosine is a distance, so by the triangle inequality no row of a cell is
nearer to a query than the centroid less the radius.  Each query first searches its own cell; its
k-th score there excludes every cell whose bound falls below it, and only the others are searched.  The
rows are those of :func:`pairlens.operators.retrieve.similar`, whatever the sample: a poor one excludes less.

Cells and the queries that visit them are cut into parts of bounded size, so a cell that holds a third of
all rows, or is visited by all queries, is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.folders import written
from pairlens.operators import retrieve

#: Rows that centroids are chosen from, at most, and centroids at most.
SAMPLE_ROWS, MOST_CELLS = 8_192, 1_024
#: Rows and queries of a part.
PART_ROWS = 1 << 14
#: Rows of a cell on average.  A query travels once for each cell that it visits, so where nothing can be
#: skipped more cells mean more to send and nothing to gain.
CELL_ROWS = 1 << 12
ROUNDS = 4
#: Rounding of scores and of bounds together stays below this.
SLACK = 2e-6


@dataclass(frozen=True)
class Index:
    """Unit centroids with the radius and the number of rows of their cells."""

    centroids: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The highest cosine that a row of each cell can have with each of the ``unit`` vectors."""
        apart = np.maximum(0.0, _apart(unit @ self.centroids.T) - self.radius)
        return np.where(apart < 2.0, 1.0 - apart * apart / 2.0, -1.0)


def _apart(cosine: np.ndarray) -> np.ndarray:
    """The distance of unit vectors with this cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def centroids_of(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """``cells`` unit vectors that the rows of ``sample`` (unit vectors) gather around."""
    chooser = np.random.default_rng(seed)
    centre = sample[chooser.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centre)
    return centre


def indexed(base: DataFrame, cells: int) -> tuple[Index, DataFrame]:
    """The index of ``base`` (id, venue, v) and its rows with their cell; every row is in it."""
    chosen = base.select("v", "id", "venue").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    if not chosen.num_rows:
        return Index(np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64)), base.withColumns({"cell": F.lit(0), "apart": F.lit(0.0)})
    sample = retrieve._matrix(chosen)[2]
    centroids = centroids_of(sample, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                cosine = _fitted(retrieve._matrix(pa.Table.from_batches([part]))[2], centroids.shape[1]) @ centroids.T
                cell = cosine.argmax(1)
                apart = _apart(cosine[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], names=[*part.schema.names, "cell", "apart"])

    kind = base.schema["v"].dataType.simpleString()
    rows = written(base.select("id", "venue", "v").mapInArrow(assign, f"id long, venue string, v {kind}, cell int, apart double"), "metric-rows")
    radius, count = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    # A row a cell.
    for r in rows.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["radius"] + 1e-9, r["n"]
    return Index(centroids, radius, count), rows


def _fitted(m: np.ndarray, width: int) -> np.ndarray:
    """``m`` with ``width`` columns: missing ones are zero, as in a product of vectors of unequal length."""
    if m.shape[1] > width:
        raise ValueError(f"a vector has {m.shape[1]} components, the sample's have {width} at most")
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def _visits(queries: DataFrame, index: Index, k: int, least: float, home: bool) -> DataFrame:
    """``queries`` (id, venue, v, cell, last) once for each cell that they have to visit: their own, or all others that may hold one of the best."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                unit = _fitted(retrieve._matrix(pa.Table.from_batches([part]))[2], index.centroids.shape[1])
                last = part.column(4).to_numpy(zero_copy_only=False)
                open_ = (index.bounds(unit) >= np.maximum(last, least)[:, None] - SLACK) & (index.count > 0)
                open_[np.arange(len(unit)), part.column(3).to_numpy()] = False
                row, cell = np.nonzero(open_)
                for a in range(0, len(row), 8_192):
                    took = pa.array(row[a : a + 8_192])
                    yield pa.RecordBatch.from_arrays([c.take(took) for c in part.columns[:3]] + [pa.array(cell[a : a + 8_192].astype(np.int32)), pa.array(last[row[a : a + 8_192]])], names=["id", "venue", "v", "cell", "last"])

    if home:
        return queries.select("id", "venue", "v", "cell")
    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("id", "venue", "v", "cell", "last").mapInArrow(visit, f"id long, venue string, v {kind}, cell int, last double")


def _searched(visits: DataFrame, rows: DataFrame, index: Index, k: int, least: float) -> tuple[DataFrame, int]:
    """query_id, candidate_id, similarity: the best ``k`` of each part of a cell for each query that visits it; and the number of visits."""
    spark = rows.sparkSession
    # A row a cell; parts of queries and of rows make a grid within the cell.
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [(c, max(1, -(-asked[c] // PART_ROWS)), max(1, -(-int(index.count[c]) // PART_ROWS))) for c in asked]
    sizes = F.broadcast(spark.createDataFrame(parts, "cell int, qs int, cs int"))
    left = visits.join(sizes, "cell").select(*visits.columns, F.pmod(F.xxhash64(F.lit(1), "id"), "qs").alias("q"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"))
    right = rows.join(sizes, "cell").select("id", "venue", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("q"), F.pmod(F.xxhash64(F.lit(2), "id"), "cs").cast("int").alias("c"))
    keys = ["cell", "q", "c"]
    # Rows may visit their own table: both sides get columns of their own.
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(retrieve.best_of, k=k, least=least), "query_id long, candidate_id long, similarity double")
    return found, sum(asked.values())


def similar(rows: DataFrame, id_column: str, venue_column: str, vector_column: str, k: int | None = None, least: float | None = None, settings: Settings = Settings(), cells: int | None = None, report: dict[str, float] | None = None) -> DataFrame:
    """query_id, rank, candidate_id, similarity: the best ``k`` rows of other venues by cosine, from ``least`` on.

    Scores are rounded to six places; equal ones go to the smaller id.  Vectors that are null, hold a null or have no
    length match nothing; ids must be distinct.  ``report`` takes the share of all (query, cell) pairs that were visited.
    """
    k, least = settings.top_k if k is None else k, settings.least_similarity if least is None else least
    v = F.col(vector_column)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0)
    base = rows.where(usable).select(F.col(id_column).cast("long").alias("id"), F.col(venue_column).cast("string").alias("venue"), v.alias("v"))
    total = base.count()
    index, placed = indexed(base, cells or int(np.clip(total // CELL_ROWS, 4, MOST_CELLS)))
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "candidate_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(best(_searched(_visits(placed, index, k, least, True), placed, index, k, least)[0]), "metric-first")
    # The k-th score of each query so far; without k rows nothing is excluded by it.
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("last"))
    queries = placed.join(last, "id", "left").withColumn("last", F.coalesce("last", F.lit(-np.inf)))
    further, visits = _searched(_visits(queries, index, k, least, False), placed, index, k, least)
    if report is not None:
        report["visited"] = (total + visits) / max(1, total * int((index.count > 0).sum()))
    return best(first.select("query_id", "candidate_id", "similarity").union(further)).select("query_id", "rank", "candidate_id", "similarity")
