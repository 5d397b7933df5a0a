"""Merges, versions and sinks.

Plain Parquet has no MERGE and no transaction over several tables: merges return the whole
new state of a table, writes are keyed by batch id and can be repeated, and a batch over several
tables counts from the moment its marker is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], hash_column: str, now: Column, kept: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """New keys are inserted, known ones updated only if ``hash_column`` is distinct from the old one."""
    cols = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    known, given = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    both = o.withColumn("_old", F.lit(1)).alias("o").join(n.withColumn("_new", F.lit(1)).alias("n"), on, "full")
    changed = given & (~known | ~F.col(f"o.{hash_column}").eqNullSafe(F.col(f"n.{hash_column}")))

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(changed, now).otherwise(F.col("o.updated_at"))
        fresh = F.col(f"n.{c}") if c in new.columns else (now if c == "created_at" else F.lit(None))
        if c in kept:
            return F.when(known, F.col(f"o.{c}")).otherwise(fresh)
        return F.when(changed, fresh).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")

    return both.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in cols]).select(old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key is unknown, to be appended."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def versioned(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """All versions with is_current and version: the last one of a key in ``order`` is current."""
    both = old.drop("is_current", "version").unionByName(new, allowMissingColumns=True)
    by = [F.col(c) for c in order]
    return both.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(*by))).withColumn("is_current", F.row_number().over(W.partitionBy(key).orderBy(*[c.desc() for c in by])) == 1)


def change_log(pairs: DataFrame, key: str, now: Column) -> DataFrame:
    """A notification for each changed key."""
    return pairs.select(key).distinct().select(F.to_json(F.struct(F.col(key).alias("pair_key"), now.alias("ts"))).alias("payload"))


def point_id(identity_hash: Column) -> Column:
    """A UUID from the first 32 hex digits; without them, from a hash of the text."""
    def dashed(h: Column) -> Column:
        return F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    digits = F.lower(F.substring(identity_hash, 1, 32))
    return dashed(F.when(digits.rlike("^[0-9a-f]{32}$"), digits).otherwise(F.substring(F.sha1(identity_hash), 1, 32)))


def overwrite_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vector points by id, new ones over old ones."""
    return old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def audit_lines(rows: DataFrame, category: str, severity: Column, at: Column) -> DataFrame:
    """Audit records of a category as JSON lines."""
    return rows.select(F.lit(category).alias("category"), F.to_json(F.struct(at.alias("timestamp"), severity.alias("severity"), F.struct("*").alias("record"))).alias("value"))


def write_audit(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").partitionBy("category").text(path)


def passing(error: Exception) -> bool:
    """Whether a repeat may help: trouble of files, networks and jobs, not wrong plans or code."""
    return isinstance(error, (OSError, PySparkException)) and not isinstance(error, AnalysisException)


class BatchWriter:
    """For ``foreachBatch``: steps in order, retried with growing waits, then the batch goes to a dead letter folder.

    Every step gets the batch and its id, and must give the same result when run again.
    """

    def __init__(self, steps: Sequence[Callable[[DataFrame, int], None]], dead_letters: str, retries: int = 3, transient: Callable[[Exception], bool] = passing, sleep: Callable[[float], None] = time.sleep):
        self.steps, self.dead_letters, self.retries, self.transient, self.sleep = steps, dead_letters, retries, transient, sleep

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            for attempt in range(self.retries + 1):
                try:
                    for step in self.steps:
                        step(batch, batch_id)
                    return
                except Exception as error:
                    if attempt == self.retries or not self.transient(error):
                        letters = batch.select(F.lit(batch_id).alias("batch_id"), F.lit(str(error)[:1000]).alias("error"), F.to_json(F.struct("*")).alias("payload"))
                        letters.write.mode("overwrite").json(f"{self.dead_letters}/batch={batch_id}")
                        return
                    self.sleep(min(2**attempt, 30))
        finally:
            batch.unpersist()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A step that writes each batch to a folder of its own, so that a repeat replaces it."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def commit_together(root: str, tables: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], None]:
    """A step that writes a batch to several tables, in order, of which readers see all or none.

    Each table gets a folder for the batch, which a repeat replaces; the marker comes last.  A
    batch that has its marker is not written again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _markers(spark, root)
        if done is not None and not done.where(F.col("batch") == batch_id).isEmpty():
            return
        for name, rows in tables:
            rows(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{root}/_committed_batches")

    return step


def _markers(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_committed_batches")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("batch long").parquet(str(path)).distinct()


def committed(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """Rows of the batches that have their marker, with the column ``batch``; none before the first."""
    done = _markers(spark, root)
    if done is None:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{table}").join(done, "batch", "left_semi").select(*spark.createDataFrame([], schema).columns, "batch")
