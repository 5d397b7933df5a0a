"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Without that setting a session in one process (a test) gets
    a folder of its own, removed when the process ends; on a cluster it is an error, since each
    executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master}")
        found = tempfile.mkdtemp(prefix="pairlens-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written by the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The saved result of ``make``; tables that it wrote on the way are deleted."""
    written: list[str] = []
    _scopes.append(written)
    try:
        df = make()
        spark = df.sparkSession
        out = saved(df, label)
    finally:
        _scopes.pop()
    for path in written[:-1]:
        _delete(spark, path)
    if _scopes:
        _scopes[-1].append(written[-1])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(least: int) -> int:
    return 1 << max(0, (int(least) - 1).bit_length())


def if_small(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 32) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay below the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_mb << 20 else df


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``key`` so that no run of an equal key is split.

    A table ends at the last key change of what has been read, so memory holds one
    Arrow batch and the longest run.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[-1]
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1] != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if keys[0] != last:
            at = _run_start(keys, last)
            yield pa.Table.from_batches([*rest, batch.slice(0, at)])
            rest = [batch.slice(at)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _run_start(keys: pa.Array, last: pa.Scalar) -> int:
    """The first index of the run that ends the sorted ``keys``."""
    low, high = 0, len(keys) - 1
    while low < high:
        middle = (low + high) // 2
        if keys[middle] == last:
            high = middle
        else:
            low = middle + 1
    return low
