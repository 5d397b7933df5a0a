"""A stored table with a key: upserts, inserts and versions rewrite only the buckets that they touch.

Rows lie in Parquet folders, one for each write and bucket of the key's hash; a version is a small list that
says which write holds each bucket.  A merge reads the touched buckets, writes them anew with Spark and then
publishes the next version, so a write that dies leaves the last version as it was, readers
see a batch whole or not at all, and older versions stay readable until :meth:`KeyedTable.clean`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import persist

Merge = Callable[[DataFrame, DataFrame], DataFrame]
#: Seconds that a version which isn't whole counts as being written; later its writer counts as dead.
GRACE_SECONDS = 60.0


class KeyedTable:
    """Rows of ``schema`` under ``path``; rows whose ``keys`` are equal (nulls too) lie in one of ``buckets`` buckets.

    The number of buckets is fixed when the first version is written.  Choose it so that a bucket
    is a few files: a merge rewrites whole buckets, and a version lists one entry for each.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
        self.columns = list(self.types)

    # Versions

    def _place(self, *parts: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _numbers(self) -> list[int]:
        fs, place = self._place("versions")
        found = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(name.removesuffix(".json")) for name in found if name.endswith(".json") and name[:-5].isdigit())

    def version(self, number: int | None = None) -> dict[str, Any]:
        """The version ``number`` or the last whole one: its number, which write holds each bucket, the last batches."""
        for n in reversed(self._numbers()):
            if number is None or n == number:
                fs, place = self._place("versions", f"{n}.json")
                stream = fs.open(place)
                try:
                    text = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                try:
                    return json.loads(text)
                except ValueError:
                    # Its writer died over it; the one before holds.
                    continue
        if number is not None:
            raise ValueError(f"there is no version {number} of {self.path}")
        return {"number": 0, "buckets": {}, "count": self.buckets, "batches": {}}

    def _being_written(self) -> bool:
        """Whether another writer has taken the newest number and not filled it yet."""
        newest = max(self._numbers(), default=0)
        if newest <= self.version()["number"]:
            return False
        fs, place = self._place("versions", f"{newest}.json")
        return time.time() - fs.getFileStatus(place).getModificationTime() / 1000 < GRACE_SECONDS

    def _publish(self, version: dict[str, Any]) -> bool:
        """Whether the version could be written: a number is given once."""
        fs, place = self._place("versions", f"{version['number']}.json")
        try:
            stream = fs.create(place, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        return True

    # Reading

    def _read(self, version: dict[str, Any], only: Sequence[int] | None = None) -> DataFrame:
        held = {int(b): w for b, w in version["buckets"].items() if only is None or int(b) in set(only)}
        paths = [f"{self.path}/rows/{w}/_bucket={b}" for b, w in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version, by default of the last."""
        return self._read(self.version(number))

    # Writing

    def _bucket(self, count: int) -> Column:
        # Nulls leave a hash as it is, so they are told apart from other values first.
        return F.pmod(F.xxhash64(*[c for k in self.keys for c in (F.col(k), F.col(k).isNull())]), F.lit(count)).cast("int")

    def _typed(self, new: DataFrame) -> DataFrame:
        """The columns of ``new`` that the table has, in the table's types: equal keys must hash alike."""
        return new.select(*[F.col(c).cast(t).alias(c) for c, t in self.types.items() if c in new.columns])

    def _touched(self, rows: DataFrame, count: int) -> list[int]:
        # At most ``buckets`` numbers.
        return sorted(r["b"] for r in rows.select(self._bucket(count).alias("b")).distinct().collect())

    def merge(self, new: DataFrame, how: Merge, changed: Merge | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publishes ``how(old rows of the touched buckets, new)`` as the next version and gives its number.

        ``changed(old, new)`` names the rows of ``new`` that make a difference: only their buckets are rewritten, and
        without any nothing is.  A ``batch`` (query, id) that a version knows is not written again.  If
        another writer publishes first, the merge is done anew on what that one wrote.
        """
        new = self._typed(new)
        while True:
            now = self.version()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return now["number"]
            if self._being_written():
                time.sleep(0.5)
                continue
            bucket = self._bucket(now["count"])
            touched = self._touched(new, now["count"])
            if changed and touched:
                touched = self._touched(changed(self._read(now, touched), new), now["count"])
            held = dict(now["buckets"])
            if touched:
                write = uuid.uuid4().hex
                part = new.where(bucket.isin(touched)) if len(touched) < now["count"] else new
                merged = how(self._read(now, touched), part).select(*self.columns)
                merged.withColumn("_bucket", bucket).repartition(min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/rows/{write}")
                # A bucket that the merge left empty has no folder.
                fs, place = self._place("rows", write)
                full = {f.getPath().getName().removeprefix("_bucket=") for f in fs.listStatus(place)}
                held = {b: w for b, w in held.items() if int(b) not in touched} | {str(b): write for b in touched if str(b) in full}
            elif not batch:
                return now["number"]
            batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
            number = max([0, *self._numbers()]) + 1
            if self.version()["number"] == now["number"] and self._publish({"number": number, "buckets": held, "count": now["count"], "batches": batches}):
                return number

    def upsert(self, new: DataFrame, hash_column: str, now: Column, kept: Sequence[str] = ("id", "created_at"), batch: tuple[str, int] | None = None) -> int:
        """New keys come in, known ones change where ``hash_column`` is distinct from what is stored; of rows that share a key the last by hash counts."""
        new = self._typed(new)
        rest = [c for c in new.columns if c not in self.keys]
        once = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(hash_column, F.xxhash64(*rest))).alias("_x")).select(*self.keys, *[F.col(f"_x.{c}").alias(c) for c in rest]) if rest else new.distinct()

        def changed(old: DataFrame, rows: DataFrame) -> DataFrame:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*self.keys, hash_column]]
            return rows.alias("n").join(old.alias("o"), same, "left_anti")

        return self.merge(once, lambda old, rows: persist.upsert(old, rows, self.keys, hash_column, now, kept), changed, batch)

    def insert_absent(self, new: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows whose key is unknown come in, the first of each by its other columns."""

        def unknown(old: DataFrame, rows: DataFrame) -> DataFrame:
            return rows.alias("n").join(old.alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys], "left_anti")

        new = self._typed(new)
        rest = [c for c in self.columns if c not in self.keys]
        once = new.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_x")).select(*self.keys, *[F.col(f"_x.{c}").alias(c) for c in rest]) if rest else new.select(*self.keys).distinct()
        return self.merge(once, lambda old, rows: old.unionByName(unknown(old, rows)), unknown, batch)

    def add_versions(self, new: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """Every new row becomes a version of its key (is_current, version); rows that are stored already change nothing."""
        if len(self.keys) != 1:
            raise ValueError("versions are of one key column")
        own = [c for c in self.columns if c not in ("is_current", "version")]

        def unknown(old: DataFrame, rows: DataFrame) -> DataFrame:
            return rows.alias("n").join(old.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in own], "left_anti")

        once = self._typed(new).select(*own).distinct()
        return self.merge(once, lambda old, rows: persist.versioned(old, unknown(old, rows), self.keys[0], order), unknown, batch)

    def clean(self, keep: int = 1) -> None:
        """Deletes all versions but the last ``keep`` whole ones, and rows that none of those holds."""
        numbers, whole = self._numbers(), []
        for n in reversed(numbers):
            if len(whole) < keep:
                try:
                    whole.append(self.version(n))
                except ValueError:
                    continue
        if not whole:
            return
        first = min(v["number"] for v in whole)
        for n in numbers:
            if n < first:
                fs, place = self._place("versions", f"{n}.json")
                fs.delete(place, False)
        used = {w for v in whole for w in v["buckets"].values()}
        fs, place = self._place("rows")
        for f in fs.listStatus(place) if fs.exists(place) else []:
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)


def upsert_step(table: KeyedTable, query: str, hash_column: str, now: Callable[[], Column] = F.current_timestamp, kept: Sequence[str] = ("id", "created_at")) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is one version, also when it is given again after a restart."""
    return lambda batch, batch_id: (table.upsert(batch, hash_column, now(), kept, (query, batch_id)), None)[1]
