"""A data source that replays recorded messages, one JSON text a line: batch and streaming.

``spark.dataSource.register(Replay)`` and ``spark.read.format("pairlens_replay").load(path)``.
The file must be visible where tasks run. Lines that are blank are left out; a stream hands out new lines in order and resumes from
its checkpoint, which replaces reconnecting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pairlens_replay"

    def schema(self) -> str:
        return "seq long, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("batch", 1000)))


def _lines(path: str, start: int = 0, count: int | None = None) -> Iterator[tuple[int, str]]:
    with open(path, encoding="utf-8") as file:
        for i, line in enumerate(file):
            if i >= start and (count is None or i < start + count) and line.strip():
                yield i, line.rstrip("\n")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        return _lines(self.path)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        rows = list(_lines(self.path, start["line"], self.batch))
        return iter(rows), {"line": rows[-1][0] + 1 if rows else start["line"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        return _lines(self.path, start["line"], end["line"] - start["line"])
