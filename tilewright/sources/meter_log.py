"""Recorded replies of meters as a data source, for batches and streams: spark.read.format("meter_replies").

A folder holds text files, one JSON record a line: meter, at (seconds), status, body. A file is a
partition, and a stream's offset is the name of the last file it has seen, as files are written once
and named in order. Lines come out as they are, with `damaged` true where a line is no record; what a
reply says is read by `replies`, in column expressions. Anything but a good reply of status 200 is a
row with the error `meter_unreachable`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tilewright.operators.ledger import read_reply

SCHEMA = "meter string, at bigint, status int, body string, damaged boolean"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Data files in the order of their names; hidden ones do not count."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))


def _records(path: str, file: str) -> Iterator[tuple]:
    store, _ = _store(path)
    with store.open_input_stream(file) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from map(_record, filter(None, lines))
        if rest:
            yield _record(rest)


def _record(line: bytes) -> tuple:
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    plain = lambda v: v if isinstance(v, str) else None
    try:
        said = json.loads(line)
    except ValueError:
        said = None
    if not isinstance(said, dict):
        return None, None, None, None, True
    return plain(said.get("meter")), whole(said.get("at")), whole(said.get("status")), plain(said.get("body")), False


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(()) if partition is None or partition.value is None else _records(self.path, partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"last": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path) if start["last"] < f <= end["last"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _records(self.path, partition.value)


class MeterReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meter_replies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeterReplies)


def replies(lines: DataFrame) -> DataFrame:
    """Lines of the source, batch or stream: meter, at, error, period, limit, used, allowed, synced_at."""
    said = read_reply(F.coalesce("status", F.lit(0)), F.coalesce("body", F.lit("")))
    return lines.select("meter", "at", *[v.alias(k) for k, v in said.items()])
