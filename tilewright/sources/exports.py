"""Exports of finished images: collision-safe names, whole files or none, a row of what was written for each.

A PNG export is a byte copy of its master. Files are streamed by tasks under names of their own attempt
and get their real names when the whole write commits, so an interrupted export leaves nothing that
could be taken for a file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tilewright.functions.scalars import FORMAT_KEYS, export_limit, lookup
from tilewright.functions.text import safe_stem
from tilewright.operators.ledger import safe_names
from tilewright.operators.ordered import written
from tilewright.sources.images import png_size

#: Fixed value: the name of a file whose stem has nothing left.
NAMELESS = "image"
#: Formats that can be written here: a master is a PNG already.
WRITTEN = ("png",)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class FileWriter(DataSourceWriter):
    """Rows (folder, name, content): a file each, named on commit."""

    def __init__(self) -> None:
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        files: list[tuple[str, str, str]] = []
        try:
            for row in iterator:
                store, root = _place(row["folder"])
                store.create_dir(root, recursive=True)
                part = f"{root}/_{self.attempt}-{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    files.append((row["folder"], part, f"{root}/{row['name']}"))
                    out.write(bytes(row["content"]))
        except Exception:
            for folder, part, _ in files:
                _place(folder)[0].delete_file(part)
            raise
        return _Written(files)

    def commit(self, messages: list) -> None:
        folders = set()
        for folder, part, name in (f for m in messages if m for f in m.files):
            _place(folder)[0].move(part, name)
            folders.add(folder)
        self._sweep(folders)

    def abort(self, messages: list) -> None:
        self._sweep({f[0] for m in messages if m for f in m.files})

    def _sweep(self, folders: set[str]) -> None:
        """Leftovers of attempts that did not count."""
        for folder in folders:
            store, root = _place(folder)
            for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if os.path.basename(found.path).startswith(f"_{self.attempt}-"):
                    store.delete_file(found.path)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("dir").to_pylist():
            store, root = _place(folder)
            names = [os.path.basename(f.path) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
            yield pa.record_batch([pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string())], names=["dir", "name"])


def names_in(folders: DataFrame) -> DataFrame:
    """folders (dir): dir, name of everything that lies in each; a folder that is not there has nothing."""
    return folders.select("dir").distinct().mapInArrow(_listed, "dir string, name string")


def export(spark: SparkSession, masters: DataFrame, stamp: int | None = None, go_on: bool = False) -> DataFrame:
    """masters (ordinal, dir, stem, format, content) written, each as the first free name of its folder: ordinal, file_path,
    file_name, folder, format, bytes, error.

    error: file_missing without content, unknown_format, export_limit where a format cannot hold an
    edge, and no_encoder for the formats that nobody here can write. ordinal is unique. Beyond 999 files of
    a stem, names end in stamp, or with go_on in the next free number.
    """
    spark.dataSource.register(Files)
    kind = lookup(FORMAT_KEYS, F.lower("format"))
    w, h = png_size(F.col("content"))
    error = (
        F.when(F.col("content").isNull(), "file_missing").when(kind.isNull(), "unknown_format").when(export_limit(kind, w, h).isNotNull(), "export_limit").when(~kind.isin(*WRITTEN), "no_encoder")
    )
    judged = written(masters.select("ordinal", "dir", safe_stem(F.col("stem"), NAMELESS).alias("stem"), kind.alias("format"), "content", error.alias("error")), "exports")
    good = judged.filter("error is null")
    names = written(safe_names(good.select("dir", "stem", F.col("format").alias("ext"), "ordinal"), names_in(good), None if stamp is None else F.lit(stamp), go_on), "names")
    named = good.join(names, ["dir", "ordinal"])
    named.select(F.col("dir").alias("folder"), "name", "content").write.format("whole_files").mode("append").save()
    done = judged.join(names, ["dir", "ordinal"], "left")
    return done.select("ordinal", F.concat_ws("/", "dir", F.col("name")).alias("_p"), F.col("name").alias("file_name"), F.col("dir").alias("folder"), "format", F.when(F.col("error").isNull(), F.length("content").cast("long")).alias("bytes"), "error").select(
        "ordinal", F.when(F.col("error").isNull(), F.col("_p")).alias("file_path"), "file_name", "folder", "format", "bytes", "error"
    )
