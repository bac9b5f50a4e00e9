"""Image files as tables: format sniffing, header sizes and the import ladder."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import text as T
from tilewright.functions.geometry import MAX_SOURCE_BYTES, MAX_SOURCE_PIXELS
from tilewright.operators.ordered import written

MAX_PATHS = 200


def sniff(content: Column) -> Column:
    """png, jpeg, webp, other (an image of another kind) or null, from the first bytes (fixed values)."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("47494638") | head.startswith("424D") | head.startswith("49492A00") | head.startswith("4D4D002A"), "other")
    )


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's header; null where it is cut off."""
    number = lambda at: F.when(F.length(content) >= at + 3, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long"))
    ok = F.hex(F.substring(content, 13, 4)) == "49484452"
    return F.when(ok, number(17)), F.when(ok, number(21))


def _number(content: Column, at: Column | int, n: int, little: bool = False) -> Column:
    """n bytes from place `at` (0-based) as a number; null where they are cut off."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, at + 1, F.lit(n)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(n, 0, -1)])
    return F.when(F.length(content) >= at + n, F.conv(digits, 16, 10).cast("long"))


#: Segments of a JPEG that are walked to its frame header: more than 200 MB of full ones hold.
MAX_SEGMENTS = 4096
_WALK = "struct<at:int,w:bigint,h:bigint>"


def jpeg_size(content: Column) -> tuple[Column, Column]:
    """Width and height from the first frame header (fixed values: the markers); null without one, or where more than MAX_SEGMENTS segments stand
    before it, which no camera writes. Segments are skipped by their lengths."""

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        mark = F.hex(F.substring(content, at + 1, F.lit(2)))
        code = F.substring(mark, 3, 2)
        frame = (mark >= "FFC0") & (mark <= "FFCF") & ~code.isin("C4", "C8", "CC")
        bare = (code == "01") | ((code >= "D0") & (code <= "D8"))
        move = F.when(code == "FF", at + 1).when(bare, at + 2).otherwise((at + 2 + _number(content, at + 2, 2)).cast("int"))
        end = F.struct(F.lit(-1).alias("at"), F.when(frame, _number(content, at + 7, 2)).alias("w"), F.when(frame, _number(content, at + 5, 2)).alias("h")).cast(_WALK)
        gone = frame | ~F.coalesce(mark.startswith("FF"), F.lit(False)) | code.isin("D9", "DA") | move.isNull()
        return F.when(at < 0, s).when(gone, end).otherwise(F.struct(move.alias("at"), s["w"].alias("w"), s["h"].alias("h")).cast(_WALK))

    start = F.struct(F.lit(2).alias("at"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("h")).cast(_WALK)
    steps = F.sequence(F.lit(1), F.least(F.lit(MAX_SEGMENTS), F.greatest(F.lit(1), (F.length(content) / 2).cast("int"))))
    found = F.aggregate(steps, start, step)
    return found["w"], found["h"]


def webp_size(content: Column) -> tuple[Column, Column]:
    """Width and height from the first chunk: extended, lossless or lossy (fixed values: the layouts)."""
    chunk = F.hex(F.substring(content, 13, 4))
    bits = F.when(_number(content, 20, 1) == 0x2F, _number(content, 21, 4, True))
    key = F.hex(F.substring(content, 24, 3)) == "9D012A"
    pick = lambda wide, packed, lossy: F.when(chunk == "56503858", wide).when(chunk == "5650384C", packed).when((chunk == "56503820") & key, lossy)
    return (
        pick(_number(content, 24, 3, True) + 1, bits.bitwiseAND(0x3FFF) + 1, _number(content, 26, 2, True).bitwiseAND(0x3FFF)),
        pick(_number(content, 27, 3, True) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1, _number(content, 28, 2, True).bitwiseAND(0x3FFF)),
    )


def header_size(content: Column, kind: Column) -> tuple[Column, Column]:
    """Width and height of an image by its kind, before anything is decoded; null where the header is cut off or not one of the three."""
    sides = zip(png_size(content), jpeg_size(content), webp_size(content), strict=True)
    return tuple(F.when(kind == "png", p).when(kind == "jpeg", j).when(kind == "webp", w) for p, j, w in sides)


def import_error(name: Column, ext: Column, exists: Column, is_dir: Column, size: Column, kind: Column, width: Column, height: Column, max_pixels: int = MAX_SOURCE_PIXELS, max_bytes: int = MAX_SOURCE_BYTES) -> Column:
    """The first failure of the ladder, or null; the order of the branches is the rule."""
    wanted = T.format_of(ext)
    return (
        F.when(name.isNull() | (name == "") | name.contains("\0"), "file_missing").when(wanted.isNull(), "unsupported_format").when(~exists, "file_missing").when(is_dir, "unsupported_format")
        .when(size > max_bytes, "file_too_large").when(kind.isNull(), "invalid_image").when(kind != wanted, "unsupported_format")
        .when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "invalid_image").when(width * height > max_pixels, "file_too_large")
    )


def _look_up(spark: SparkSession, path: str) -> tuple[str | None, bool, int]:
    """(whole path or null, is a folder, bytes) as Spark's file system has it."""
    if not path or "\0" in path:
        return None, False, 0
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    except Py4JJavaError:
        return None, False, 0
    return found.getPath().toString(), found.isDirectory(), found.getLen()


def as_names(paths: list[str]) -> list[str]:
    """Paths for a reader that would take them as patterns."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def import_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One outcome a path, in the order given: ordinal, path, id, name, format, width, height, size, error_code.

    The files asked for are looked up one by one (200 at most, more are refused as a whole), so one
    that is missing, a folder or damaged never fails the others. Contents are read only of files that
    pass the rules on names and sizes. id is the whole path, or the path as given where there is none.
    """
    if len(paths) > MAX_PATHS:
        raise ValueError(f"at most {MAX_PATHS} paths")
    found = [(k, p, *_look_up(spark, p)) for k, p in enumerate(paths)]
    asked = spark.createDataFrame(found, "ordinal int, path string, _whole string, is_dir boolean, size long")
    wanted = sorted({whole for _, path, whole, folder, size in found if whole and not folder and size <= MAX_SOURCE_BYTES and path.rsplit(".", 1)[-1].lower() in T.FORMATS})
    files = spark.createDataFrame([], "_whole string, content binary")
    if wanted:
        files = spark.read.format("binaryFile").load(as_names(wanted)).select(F.col("path").alias("_whole"), "content")
    return _judged(asked.join(files, "_whole", "left")).drop("content").orderBy("ordinal")


def _judged(found: DataFrame) -> DataFrame:
    """found (path, _whole, is_dir, size, content and others): an outcome each, with content."""
    kind = sniff(F.col("content"))
    sized = found.withColumn("format", kind)
    w, h = header_size(F.col("content"), F.col("format"))
    sized = sized.withColumn("width", w).withColumn("height", h)
    error = import_error(F.col("path"), T.extension(F.col("path")), F.col("_whole").isNotNull(), F.col("is_dir"), F.col("size"), F.col("format"), F.col("width"), F.col("height"))
    rest = [c for c in found.columns if c not in ("ordinal", "path", "_whole", "is_dir", "size", "content")]
    return sized.select(*rest, "ordinal", "path", F.coalesce("_whole", "path").alias("id"), T.display_name(F.col("path")).alias("name"), "format", "width", "height", "size", error.alias("error_code"), "content")


#: Bytes of contents that are handed to Spark at once.
_BATCH_BYTES = 32 << 20
_FOUND = {"_whole": pa.string(), "is_dir": pa.bool_(), "size": pa.int64(), "content": pa.binary()}


def _found(base: str, home: str):
    """Rows with a path looked up where they are: whole path or null, is a folder, bytes, and the content of files that pass the rules on names and sizes."""

    def look(path: str | None) -> tuple[str | None, bool, int, bytes | None]:
        if not path or "\0" in path:
            return None, False, 0, None
        whole = path if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else base + posixpath.join(home, path)
        try:
            if whole.startswith("file:"):
                store, inner = fs.LocalFileSystem(), re.sub("/+", "/", whole[5:])
                whole = f"file:{inner}"
            else:
                store, inner = fs.FileSystem.from_uri(whole)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                return None, False, 0, None
            if info.type == fs.FileType.Directory:
                return whole, True, 0, None
            content = None
            if info.size <= MAX_SOURCE_BYTES and path.rsplit(".", 1)[-1].lower() in T.FORMATS:
                with store.open_input_stream(inner) as source:
                    content = source.read()
            return whole, False, info.size, content
        except (OSError, pa.ArrowException):
            return None, False, 0, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, rows, held = 0, [], 0
            for at, path in enumerate(batch.column("path").to_pylist()):
                rows.append(look(path))
                held += len(rows[-1][3] or b"")
                if held >= _BATCH_BYTES or at == batch.num_rows - 1:
                    part = batch.slice(start, len(rows))
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _FOUND.values(), strict=True)]
                    yield pa.record_batch([*part.columns, *made], names=[*part.schema.names, *_FOUND])
                    start, rows, held = at + 1, [], 0

    return run


def import_calls(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """asked (call, ordinal, path), any number of calls of at most 200 paths: the outcomes of `import_many` for all in one job, and content.

    Paths are looked up and files read by tasks, through Arrow's file systems, so neither the number of calls nor that of files
    meets the driver; a path without a scheme lies in Spark's default file system. A call of more paths refuses the whole. A
    file that cannot be opened counts as missing; content is null where there is an error. Written to the shared folder.
    """
    if not asked.groupBy("call").count().filter(F.col("count") > MAX_PATHS).isEmpty():
        raise ValueError(f"at most {MAX_PATHS} paths a call")
    base = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    look = _found("file:" if base.startswith("file:") else base.rstrip("/"), os.getcwd() if base.startswith("file:") else "/")
    dealt = asked.select("call", "ordinal", "path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    found = dealt.mapInArrow(look, f"{kinds}, _whole string, is_dir boolean, size long, content binary")
    return written(_judged(found).withColumn("content", F.when(F.col("error_code").isNull(), F.col("content"))), "imports")
