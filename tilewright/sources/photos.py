"""Pixels of imported files, upright: PNG by our own decoder, JPEG by Spark's image source, turned as its EXIF says.

The import ladder comes first, so a file whose header names too many pixels is never decoded. WebP has
no decoder here and gives no pixels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import png
from tilewright.sources.images import as_names, import_calls, import_many

#: The tag of a turn, and where a pixel (x, y) of a w x h image goes by its value; values of 5 on swap the sides.
_TURN_TAG = 0x0112
_TURNS = {2: ("w - 1 - x", "y"), 3: ("w - 1 - x", "h - 1 - y"), 4: ("x", "h - 1 - y"), 5: ("y", "x"), 6: ("h - 1 - y", "x"), 7: ("h - 1 - y", "w - 1 - x"), 8: ("y", "w - 1 - x")}


def turn_of(content: bytes) -> int:
    """The turn that a JPEG's EXIF block names, 1 (none) without one or where it is damaged."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        code, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if code == 0xFF:
            at += 1
            continue
        if code in (0xD9, 0xDA) or size < 2:
            break
        block = content[at + 4 : at + 2 + size]
        if code == 0xE1 and block[:6] == b"Exif\0\0":
            return _turn_in(block[6:])
        at += 2 + size
    return 1


def _turn_in(block: bytes) -> int:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    try:
        first = struct.unpack_from(order + "I", block, 4)[0]
        for k in range(struct.unpack_from(order + "H", block, first)[0]):
            tag, kind, count, value = struct.unpack_from(order + "HHIH", block, first + 2 + 12 * k)
            if (tag, kind, count) == (_TURN_TAG, 3, 1):
                return value if value in _TURNS else 1
    except (TypeError, struct.error):
        pass
    return 1


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("id"), pa.array([turn_of(c.as_py()) for c in batch.column("content")], pa.int32())], names=["id", "turn"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the image source as pixels; its bytes are blue, green, red (and alpha), or grey."""
    for batch in batches:
        for r in batch.to_pylist():
            w, h, n = r["width"], r["height"], r["nChannels"]
            data = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
            for top in range(0, h, rows := max(1, png.BATCH_PIXELS // w)):
                part = data[top : top + rows].reshape(-1, n).astype(np.int32)
                y, x = np.divmod(np.arange(len(part), dtype=np.int32), w)
                red, green, blue = (part[:, 0],) * 3 if n == 1 else (part[:, 2], part[:, 1], part[:, 0])
                size = [pa.array(np.full(len(part), v, np.int32)) for v in (w, h)]
                yield pa.record_batch([pa.array([r["origin"]] * len(part)), *map(pa.array, (x, y + np.int32(top), red, green, blue)), *size], names=["id", "x", "y", "r", "g", "b", "w", "h"])


def upright_pixels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, x, y, r, g, b, a of every file of paths (as `import_many` takes them) that is imported and can be decoded, upright.

    A file that the ladder refuses, or whose bytes turn out damaged, gives no pixels; id is the import's.
    """
    good = import_many(spark, paths).filter("error_code is null").select("id", "format").distinct().collect()
    of = {kind: [r["id"] for r in good if r["format"] == kind] for kind in ("png", "jpeg")}
    plain = F.regexp_replace("id", "^file:/+", "file:/")
    out = spark.createDataFrame([], "id string, x int, y int, r int, g int, b int, a int")
    if of["png"]:
        files = spark.read.format("binaryFile").load(as_names(of["png"])).select(F.col("path").alias("image"), "content")
        out = out.unionByName(png.decode(files).withColumnRenamed("image", "id").withColumn("id", plain))
    return out.unionByName(_jpeg_pixels(spark, of["jpeg"])) if of["jpeg"] else out


def _jpeg_pixels(spark: SparkSession, ids: list[str]) -> DataFrame:
    plain = F.regexp_replace("id", "^file:/+", "file:/")
    turned = spark.read.format("binaryFile").load(as_names(ids)).select(F.col("path").alias("id"), "content").mapInArrow(_turns, "id string, turn int").withColumn("id", plain)
    source = spark.read.format("image").option("dropInvalid", True).option("ignoreCorruptFiles", True).load(as_names(ids)).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    pixels = source.mapInArrow(_flat, "id string, x int, y int, r int, g int, b int, w int, h int").withColumn("id", plain).join(turned, "id")
    x, y = F.col("x"), F.col("y")
    for value, (to_x, to_y) in _TURNS.items():
        x, y = F.when(F.col("turn") == value, F.expr(to_x)).otherwise(x), F.when(F.col("turn") == value, F.expr(to_y)).otherwise(y)
    return pixels.select("id", x.cast("int").alias("x"), y.cast("int").alias("y"), "r", "g", "b", F.lit(255).alias("a"))


def import_with_previews(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The outcomes of `import_many` with preview, the data URL of a small PNG, for every PNG and JPEG that can be decoded."""
    return _shown(import_many(spark, paths), upright_pixels(spark, paths)).orderBy("ordinal")


def import_calls_with_previews(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """The outcomes of `import_calls` (asked: call, ordinal, path) with previews, as `import_with_previews` has them, in one job for all calls.

    PNG files are decoded from the contents already read. Paths of JPEG files, which Spark's image source takes as
    a list, go through the driver; nothing else does.
    """
    found = import_calls(spark, asked)
    good = found.filter("error_code is null")
    pixels = png.decode(good.filter("format = 'png'").select(F.col("id").alias("image"), "content").dropDuplicates(["image"])).withColumnRenamed("image", "id")
    jpegs = [r["id"] for r in good.filter("format = 'jpeg'").select("id").distinct().collect()]
    return _shown(found.drop("content"), pixels.unionByName(_jpeg_pixels(spark, jpegs)) if jpegs else pixels).orderBy("call", "ordinal")


def _shown(outcomes: DataFrame, pixels: DataFrame) -> DataFrame:
    pixels = pixels.withColumnRenamed("id", "image")
    alpha = pixels.groupBy("image").agg((F.min("a") == 255).alias("opaque"))
    small = png.encode(png.thumbnails(pixels, png.PREVIEW_EDGE).join(alpha, "image"))
    made = small.select(F.col("image").alias("_id"), png.data_url(F.lit("image/png"), F.col("content")).alias("preview"))
    plain = F.regexp_replace("id", "^file:/+", "file:/")
    return outcomes.join(made, plain == F.col("_id"), "left").drop("_id")
