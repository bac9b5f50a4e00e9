"""PNG files as pixel tables and back.

`encode` makes bands of rows in as many tasks as there are bands, and a small row per band is all that
meets for an image. `save` hands those bands, in order, to a Python data source whose tasks stream each
image into a file of its own; files get their names when the whole write commits. `decode` streams a
file's rows out of its inflated bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tilewright.functions import png_codec as codec
from tilewright.functions.geometry import MAX_SOURCE_PIXELS
from tilewright.functions.scalars import VIEW_EDGE
from tilewright.functions.text import data_url
from tilewright.operators.ordered import written
from tilewright.operators.pixels import thumbnails
from tilewright.sources.images import png_size

#: Fixed value: the longest side of a preview.
PREVIEW_EDGE = 480
BAND_ROWS = 64
#: Pixels are handed to Spark so many at a time.
BATCH_PIXELS = 1 << 16
_BAND = "band long, width int, height int, channels int, whole boolean, data binary, adler long, n_bytes long"


def _bands(image: DataFrame, band_rows: int) -> DataFrame:
    """image, band, width, height (of the band), channels, whole (no pixel is missing), data, adler, n_bytes.

    Pixels with a column a have four channels; a column opaque, which is the same for all pixels of an
    image, leaves the fourth out where it is true.
    """
    every = ["r", "g", "b"] + (["a"] if "a" in image.columns else [])
    flags = ["opaque"] if "opaque" in image.columns else []

    def encode_band(table: pa.Table) -> pa.Table:
        channels = every[:3] if flags and table.column("opaque")[0].as_py() else every
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        band = table.column("band")[0].as_py()
        top, width = int(y.min()), int(x.max()) + 1
        height = int(y.max()) - top + 1
        whole = top == band * band_rows and x.min() >= 0 and len(x) == width * height and len(np.unique((y - top) * width + x)) == len(x)
        data, adler, n = b"", 1, 0
        if whole:
            pixels = np.zeros((height, width, len(channels)), np.uint8)
            for k, c in enumerate(channels):
                pixels[y - top, x, k] = table.column(c).to_numpy()
            data, adler, n = codec.encode_band(pixels, band == 0)
        made = {"band": band, "width": width, "height": height, "channels": len(channels), "whole": bool(whole), "data": data, "adler": adler, "n_bytes": n}
        kinds = {"width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "data": pa.binary()}
        return pa.table([table.column("image").slice(0, 1), *[pa.array([v], kinds.get(k)) for k, v in made.items()]], names=["image", *made])

    rows = image.select("image", F.expr(f"y div {band_rows}").cast("long").alias("band"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *every, *flags)
    schema = T.StructType([image.schema["image"], *T._parse_datatype_string(_BAND).fields])
    return rows.groupBy("image", "band").applyInArrow(encode_band, schema)


def _fits(bands: list[dict], band_rows: int) -> bool:
    """Bands of one width, in order from 0, all whole, all of full height but the last."""
    return all(b["whole"] and b["band"] == k and b["width"] == bands[0]["width"] and (b["height"] == band_rows or k == len(bands) - 1) for k, b in enumerate(bands))


def encode(image: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """image, content: each image's PNG file. image: a byte image (image, x, y, r, g, b and, with alpha, a; see `_bands` for opaque).

    An image with a missing or repeated pixel has null content: what is not whole is not written.
    """

    def assemble(table: pa.Table) -> pa.Table:
        bands = sorted(table.to_pylist(), key=lambda b: b["band"])
        content, total = None, 1
        if _fits(bands, band_rows):
            for b in bands:
                total = codec.joined_sum(total, b["adler"], b["n_bytes"])
            head = codec.file_head(bands[0]["width"], sum(b["height"] for b in bands), bands[0]["channels"])
            content = b"".join([head, *[codec.band_chunk(b["data"], not b["band"]) for b in bands], codec.file_end(total)])
        return pa.table([table.column("image").slice(0, 1), pa.array([content], pa.binary())], names=["image", "content"])

    return _bands(image, band_rows).groupBy("image").applyInArrow(assemble, T.StructType([image.schema["image"], T.StructField("content", T.BinaryType())]))


def _decode(batches: Iterator[pa.RecordBatch], max_pixels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        image = batch.column("image")
        for k, content in enumerate(batch.column("content")):
            content = content.as_py()
            if content is None or codec.check(content, max_pixels):
                continue
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for x, y, pixels in codec.decode(content):
                held.append((x, np.full(len(x), y), pixels))
                size += len(x)
                if size >= BATCH_PIXELS:
                    yield _pixels(image, k, held)
                    held, size = [], 0
            if held:
                yield _pixels(image, k, held)


def _pixels(image: pa.Array, k: int, held: list) -> pa.RecordBatch:
    x, y, pixels = (np.concatenate(c) for c in zip(*held, strict=True))
    names = image.take(pa.array(np.full(len(x), k, np.int32)))
    return pa.record_batch([names, *[pa.array(v.astype(np.int32)) for v in (x, y, *pixels.T)]], names=["image", "x", "y", "r", "g", "b", "a"])


def decode(files: DataFrame, max_pixels: int = MAX_SOURCE_PIXELS) -> DataFrame:
    """files (image, content): image, x, y, r, g, b, a of every whole PNG within max_pixels; others give no row (see `faults`).

    Grey, palette, all bit depths, transparency and interlaced files become bytes of colour and alpha. A
    file is inflated once to check it, a part at a time and never beyond the size its header names, and
    once more for its rows, so a cut one leaves no rows behind.
    """
    schema = T.StructType([files.schema["image"], *[T.StructField(c, T.IntegerType()) for c in ("x", "y", "r", "g", "b", "a")]])
    return files.select("image", "content").mapInArrow(lambda b: _decode(b, max_pixels), schema)


def faults(files: DataFrame, max_pixels: int = MAX_SOURCE_PIXELS) -> DataFrame:
    """files (image, content): image, error: invalid_image, file_too_large or null."""
    return _judged(files.select("image", "content"), max_pixels).select("image", "error")


def _judged(files: DataFrame, max_pixels: int) -> DataFrame:
    """files with error and alpha (whether a whole file has transparency)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content").to_pylist()
            errors = ["invalid_image" if c is None else codec.check(c, max_pixels) for c in contents]
            alpha = [None if e else codec.has_alpha(c) for c, e in zip(contents, errors, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(errors, pa.string()), pa.array(alpha, pa.bool_())], names=[*batch.schema.names, "error", "alpha"])

    return files.mapInArrow(judge, T.StructType([*files.schema.fields, T.StructField("error", T.StringType()), T.StructField("alpha", T.BooleanType())]))


def views(files: DataFrame, edge: int = VIEW_EDGE, max_pixels: int = MAX_SOURCE_PIXELS, always: bool = False) -> DataFrame:
    """files (image, content): image, width, height, delivered_edge, original, data_url, error.

    A PNG whose longest side is at most `edge` (1 at least) comes as its own bytes, a larger one shrunk
    by area (`thumbnails`) and written anew, with alpha if the file's kind has it; with `always`, small ones
    are written anew too, as previews are. A file with a fault has its error and nothing else. Opaque
    images come as PNG here, as there is no JPEG writer. image is unique.
    """
    edge = max(1, edge)
    w, h = png_size(F.col("content"))
    judged = written(_judged(files.select("image", "content"), max_pixels).withColumn("width", w).withColumn("height", h), "views")
    longest = F.greatest("width", "height")
    judged = judged.withColumn("original", (longest <= edge) & F.lit(not always))
    large = judged.filter("error is null and not original")
    shrunk = thumbnails(decode(large.select("image", "content"), max_pixels), edge)
    made = encode(shrunk.join(large.select("image", (~F.col("alpha")).alias("opaque")), "image"))
    out = judged.join(made.withColumnRenamed("content", "_made"), "image", "left")
    good = lambda c: F.when(F.col("error").isNull(), c)
    return out.select(
        "image", good(F.col("width")).alias("width"), good(F.col("height")).alias("height"), good(F.least(longest, F.lit(edge))).alias("delivered_edge"), good(F.col("original")).alias("original"),
        good(data_url(F.lit("image/png"), F.when(F.col("original"), F.col("content")).otherwise(F.col("_made")))).alias("data_url"), "error",
    )


def previews(files: DataFrame) -> DataFrame:
    """image, preview (data URL), error: what an import shows of each file."""
    return views(files, PREVIEW_EDGE, always=True).select("image", F.col("data_url").alias("preview"), "error")


# --- the sink --------------------------------------------------------------------------------------


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PngWriter(DataSourceWriter):
    """Streams bands, which come sorted by image and band, into one file an image; names are given on commit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.band_rows, self.attempt = options["path"], int(options["bandrows"]), uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> _Written:
        store, root = self._place()
        store.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        out, at, first, rows, total = None, None, None, 0, 1

        def finished() -> None:
            if out is not None:
                if rows != first["total_height"]:
                    raise ValueError(f"image {at} is not whole")
                out.write(codec.file_end(total))
                out.close()

        for band in iterator:
            if out is None or band["image"] != at:
                finished()
                at, first, rows, total = band["image"], band, 0, 1
                part = f"{root}/_{self.attempt}-{uuid.uuid4().hex}.part"  # of this attempt of this task alone
                files.append((part, f"{root}/{band['name']}.png"))
                out = store.open_output_stream(part)
                out.write(codec.file_head(band["width"], band["total_height"], band["channels"]))
            if not band["whole"] or band["width"] != first["width"] or band["band"] * self.band_rows != rows:
                raise ValueError(f"image {at} is not whole at row {rows}")
            out.write(codec.band_chunk(bytes(band["data"]), rows == 0))
            total = codec.joined_sum(total, band["adler"], band["n_bytes"])
            rows += band["height"]
        finished()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, _ = self._place()
        for message in messages:
            for part, name in message.files if message else []:
                store.move(part, name)
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Leftovers of attempts that did not count."""
        store, root = self._place()
        for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if os.path.basename(found.path).startswith(f"_{self.attempt}-"):
                store.delete_file(found.path)


class PngSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_bands"

    def writer(self, schema: T.StructType, overwrite: bool) -> PngWriter:
        return PngWriter(dict(self.options))


def save(image: DataFrame, path: str, band_rows: int = BAND_ROWS) -> None:
    """Write each image as <path>/<image>.png; a name that is there is replaced. An image that is not whole fails the write, and no file of it appears."""
    spark = image.sparkSession
    spark.dataSource.register(PngSink)
    bands = _bands(image, band_rows)
    heights = image.groupBy("image").agg((F.max("y") + 1).cast("int").alias("total_height"))
    rows = bands.join(heights, "image").withColumn("name", F.col("image").cast("string"))
    rows.repartition("image").sortWithinPartitions("image", "band").write.format("png_bands").mode("append").option("path", path).option("bandRows", band_rows).save()
