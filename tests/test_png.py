"""PNG files against plain zlib, hostile files, and images through a folder."""

import base64
import os
import random
import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tilewright.functions import png_codec as codec
from tilewright.operators import pixels as O
from tilewright.sources import png


def _file(w, h, depth, colour, rows, extra=(), interlace=0, filters=None):
    """A file by hand; rows are bytes, already packed."""
    raw = b"".join(bytes([filters[k] if filters else 0]) + r for k, r in enumerate(rows))
    parts = [codec.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)), *[codec.chunk(k, d) for k, d in extra], codec.chunk(b"IDAT", zlib.compress(raw)), codec.chunk(b"IEND", b"")]
    return codec.SIGNATURE + b"".join(parts)


def _pixels(content):
    return {(int(x), y): tuple(map(int, p)) for xs, y, row in codec.decode(content) for x, p in zip(xs, row, strict=True)}


def _plain(content):
    """Bytes of the rows by zlib alone."""
    return zlib.decompress(b"".join(d for k, d in codec.chunks(content) if k == b"IDAT"))


@pytest.mark.parametrize("channels", [3, 4])
@pytest.mark.parametrize("band_rows", [1, 3, 64])
def test_bands_make_one_file(spark, channels, band_rows):
    image = O.gradient(spark, 23, 17)
    other = image.select(F.lit(1).cast("long").alias("image"), *[c for c in image.columns if c != "image"])
    both = image.unionByName(other.withColumn("r", F.col("g")))
    both = both.withColumn("a", (F.col("x") * 9 + F.col("y")) % 256) if channels == 4 else both
    files = png.encode(both, band_rows)
    contents = {r["image"]: bytes(r["content"]) for r in files.collect()}
    want = {(r["image"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"] if channels == 4 else 255) for r in both.collect()}
    assert all(len(_plain(c)) == 17 * (1 + 23 * channels) for c in contents.values())
    back = {(r["image"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in png.decode(files).collect()}
    assert back == want


def test_filters_and_sums():
    rng = np.random.default_rng(1)
    for h, w, c in ((1, 1, 3), (5, 7, 4), (9, 2, 1), (6, 11, 3)):
        pixels = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        parts = [codec.encode_band(pixels[k : k + 2], k == 0) for k in range(0, h, 2)]
        total = 1
        for _, own, n in parts:
            total = codec.joined_sum(total, own, n)
        content = codec.file_head(w, h, c) + b"".join(codec.band_chunk(d, not k) for k, (d, _, _) in enumerate(parts)) + codec.file_end(total)
        assert zlib.adler32(_plain(content)) == total
        got = _pixels(content)
        assert all(got[x, y] == (tuple(map(int, pixels[y, x, :3])) if c > 1 else (int(pixels[y, x, 0]),) * 3) + ((int(pixels[y, x, 3]) if c == 4 else 255),) for x in range(w) for y in range(h))


def test_every_filter_is_undone():
    rng = random.Random(2)
    for step, depth, colour in ((1, 8, 0), (3, 8, 2), (4, 8, 6), (6, 16, 2), (8, 16, 6), (1, 4, 0)):
        w, h = 5, 10
        n = -(-w * codec.CHANNELS_OF[colour] * depth // 8)
        plain = [bytes(rng.randrange(256) for _ in range(n)) for _ in range(h)]
        kinds = [k % 5 for k in range(h)]
        filtered = []
        for k, row in enumerate(plain):
            out = bytearray()
            for i, v in enumerate(row):
                a, b = row[i - step] if i >= step else 0, plain[k - 1][i] if k else 0
                c = plain[k - 1][i - step] if k and i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append(v - (0, a, b, (a + b) // 2, near)[kinds[k]] & 255)
            filtered.append(bytes(out))
        assert _pixels(_file(w, h, depth, colour, filtered, filters=kinds)) == _pixels(_file(w, h, depth, colour, plain))


def test_depths_palette_and_transparency():
    assert _pixels(_file(3, 1, 1, 0, [b"\xa0"])) == {(0, 0): (255,) * 4, (1, 0): (0, 0, 0, 255), (2, 0): (255,) * 4}
    assert _pixels(_file(2, 1, 4, 0, [b"\x5f"], [(b"tRNS", b"\0\x05")])) == {(0, 0): (85, 85, 85, 0), (1, 0): (255,) * 4}
    assert _pixels(_file(2, 1, 2, 3, [b"\x40"], [(b"PLTE", bytes(range(6))), (b"tRNS", b"\x09")])) == {(0, 0): (3, 4, 5, 255), (1, 0): (0, 1, 2, 9)}
    assert _pixels(_file(1, 1, 16, 4, [b"\x80\x80\xff\x00"])) == {(0, 0): (128, 128, 128, 254)}
    assert _pixels(_file(1, 1, 16, 2, [b"\x00\x7f\x00\x81\xff\xff"], [(b"tRNS", b"\x00\x7f\x00\x81\xff\xff")])) == {(0, 0): (0, 1, 255, 0)}


def test_interlaced_equals_plain():
    w, h = 11, 9
    grey = np.arange(w * h, dtype=np.uint8).reshape(h, w)
    rows = [grey[y, x0::dx].tobytes() for x0, y0, dx, dy in codec.PASSES for y in range(y0, h, dy) if x0 < w]
    assert _pixels(_file(w, h, 8, 0, rows, interlace=1)) == _pixels(_file(w, h, 8, 0, [r.tobytes() for r in grey]))


def test_hostile_files(spark):
    good = _file(4, 3, 8, 2, [bytes(range(12))] * 3)
    cases = {
        "good": (good, None), "cut": (good[:-20], "invalid_image"), "empty": (b"", "invalid_image"), "null": (None, "invalid_image"), "not png": (b"\xff\xd8" + good, "invalid_image"),
        "flipped": (good[:45] + bytes([good[45] ^ 1]) + good[46:], "invalid_image"), "short stream": (_file(4, 4, 8, 2, [bytes(12)] * 3), "invalid_image"), "filter": (_file(4, 1, 8, 2, [bytes(12)], filters=[7]), "invalid_image"),
        "index": (_file(1, 1, 8, 3, [b"\x07"], [(b"PLTE", b"abc")]), None), "no palette": (_file(1, 1, 8, 3, [b"\0"]), "invalid_image"), "depth": (_file(1, 1, 3, 0, [b"\0"]), "invalid_image"),
        "bomb": (_file(60000, 60000, 8, 2, [bytes(9)]), "file_too_large"), "zero": (_file(0, 3, 8, 2, []), "invalid_image"), "critical": (_file(1, 1, 8, 0, [b"\0"], [(b"ABCD", b"")]), "invalid_image"),
        "longer": (_file(1, 1, 8, 0, [b"\0", b"\0"]), None),
    }
    cases["index"] = (cases["index"][0], "invalid_image")
    files = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in cases.items()], "image string, content binary")
    assert {r["image"]: r["error"] for r in png.faults(files).collect()} == {k: e for k, (_, e) in cases.items()}
    assert {r["image"] for r in png.decode(files).select("image").distinct().collect()} == {"good", "longer"}
    assert png.decode(files.limit(0)).count() == 0


def test_images_through_a_folder(spark, tmp_path):
    image = O.gradient(spark, 30, 21)
    both = image.unionByName(image.withColumn("image", F.lit(7).cast("long")).withColumn("b", F.col("r")))
    png.save(both, str(tmp_path / "out"), band_rows=4)
    assert sorted(os.listdir(tmp_path / "out")) == ["0.png", "7.png"]
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image"), "content")
    assert sorted(map(tuple, png.decode(files).select(*both.columns).collect())) == sorted(map(tuple, both.collect()))
    with pytest.raises(Exception, match="not whole"):
        png.save(image.filter("not (x = 3 and y = 9)"), str(tmp_path / "bad"), band_rows=4)
    assert not os.path.exists(tmp_path / "bad") or os.listdir(tmp_path / "bad") == []
    assert png.encode(image.filter("not (x = 3 and y = 9)")).collect()[0]["content"] is None


def test_the_jvm_reads_our_files(spark, tmp_path):
    """Spark's own image source, an independent reader, sees the same pixels."""
    image = O.gradient(spark, 9, 5)
    png.save(image, str(tmp_path / "out"), band_rows=2)
    seen = spark.read.format("image").load(str(tmp_path / "out")).select("image.*").collect()[0]
    data = np.frombuffer(bytes(seen["data"]), np.uint8).reshape(seen["height"], seen["width"], seen["nChannels"])
    assert {(r["x"], r["y"]): (r["b"], r["g"], r["r"]) for r in image.collect()} == {(x, y): tuple(map(int, data[y, x, :3])) for x in range(9) for y in range(5)}


def test_views_and_previews(spark):
    small, wide = O.gradient(spark, 6, 4), O.gradient(spark, 700, 3).withColumn("image", F.lit(1).cast("long"))
    clear = O.gradient(spark, 500, 2).withColumn("image", F.lit(2).cast("long")).withColumn("a", F.col("x") % 256)
    files = png.encode(small.unionByName(wide)).unionByName(png.encode(clear)).unionByName(spark.createDataFrame([(3, bytearray(b"no"))], "image long, content binary"))
    content = {r["image"]: bytes(r["content"]) for r in files.collect()}
    got = {r["image"]: r for r in png.views(files, 600).collect()}
    of = lambda url: codec.header_of(base64.b64decode(url.partition(",")[2]))[0]
    assert [got[k]["original"] for k in range(4)] == [True, False, True, None] and got[3]["error"] == "invalid_image" and got[3]["data_url"] is None
    assert base64.b64decode(got[0]["data_url"].removeprefix("data:image/png;base64,")) == content[0]
    assert (of(got[1]["data_url"]).width, of(got[1]["data_url"]).height, of(got[1]["data_url"]).colour, got[1]["delivered_edge"]) == (600, 3, 2, 600)
    shown = {r["image"]: r["preview"] for r in png.previews(files).collect()}
    assert [(of(shown[k]).width, of(shown[k]).height, of(shown[k]).colour) for k in (0, 1, 2)] == [(6, 4, 2), (480, 2, 2), (480, 2, 6)] and shown[3] is None
    tiny = png.views(files, 0).filter("image = 1").collect()[0]
    assert tiny["delivered_edge"] == 1 and of(tiny["data_url"]).width == 1
