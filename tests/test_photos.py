"""JPEG and PNG files upright, and previews of what was imported; JPEGs are written by the JVM's own writer."""

import base64
import os
import struct

import pytest
from pyspark.sql import functions as F

from tilewright.functions import png_codec as codec
from tilewright.operators import pixels as O
from tilewright.sources import photos, png


def _exif(turn, order=">"):
    head = b"MM\0*" if order == ">" else b"II*\0"
    block = b"Exif\0\0" + head + struct.pack(order + "I", 8) + struct.pack(order + "H", 2) + struct.pack(order + "HHIHH", 0x010F, 2, 1, 0, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0) + struct.pack(order + "I", 0)
    return b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block


@pytest.fixture(scope="module")
def jpeg(spark, tmp_path_factory):
    """Left half red, right half blue, a white band on top; 32 x 16."""
    image = spark._jvm.java.awt.image.BufferedImage(32, 16, 1)
    for x in range(32):
        for y in range(16):
            image.setRGB(x, y, 0xFFFFFF if y < 8 else 0xFF0000 if x < 16 else 0x0000FF)
    place = str(tmp_path_factory.mktemp("jpeg") / "plain.jpg")
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(place))
    with open(place, "rb") as f:
        return f.read()


def _seen(rows, x, y):
    """The nearest plain colour of a pixel."""
    r, g, b = rows[x, y]
    return min({"white": (255, 255, 255), "red": (254, 0, 0), "blue": (0, 0, 254)}.items(), key=lambda c: sum((p - q) ** 2 for p, q in zip(c[1], (r, g, b), strict=True)))[0]


@pytest.mark.parametrize("order", [">", "<"])
def test_turns_are_read(jpeg, order):
    assert [photos.turn_of(jpeg[:2] + _exif(t, order) + jpeg[2:]) for t in range(10)] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 1]
    assert photos.turn_of(jpeg) == 1 and photos.turn_of(b"") == 1 and photos.turn_of(b"\xff\xd8\xff\xe1\x00\x08Exif\0\0") == 1 and photos.turn_of((jpeg[:2] + _exif(6))[:-9]) == 1


def test_files_upright(spark, jpeg, tmp_path):
    #: Where the white band, and the red beside it, lie by turn.
    tops = {1: ((8, 2), (8, 12)), 2: ((8, 2), (24, 12)), 3: ((8, 13), (24, 3)), 4: ((8, 13), (8, 3)), 5: ((2, 8), (12, 8)), 6: ((13, 8), (3, 8)), 7: ((13, 8), (3, 24)), 8: ((2, 8), (12, 24))}
    for t in tops:
        (tmp_path / f"t{t}.jpg").write_bytes(jpeg[:2] + _exif(t) + jpeg[2:])
    png.save(O.gradient(spark, 5, 4), str(tmp_path / "png"))
    (tmp_path / "bad.jpg").write_bytes(jpeg[:200])
    (tmp_path / "note.jpg").write_bytes(b"text")
    paths = [*(str(tmp_path / f"t{t}.jpg") for t in tops), str(tmp_path / "png" / "0.png"), str(tmp_path / "bad.jpg"), str(tmp_path / "note.jpg"), str(tmp_path / "none.png")]
    rows = photos.upright_pixels(spark, paths).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"].rsplit("/", 1)[-1], {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"])
    for t, (white, red) in tops.items():
        own = by[f"t{t}.jpg"]
        assert (max(x for x, _ in own) + 1, max(y for _, y in own) + 1) == ((32, 16) if t < 5 else (16, 32)) and len(own) == 512
        assert (_seen(own, *white), _seen(own, *red)) == ("white", "red"), t
    assert by["0.png"] == {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in O.gradient(spark, 5, 4).collect()}
    assert "note.jpg" not in by and "none.png" not in by
    made = {r["name"]: r["preview"] for r in photos.import_with_previews(spark, paths).collect()}
    size = lambda url: (lambda h: (h.width, h.height, h.colour))(codec.header_of(base64.b64decode(url.partition(",")[2]))[0])
    assert size(made["t6.jpg"]) == (16, 32, 2) and size(made["0.png"]) == (5, 4, 2) and made["note.jpg"] is None and made["none.png"] is None
    assert photos.upright_pixels(spark, [str(tmp_path / "none.png")]).count() == 0


def test_grey_files(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(8, 8, 10)
    for x in range(8):
        for y in range(8):
            image.setRGB(x, y, 0xFFFFFF)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "g.jpg")))
    got = photos.upright_pixels(spark, [str(tmp_path / "g.jpg")]).agg(F.min("r").alias("r"), F.min("b").alias("b"), F.count("*").alias("n")).collect()[0]
    assert got["r"] >= 250 and got["b"] >= 250 and got["n"] == 64


def test_many_calls_come_as_one_table(spark, jpeg, tmp_path):
    """What a call a list gives, for three calls at once: whole, cut, missing, repeated and misnamed files, a folder, a JPEG."""
    png.save(O.gradient(spark, 6, 4).unionByName(O.gradient(spark, 3, 3).withColumn("image", F.lit(1).cast("long"))), str(tmp_path))
    os.makedirs(tmp_path / "d.png")
    whole = (tmp_path / "0.png").read_bytes()
    for name, content in {"cut.png": whole[:20], "text.png": b"no image", "a.jpg": whole, "b.webp": whole, "a [x]*.png": whole, "n.gif": whole, "damaged.png": whole[:-20]}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "p.jpeg").write_bytes(jpeg)
    names = ["0.png", "1.png", "0.png", "gone.png", "d.png", "cut.png", "text.png", "a.jpg", "b.webp", "a [x]*.png", "n.gif", "damaged.png", "p.jpeg"]
    calls = [[f"{tmp_path}/{n}" for n in names], [f"file:{tmp_path}/0.png", f"file://{tmp_path}/1.png", "", "a\0b.png"], [f"{tmp_path}/1.png"] * 200]
    asked = spark.createDataFrame([(c, k, p) for c, paths in enumerate(calls) for k, p in enumerate(paths)], "call int, ordinal int, path string")
    columns = ["ordinal", "path", "id", "name", "format", "width", "height", "error_code", "preview"]
    got = photos.import_calls_with_previews(spark, asked).select("call", *columns).collect()
    for call, paths in enumerate(calls):
        want = [tuple(r) for r in photos.import_with_previews(spark, paths).select(*columns).collect()]
        assert [tuple(r)[1:] for r in got if r["call"] == call] == want
    assert photos.import_calls_with_previews(spark, asked.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at most"):
        photos.import_calls_with_previews(spark, asked.withColumn("call", F.lit(1)))
