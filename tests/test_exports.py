"""Exports: byte copies under free names, twice into one folder, with faults, and nothing half written."""

import os

import pytest

from tilewright.operators import ledger as L
from tilewright.operators import pixels as O
from tilewright.sources import exports, png

KIND = "ordinal long, dir string, stem string, format string, content binary"


def test_exports_are_byte_copies_under_free_names(spark, tmp_path):
    content = bytes(png.encode(O.gradient(spark, 6, 4)).collect()[0]["content"])
    wide = bytes(png.encode(O.checkerboard(spark, 16400, 1, 8)).collect()[0]["content"])
    a, b = str(tmp_path / "a"), str(tmp_path / "b" / "c")
    os.makedirs(a)
    (tmp_path / "a" / "s-2.png").write_bytes(b"mine")
    rows = [(1, a, "s", "PNG", content), (2, a, "s", "png", content + b"x"), (3, b, " s<.", "png", content), (4, a, "s-4", "png", content), (5, a, "s", "png", content), (6, b, "...", "png", content), (7, a, "s", "webp", wide), (8, a, "s", "jpeg", content), (9, a, "s", "bmp", content), (10, a, "s", "png", None)]
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else bytearray(r[4])) for r in rows], KIND).repartition(3)
    got = {r["ordinal"]: r for r in exports.export(spark, df, stamp=7).collect()}
    assert {k: r["file_name"] for k, r in got.items() if r["error"] is None} == {1: "s.png", 2: "s-3.png", 3: "s_.png", 4: "s-4.png", 5: "s-5.png", 6: "image.png"}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {7: "export_limit", 8: "no_encoder", 9: "unknown_format", 10: "file_missing"}
    assert all(r["file_path"] is None and r["bytes"] is None for r in got.values() if r["error"])
    for ordinal, _, _, _, data in rows[:6]:
        with open(got[ordinal]["file_path"], "rb") as f:
            assert f.read() == data and got[ordinal]["bytes"] == len(data)
    assert sorted(os.listdir(a)) == ["s-2.png", "s-3.png", "s-4.png", "s-5.png", "s.png"] and (tmp_path / "a" / "s-2.png").read_bytes() == b"mine"
    again = {r["ordinal"]: r["file_name"] for r in exports.export(spark, df.filter("ordinal in (1, 6)")).collect()}
    assert again == {1: "s-6.png", 6: "image-2.png"}
    assert exports.export(spark, df.limit(0)).count() == 0


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    content = bytearray(png.encode(O.gradient(spark, 3, 3)).collect()[0]["content"])
    (tmp_path / "file").write_bytes(b"")
    df = spark.createDataFrame([(1, str(tmp_path / "ok"), "s", "png", content), (2, str(tmp_path / "file"), "s", "png", content)], KIND).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017  the second folder is a file
        exports.export(spark, df)
    assert not (tmp_path / "ok").exists() or os.listdir(tmp_path / "ok") == []


def test_numbers_go_on_beyond_999(spark):
    """Two stems of 1,005 and 1,003 files; some late numbers are taken, or are the end of another file's stem."""
    files = [("d", "s", "png", 2 * k + 1) for k in range(1005)] + [("d", "t", "png", 2 * k) for k in range(1003)] + [("d", "s-1002", "png", 5000), ("d", "t-3", "png", 5001)]
    taken = [("d", n) for n in ("s-1000.png", "s-1001.png", "s-1004.png", "s-7.png", "t-1000.webp", "s-1009.png", "s-01.png")]
    df = spark.createDataFrame(files, "dir string, stem string, ext string, ordinal long").repartition(3)
    got = {r["ordinal"]: r["name"] for r in L.safe_names(df, spark.createDataFrame(taken, "dir string, name string"), go_on=True).collect()}
    used, want = {n for _, n in taken} | {"s-1002.png"}, {}
    for _, stem, _, ordinal in sorted(files, key=lambda f: f[3]):
        k = 1
        while (name := f"{stem}{f'-{k}' if k > 1 else ''}.png") in used - ({"s-1002.png"} if stem == "s-1002" else set()):
            k += 1
        want[ordinal] = name
        used.add(name)
    assert got == want and len(set(got.values())) == len(files)
    assert {want[o] for o in (1995, 1997, 1999, 2003, 2009)} == {"s-999.png", "s-1003.png", "s-1005.png", "s-1007.png", "s-1011.png"}
