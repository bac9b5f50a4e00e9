"""Folds against a plain reducer, images against the nearest-pixel twin, queries against SQL."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tilewright.operators import jobs, ledger
from tilewright.operators import pixels as O
from tilewright.plans import catalog
from tilewright.sources import images
from tilewright.streaming import folds
from tilewright.streaming.folds import _advance

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

kinds = st.sampled_from(["started", "device", "progress", "saving", "completed", "failed", "cancelled", "noise"])
event = st.tuples(st.integers(0, 2), kinds, st.integers(0, 9), st.sampled_from([0, 9]), st.sampled_from(["GPU", "CPU"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, max_size=30))
def test_item_fold(spark, events):
    rows = [(e[0], i, *e[1:]) for i, e in enumerate(events)]
    expected = {}
    for item in range(3):
        state = ("waiting", 0, 0, None, 0)
        for _, _, kind, done, total, device in (r for r in rows if r[0] == item and r[2] != "noise"):
            if state[0] in jobs.TERMINAL:
                break
            state = _advance(state, kind, done, total, device)
        expected[item] = state
    got = jobs.fold_items(spark.createDataFrame([(i,) for i in range(3)], "item long"), spark.createDataFrame(rows, "item long, seq long, kind string, done long, total long, device string"))
    assert {r["item"]: tuple(r)[1:] for r in got.collect()} == expected


@pytest.mark.parametrize(("scale", "tile", "pad"), [(2, 5, 1), (3, 16, 8), (4, 7, 3)])
def test_tiles_put_together_equal_the_whole(spark, scale, tile, pad):
    image = O.gradient(spark, 23, 17)
    whole = sorted(map(tuple, O.enlarge_nearest(image, scale).collect()))
    assert sorted(map(tuple, O.tiled_enlarge(image, 23, 17, scale, tile, pad).collect())) == whole
    assert len(whole) == 23 * 17 * scale * scale


def test_blocks_of_an_extreme_image(spark):
    step = O.view_step(12, 48000, 2600)
    assert -(-48000 // step) == 2527 and -(-12 // step) == 1
    assert {tuple(r)[3:] for r in O.view_blocks(O.gradient(spark, 5, 5).selectExpr("image", "x", "y", "7 as r", "7 as g", "7 as b"), 2).collect()} == {(7, 7, 7)}


def _jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc0\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + b"\0" * 9


def test_import_of_hostile_files(spark, tmp_path):
    """Bombs, cut and disguised headers, folders and missing places: one outcome each, in order."""
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"
    files = {
        "bomb.jpg": _jpeg(40000, 40000), "three.jpg": b"\xff\xd8\xff", "ok.jpeg": _jpeg(640, 480, b"\xff\xe1\x01\x00" + b"\xff\xc0" * 127 + b"\xff\xff\xdb\x00\x04\0\0"), "scan.jpg": b"\xff\xd8\xff\xda\x00\x02" + _jpeg(9, 9)[2:],
        "wide.webp": b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (11).to_bytes(3, "little") + (6).to_bytes(3, "little"), "png.jpg": png + (5).to_bytes(4, "big") * 2, "zero.png": png + (0).to_bytes(4, "big") + (5).to_bytes(4, "big"),
        "a[1]*.png": png + (7).to_bytes(4, "big") + (8).to_bytes(4, "big"), "note.txt": b"x", "empty.png": b"", "gif.png": b"GIF89a" + b"\0" * 20,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder.png").mkdir()
    asked = [*files, "folder.png", "missing.png", "no/such/place.png"]
    rows = images.import_many(spark, ["", *(str(tmp_path / n) for n in asked), str(tmp_path / "ok.jpeg")]).collect()
    assert [r["ordinal"] for r in rows] == list(range(len(asked) + 2)) and rows[0]["error_code"] == "file_missing"
    got = {r["name"]: (r["error_code"], r["width"], r["height"]) for r in rows[1:]}
    assert got == {
        "bomb.jpg": ("file_too_large", 40000, 40000), "three.jpg": ("invalid_image", None, None), "ok.jpeg": (None, 640, 480), "scan.jpg": ("invalid_image", None, None), "wide.webp": (None, 12, 7), "png.jpg": ("unsupported_format", 5, 5),
        "zero.png": ("invalid_image", 0, 5), "a[1]*.png": (None, 7, 8), "note.txt": ("unsupported_format", None, None), "empty.png": ("invalid_image", None, None), "gif.png": ("unsupported_format", None, None),
        "folder.png": ("unsupported_format", None, None), "missing.png": ("file_missing", None, None), "place.png": ("file_missing", None, None),
    }
    assert rows[-1]["id"].endswith("/ok.jpeg") and rows[0]["id"] == ""
    with pytest.raises(ValueError):
        images.import_many(spark, ["a"] * 201)


def test_closed_months_are_forgiven(spark, tmp_path):
    """Spends come in several batches: a month that a later one has closed is neither counted nor kept."""
    batches = [[("dev1", "2024-02-03", 4), ("dev2", "2024-02-20", 2)], [("dev1", "2024-03-01", 1)], [("dev3", "2024-03-01", 1)], [("dev1", "2024-02-28", 5), ("dev2", "2020-01-01", 3), ("dev2", "2024-03-02", 2)], [("dev1", "2024-03-05", 2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "meter string, d string, n long").selectExpr("meter", "to_timestamp(d) as ts", "n").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        for f in (tmp_path / "in" / f"b{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("meter string, ts timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen, state = [], []

    def keep(batch, n):
        seen.extend((n, *r) for r in batch.collect())

    query = folds.stream_meter(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    last = {}
    for _, meter, month, used, left in sorted(seen):
        last[meter, month] = (used, left)
    assert last == {("dev1", "2024-02"): (4, 6), ("dev2", "2024-02"): (2, 8), ("dev1", "2024-03"): (3, 7), ("dev2", "2024-03"): (2, 8), ("dev3", "2024-03"): (1, 9)}
    assert state[-1] == 3  # February's rows are gone


def test_names_past_999_end_in_the_time(spark):
    files = spark.range(3).selectExpr("'d' as dir", "'a' as stem", "'png' as ext", "id as ordinal")
    taken = spark.range(1, 1000).selectExpr("'d' as dir", "if(id = 1, 'a.png', concat('a-', id, '.png')) as name").filter("name <> 'a-500.png'")
    got = [r["name"] for r in ledger.safe_names(files, taken, F.lit(1700000000123)).orderBy("ordinal").collect()]
    assert got == ["a-500.png", "a-1700000000123.png", "a-1700000000123.png"]


def test_owed_is_never_below_zero_nor_above_the_limit(spark):
    rows = [("a", 1, "2024-01", "add", 4), ("a", 2, "2024-01", "ack", 6), ("a", 3, "2024-01", "add", 3), ("b", 1, "2024-01", "read", 0), ("b", 2, "2024-01", "add", 9), ("b", 3, "2024-02", "read", 0), ("b", 4, "2024-02", "add", 1), ("iphc", 1, "2024-01", "add", 99)]
    got = {r["meter"]: r["owed"] for r in ledger.owed(spark.createDataFrame(rows, "meter string, seq long, month string, kind string, n long")).collect()}
    assert got == {"a": 3, "b": 1, "iphc": 30}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(map(clean, r)) for r in df.select(*cols).collect()), key=repr)
    result = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in cols]
    assert got == sorted((tuple(clean(r[i]) for i in at) for r in result.fetchall()), key=repr)
