"""Folds by runs, names to a fixed point, tiles with finishing passes and resampling, each against a plain loop."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry
from tilewright.functions import pixels as P
from tilewright.operators import commerce, jobs, ledger, ordered
from tilewright.operators import pixels as O
from tilewright.streaming.folds import _advance


def _owed_loop(events, limit):
    owed, was = 0, None
    for _, month, kind, n in sorted(events, key=lambda e: e[0]):
        if kind == "add":
            owed = min(limit, owed + n)
        elif kind == "ack":
            owed = max(0, owed - n)
        elif kind == "read" and month is not None and was is not None and month != was:
            owed = 0
        if kind in ("read", "ack") and month is not None:
            was = month
    return owed


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_owed_equals_an_ordered_loop(spark, monkeypatch, bits):
    """The limit stops every add, not the end; runs of 2, 8 and 4096 numbers."""
    monkeypatch.setattr(ordered, "RUN_BITS", bits)
    rng = random.Random(bits)
    meters = ["dev%d" % k for k in range(30)] + ["iph1", "iph2"]
    rows = [(m, seq, rng.choice(["2024-01", "2024-02", None]), rng.choice(["add", "add", "add", "ack", "read", "noise"]), rng.randrange(30)) for m in meters for seq in rng.sample(range(200), rng.randrange(1, 25))]
    rows += [("hot", k, "2024-01", "ack" if k % 3 == 2 else "add", k % 11) for k in range(400)] + [("cap", 1, "2024-01", "add", 25), ("cap", 2, "2024-01", "ack", 5)]
    rng.shuffle(rows)
    got = {r["meter"]: r["owed"] for r in ledger.owed(spark.createDataFrame(rows, "meter string, seq long, month string, kind string, n long")).collect()}
    by = {}
    for m, *e in rows:
        by.setdefault(m, []).append(e)
    assert got == {m: _owed_loop(e, 30 if m.startswith("iph") else 10) for m, e in by.items()} and got["cap"] == 5
    assert ledger.owed(spark.createDataFrame([], "meter string, seq long, month string, kind string, n long")).count() == 0


def test_fold_of_an_item_with_a_third_of_all_events(spark):
    rng = random.Random(6)
    kinds = ["started", "device", "progress", "progress", "progress", "saving", "noise"]
    rows = [(0, k, rng.choice(kinds), rng.randrange(500), rng.choice([0, 400]), rng.choice(["GPU", "CPU", None])) for k in range(3000)]
    rows += [(1 + k % 40, k, rng.choice([*kinds, "completed", "failed"]), rng.randrange(9), 9, "CPU") for k in range(6000)]
    rows += [(50, 1, "progress", None, 5, None), (50, 2, "progress", 3, None, None), (50, 3, "saving", 0, 0, None), (51, 1, "completed", 0, 0, None)]
    want = {}
    for item in {r[0] for r in rows} | {60}:
        state = ("waiting", 0, 0, None, 0)
        for _, _, kind, done, total, device in sorted((r for r in rows if r[0] == item and r[2] != "noise"), key=lambda r: r[1]):
            if state[0] in jobs.TERMINAL:
                break
            if kind == "progress" and done is None or kind == "saving" and state[2] is None:
                state = (*state[:4], state[4] + 1)
                continue
            state = _advance(state, kind, done, total, device)
        want[item] = state
    rng.shuffle(rows)
    got = jobs.fold_items(spark.createDataFrame([(i,) for i in want], "item long"), spark.createDataFrame(rows, "item long, seq long, kind string, done long, total long, device string").repartition(9))
    assert {r["item"]: tuple(r)[1:] for r in got.collect()} == want


def _names_loop(files, taken, stamp):
    held, out = set(taken), {}
    for d, stem, ext, o in sorted(files, key=lambda f: f[3]):
        for n in range(1, 1000):
            name = f"{stem}.{ext}" if n == 1 else f"{stem}-{n}.{ext}"
            if (d, name) not in held:
                break
        else:
            name = f"{stem}-{stamp}.{ext}"
        held.add((d, name))
        out[d, o] = name
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_equal_a_sequential_loop(spark, seed):
    """Stems that look like numbered names of other stems, in both orders; no two files share a name."""
    rng = random.Random(seed)
    stems = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-02", "a-1", "a-1000", "b", "a-2-2-2"]
    files = [(rng.choice("xy"), rng.choice(stems), rng.choice(["png", "png", "jpg"]), o) for o in rng.sample(range(1000), 60)]
    taken = [(rng.choice("xy"), rng.choice(["a.png", "a-2.png", "a-4.png", "b-2.jpg", "a-2-2.png", "other"])) for _ in range(4)]
    got = ledger.safe_names(spark.createDataFrame(files, "dir string, stem string, ext string, ordinal long"), spark.createDataFrame(taken, "dir string, name string"), F.lit(1)).collect()
    assert {(r["dir"], r["ordinal"]): r["name"] for r in got} == _names_loop(files, taken, 1)
    assert len({(r["dir"], r["name"]) for r in got}) == len(got) == len(files)


def test_the_named_clash(spark):
    files = spark.createDataFrame([("d", "a", "png", 1), ("d", "a", "png", 2), ("d", "a-2", "png", 3)], "dir string, stem string, ext string, ordinal int")
    taken = spark.createDataFrame([], "dir string, name string")
    assert [r["name"] for r in ledger.safe_names(files, taken).orderBy("ordinal").collect()] == ["a.png", "a-2.png", "a-2-2.png"]
    assert ledger.safe_names(files.limit(0), taken).count() == 0


def test_a_folder_of_one_stem(spark):
    files = spark.range(2500).selectExpr("'d' as dir", "'a' as stem", "'png' as ext", "id * 3 as ordinal")
    got = {r["ordinal"]: r["name"] for r in ledger.safe_names(files, spark.createDataFrame([("d", "a-5.png")], "dir string, name string"), F.lit(77)).collect()}
    assert len(got) == 2500 and got[0] == "a.png" and got[3 * 4] == "a-6.png" and got[3 * 997] == "a-999.png" and got[3 * 998] == "a-77.png"


def _image(spark, w, h):
    rows = O.gradient(spark, w, h)
    return rows.select("image", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in O.CHANNELS])


@pytest.mark.parametrize("look", sorted(P.LOOKS))
def test_tiled_run_equals_the_whole_image(spark, look):
    """Every look, in the detail mode with its own neighbours too; doubled tiles averaged back, and with alpha."""
    w, h, pad = 13, 9, 1
    image = _image(spark, w, h)
    alpha = image.select("image", "x", "y", ((F.col("x") * 7 + F.col("y")) % 256).alias("a"))
    whole = O.as_bytes(O.with_look(O.enlarge_nearest(image, 2), look, 80, "detail"))
    want = O.with_alpha(O.box_resample(whole, 2), alpha, 1).select("x", "y", *O.CHANNELS, "a")
    got = O.run_tiles(image, w, h, 2, 1, 4, pad, look, 80, "detail", alpha)
    assert sorted(map(tuple, got.select("x", "y", *O.CHANNELS, "a").collect())) == sorted(map(tuple, want.collect()))


def test_stopped_runs_write_whole_bands_only(spark):
    image = _image(spark, 10, 10)
    both = image.unionByName(image.withColumn("image", F.lit(5).cast("long")))
    stops = spark.createDataFrame([(0, 5), (0, 8)], "image long, tile long")  # 3 x 3 tiles of 4: tile 5 is in the second band
    got = O.run_tiles(both, 10, 10, 2, 2, 4, 1, "sharp", 50, stops=stops)
    assert {r["image"]: (r["n"], r["top"]) for r in got.groupBy("image").agg(F.count("*").alias("n"), F.max("y").alias("top")).collect()} == {0: (20 * 8, 7), 5: (400, 19)}
    assert O.run_tiles(both, 10, 10, 2, 2, 4, 1, stops=stops.selectExpr("image", "0L as tile")).select("image").distinct().collect() == [(5,)]


def test_a_task_has_few_pixels(spark, monkeypatch):
    """Many images, and tiles of more pixels than a task takes: tasks are as many as the pixels need, and the results stay."""
    w, h = 8, 8
    many = _image(spark, w, h).drop("image").crossJoin(spark.range(40).select(F.col("id").alias("image"))).select("image", "x", "y", *[(F.col(c) * (F.col("image") + 1) / 40).alias(c) for c in O.CHANNELS])
    alpha = many.select("image", "x", "y", ((F.col("x") * 7 + F.col("y")) % 256).alias("a"))
    stops = spark.createDataFrame([(3, 4), (9, 0)], "image long, tile long")
    run = lambda target: O.run_tiles(many, w, h, 2, target, 3, 1, "soft", 60, "detail", alpha if target == 1 else None, stops)
    largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    rows = lambda df: sorted(map(tuple, df.collect()))
    want, shrunk = rows(run(2)), rows(run(1))
    assert len(want) == (38 * 8 + 3) * 2 * 16 and len(shrunk) == (38 * 8 + 3) * 8
    monkeypatch.setattr(O, "TASK_PIXELS", 2000, raising=False)
    assert largest(run(2)) < 2000 and rows(run(2)) == want and rows(run(1)) == shrunk
    monkeypatch.setattr(O, "TASK_PIXELS", 90, raising=False)  # a tile has up to 100
    assert rows(run(1)) == shrunk


@pytest.mark.parametrize("sizes", [(7, 5, 3, 2), (6, 6, 3, 3), (5, 4, 5, 4), (3, 2, 7, 5), (9, 1, 4, 1), (1, 8, 1, 3)])
def test_resampling_weighs_areas(spark, sizes):
    w, h, ow, oh = sizes
    image = O.gradient(spark, w, h)
    px = {(r["x"], r["y"]): r["r"] for r in image.collect()}
    part = lambda a, n, i, m: max(Fraction(0), min(Fraction(a + 1, n), Fraction(i + 1, m)) - max(Fraction(a, n), Fraction(i, m)))
    want = {(i, j): int(sum(v * part(x, w, i, ow) * part(y, h, j, oh) for (x, y), v in px.items()) * ow * oh + Fraction(1, 2)) for i in range(ow) for j in range(oh)}
    assert {(r["x"], r["y"]): r["r"] for r in O.area_resample(image, w, h, ow, oh).collect()} == want


def test_thumbnails_of_several_sizes(spark):
    image = O.gradient(spark, 40, 10).unionByName(O.gradient(spark, 3, 9).withColumn("image", F.lit(1).cast("long"))).unionByName(O.checkerboard(spark, 64, 1, 1).withColumn("image", F.lit(2).cast("long")))
    sizes = {r["image"]: (r["w"], r["h"]) for r in O.thumbnails(image, 10).groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect()}
    assert sizes == {0: (10, 3), 1: (3, 9), 2: (10, 1)}
    small = lambda d: sorted(tuple(r) for r in d.filter("image = 1").select("x", "y", *O.CHANNELS).collect())
    assert small(O.thumbnails(image, 10)) == small(image)  # one that fits comes as it is
    w, h = geometry.fitted_size(F.col("w"), F.col("h"), 2600)
    df = spark.createDataFrame([(5200, 3), (2600, 2600), (10, 10), (100000, 2)], "w long, h long").select(w.alias("a"), h.alias("b"))
    assert [tuple(r) for r in df.collect()] == [(2600, 2), (2600, 2600), (10, 10), (2600, 1)]


def test_fixture_images(spark):
    scene = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in O.scene(spark, 16, 8).collect()}
    assert scene[0, 0] == (0, 0, 40) and scene[8, 4] == (230, 4 * 255 // 7, 40) and scene[15, 7] == (255, 255, 200) and len(scene) == 128
    board = {(r["x"], r["y"]): r["r"] for r in O.checkerboard(spark, 6, 4, 2).collect()}
    assert board == {(x, y): 255 if (x // 2 + y // 2) % 2 == 0 else 0 for x in range(6) for y in range(4)}


def test_ranks_and_activations_across_ranges(spark, monkeypatch):
    """One group, one day and one machine hold most rows; many small ranges cut them."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), rng.randrange(4), k) for k in range(300)]
        got = ledger.rank_in_order(spark.createDataFrame(rows, "g string, day int, id long"), "g", ["day", "id"], "rank").collect()
        for g in {r[0] for r in rows}:
            assert [r["rank"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["day"], r["id"]))] == list(range(1, sum(r[0] == g for r in rows) + 1))
        pasted = [("m" if k % 4 else rng.choice("xy"), k, rng.choice(["k1", " k1", "k2", "k2", "k2", None]), 10 * k) for k in range(400)]
        out = {(r["machine"], r["seq"]): (r["already_active"], r["activated_at"]) for r in commerce.activations(spark.createDataFrame(pasted, "machine string, seq long, key string, at long")).collect()}
        held, want = {}, {}
        for machine, seq, key, at in pasted:
            key = key and key.strip()
            again = key is not None and machine in held and held[machine][0] == key
            held[machine] = held[machine] if again else (key, at)
            want[machine, seq] = (again, held[machine][1])
        assert out == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_callers_model_fails_by_tile(spark):
    """Raising and wrong sizes stop the band and what follows of that image alone."""

    def by_three(tile, scale):
        import numpy as np
        import pyarrow as pa

        x, y, r, g, b = (tile.column(c).to_numpy() for c in ("x", "y", "r", "g", "b"))
        if r[0] == 7:
            raise MemoryError
        n = scale * scale
        places = [np.repeat(x, n) * scale + np.tile(np.arange(n) % scale, len(x)), np.repeat(y, n) * scale + np.tile(np.arange(n) // scale, len(x))]
        if r[0] == 8:
            places[0] = places[0] * 0
        return pa.table([*places, *[np.repeat(v, n) for v in (r, g, b)]], names=["x", "y", "r", "g", "b"])

    image = _image(spark, 7, 6)
    both = image.withColumn("r", F.lit(0.5)).unionByName(image.withColumn("image", F.lit(1).cast("long")).withColumn("r", F.when(F.expr("y >= 3 and y < 6 and x < 3"), 7.0).otherwise(0.25)))
    both = both.unionByName(image.withColumn("image", F.lit(2).cast("long")).withColumn("r", F.when(F.expr("y < 3 and x >= 3 and x < 6"), 8.0).otherwise(0.25)))
    got = O.run_tiles(both, 7, 6, 3, 3, 3, 0, backend=O.contained(by_three))
    assert {r["image"]: (r["n"], r["y"]) for r in got.groupBy("image").agg(F.count("*").alias("n"), F.max("y").alias("y")).collect()} == {0: (21 * 18, 17), 1: (21 * 9, 8)}
    whole = sorted(map(tuple, O.run_tiles(image, 7, 6, 3, 1, 3, 1, "soft", 70, backend=O.contained(by_three)).collect()))
    assert whole == sorted(map(tuple, O.run_tiles(image, 7, 6, 3, 1, 3, 1, "soft", 70).collect()))


def test_sizes_of_images_are_not_gathered_on_the_driver(spark):
    tiles = spark.range(3000).select(F.expr("id div 6").alias("image"), F.expr("id div 3 % 2").alias("band"), F.expr("id % 3").alias("col"))
    out = jobs.tile_progress(tiles)
    assert sorted(r["done"] for r in out.filter("image = 7").collect()) == [1, 2, 3, 4, 5, 6] and {r["total"] for r in out.collect()} == {6}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
