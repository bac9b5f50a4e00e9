"""Known answers of scalar functions."""

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import pixels as P
from tilewright.functions import text as T
from tilewright.operators import jobs, ledger, policy, registry
from tilewright.sources import images


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first().asDict()


def big(n):
    return F.lit(n).cast("long")


def test_plan_geometry(spark):
    p = one(spark, **G.plan(big(100), big(90), big(4), big(4), big(40)))
    assert (p["cols"], p["bands"], p["tiles"], p["out_w"], p["out_h"]) == (3, 3, 9, 400, 360)
    assert one(spark, **G.plan(big(100), big(90), big(4), big(4), big(1)))["tile"] == 16


MIB = 1 << 20


@pytest.mark.parametrize(
    ("width", "scale", "tile_mib", "band_mib", "ceiling", "expected"),
    [(4000, 4, 2048, 2048, 256, (256, True)), (8000, 4, 512, 60, 256, (128, True)), (16000, 4, 512, 1, 256, (64, False)), (100, 2, 512, 512, 40, (40, True))],
)
def test_adaptive_tile(spark, width, scale, tile_mib, band_mib, ceiling, expected):
    tile, fits = G.adaptive_tile(big(width), big(scale), big(tile_mib * MIB), big(band_mib * MIB), big(8), big(ceiling))
    r = one(spark, tile=tile, fits=fits)
    assert (r["tile"], r["fits"]) == expected


def test_budgets(spark):
    for free, vram, gpu, expected in [(8192, 4096, True, (512, 512)), (4096, 200, True, (64, 512)), (640, 0, False, (160, 160)), (256, 0, False, (64, 64)), (0, 0, False, (512, 512))]:
        tile, band = G.budgets(big(free * MIB), big(vram * MIB), F.lit(gpu))
        r = one(spark, tile=tile, band=band)
        assert (r["tile"] // MIB, r["band"] // MIB) == expected


def test_scales_views_and_bytes(spark):
    assert [one(spark, s=registry.product_scales(big(s)))["s"] for s in (4, 2, 3)] == [[2, 4], [2], [3]]
    z, x, y = G.fit_view(*(F.lit(float(v)) for v in (4000, 2000, 1000, 600)))
    assert one(spark, z=z)["z"] == pytest.approx(944 / 4000)
    assert one(spark, z=G.fit_view(*(F.lit(float(v)) for v in (50, 40, 1000, 600)))[0])["z"] == 1
    assert one(spark, z=G.fit_view(*(F.lit(float(v)) for v in (50, 40, 0, 600)))[0])["z"] is None
    assert [one(spark, v=P.to_u8(F.lit(v)))["v"] for v in (-0.2, 1.4, 0.5)] == [0, 255, 128]


def test_looks(spark):
    red = tuple(F.lit(v) for v in (0.9, 0.2, 0.2))
    grey = 0.5 + (0.2126 * 0.9 + 0.7152 * 0.2 + 0.0722 * 0.2 - 0.5) * 1.18
    r = one(spark, **dict(zip("rgb", P.look("mono", red, red, 100), strict=True)))
    assert all(v == pytest.approx(grey) for v in r.values())
    flat = tuple(F.lit(0.5) for _ in range(3))
    for name in P.LOOKS:
        assert list(one(spark, **dict(zip("rgb", P.look(name, red, red, 0), strict=True))).values()) == [0.9, 0.2, 0.2]
    for name in ("natural", "vivid", "product", "sharp"):
        assert all(v == pytest.approx(0.5) for v in one(spark, **dict(zip("rgb", P.look(name, flat, flat, 100), strict=True))).values())
    warm = one(spark, **dict(zip("rgb", P.look("warm", flat, flat, 100), strict=True)))
    assert 0.5 < warm["r"] < 0.6 and 0.4 < warm["b"] < 0.5


def test_labels(spark):
    months = {0: "1970-01", 1760000000: "2025-10", 1709208000: "2024-02", 1735689600: "2025-01", 4102444800: "2100-01"}
    for s, m in months.items():
        assert one(spark, m=T.year_month(F.lit(s)))["m"] == m
    sizes = {500: "500 B", 1024 * 999: "999 KB", 1024 * 1000: "1.0 MB", 5 * MIB: "5.0 MB", 50 * MIB: "50 MB", 3 << 30: "3.0 GB", -1: "0 B"}
    for n, s in sizes.items():
        assert one(spark, s=T.format_bytes(big(n)))["s"] == s
    assert one(spark, s=T.period_label(F.lit("2026-11")))["s"] == "November 2026"
    assert one(spark, s=T.period_label(F.lit("2026-13")))["s"] == "2026-13"
    assert one(spark, s=T.period_label(F.lit("soon")))["s"] == "soon"
    assert one(spark, s=T.safe_stem(F.lit("..."), "image"))["s"] == "image"
    assert one(spark, s=T.safe_stem(F.lit(" a\\b "), "image"))["s"] == "a_b"
    assert one(spark, s=T.format_dimensions(big(1920), F.lit(None).cast("long")))["s"] == "1,920 × ?"
    assert one(spark, s=T.network_id(F.lit(""), F.lit("x")))["s"] is None
    assert one(spark, s=T.data_url(F.lit("a/b"), F.lit("x" * 100).cast("binary")))["s"].count("\n") == 0


def test_keys_and_endpoints(spark):
    k = T.key_parts(F.lit(" KEY1.eyJ2IjoxfQ\n.c2ln "), "KEY1.")
    assert one(spark, **k) == {"ok": True, "payload": '{"v":1}'}
    assert one(spark, **T.key_parts(F.lit("KEY1.a"), "KEY1."))["ok"] is False
    assert one(spark, **T.parse_endpoint(F.lit("https://a.b/c/d")))== {"host": "a.b", "port": 443, "path": "/c/d", "error": None}
    assert one(spark, **T.parse_endpoint(F.lit("http://localhost:8080")))["port"] == 8080
    assert one(spark, **T.parse_endpoint(F.lit("http://a.b/")))["error"] == "plain http"
    assert one(spark, **T.parse_endpoint(F.lit("ftp://a.b/")))["error"] == "bad scheme"
    assert one(spark, **T.parse_endpoint(F.lit("https://a.b:99999/")))["error"] == "bad port"


def test_policy(spark):
    c = policy.capabilities(spark.createDataFrame([(1, None), (2, "pro"), (3, "studio")], "holder int, edition string")).collect()
    assert {r["holder"]: len(r["features"]) for r in c} == {1: 4, 2: 8, 3: 9}
    assert [r["features"] for r in c if r["holder"] == 3] == [[n for n, _ in policy.FEATURES]]
    s = one(spark, s=policy.normalise_settings(F.lit('{"general":{"theme":"dark","recentFilesLimit":99},"export":{"quality":"x"}}')))["s"]
    assert (s["theme"], s["recents_limit"], s["quality"], s["scale"]) == ("dark", 12, 90, 4)


def test_attempts(spark):
    run = lambda *o: one(spark, r=jobs.attempt_ladder(F.array(*map(F.lit, o)), F.lit(256)))["r"].asDict()
    assert run("open_failed", "ok", "ok") == {"result": "done", "attempts": 2, "device": "cpu", "ceiling": 128}
    assert run("oom", "oom", "oom")["result"] == "insufficient_resources"
    assert run("oom", "open_failed", "ok")["result"] == "engine_unavailable"


def test_import_many(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\0" * 20
    bomb = png[:16] + (40000).to_bytes(4, "big") * 2 + png[24:]
    files = {"ok.png": png, "text.png": b"hello", "gif.png": b"GIF89a....", "bomb.png": bomb, "cut.png": png[:14], "x.txt": b"a"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    rows = images.import_many(spark, [str(tmp_path / n) for n in [*files, "gone.png"]]).collect()
    assert [r["error_code"] for r in rows] == [None, "invalid_image", "unsupported_format", "file_too_large", "invalid_image", "unsupported_format", "file_missing"]
    assert (rows[0]["width"], rows[0]["height"]) == (640, 480)
    with pytest.raises(ValueError):
        images.import_many(spark, ["a"] * 201)


def test_safe_names_and_upserts(spark):
    files = spark.createDataFrame([("d", "same", "png", i) for i in range(3)], "dir string, stem string, ext string, ordinal int")
    taken = spark.createDataFrame([("d", "same.png"), ("d", "same-3.png")], "dir string, name string")
    assert [r["name"] for r in ledger.safe_names(files, taken).orderBy("ordinal").collect()] == ["same-2.png", "same-4.png", "same-5.png"]
    pool = spark.createDataFrame([("KEY1.a",)], "key string")
    lines = spark.createDataFrame([("x KEY1.a y",), ("KEY1.b",), ("KEY1.b",), ("none",)], "line string")
    assert [r["key"] for r in ledger.import_keys(pool, lines, r"KEY1\.").collect()] == ["KEY1.b"]


def test_signatures(spark):
    import base64
    import hashlib
    import hmac

    from tilewright.functions import signatures as Z

    sign = lambda k, m: hmac.new(k, m.encode(), hashlib.sha256).digest()
    secret = base64.b64encode(b"key").decode()
    rows = [("a", "100", "body", "t=100,v1=" + sign(b"key", "100.body").hex(), "v1,x v1," + base64.b64encode(sign(b"key", "a.100.body")).decode(), sign(b"key", "body").hex()), ("a", "100", "forged", "t=100,v1=00", "v1,x", "00"), ("a", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, at string, body string, h1 string, h2 string, h3 string")
    ok = lambda now: [tuple(r) for r in df.select(Z.timed_hex("key", F.col("h1"), F.col("body"), F.lit(now)), Z.listed_base64(secret, F.col("id"), F.col("at"), F.col("h2"), F.col("body"), F.lit(now)), Z.plain_hex("key", F.col("h3"), F.col("body"))).collect()]
    assert ok(400)[:2] == [(True, True, True), (False, False, False)] and not any(ok(400)[2])
    assert ok(401)[0] == (False, False, True)
