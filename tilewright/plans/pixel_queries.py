"""Image queries over the embeddings table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import pixels as P
from tilewright.operators import pixels as O
from tilewright.operators.ordered import written
from tilewright.sources import png

Query = Callable[[SparkSession, str], DataFrame]
INTENSITY = 60


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.images_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the pixels of all images: three values make one."""
    values = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.sum(F.size("embedding"))).first()[0]
    return O.parts_for(spark, (values or 0) // 3)


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.as_bytes(_images(spark, sf_dir))


def unsharp_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.long_form(O.as_bytes(O.with_look(_images(spark, sf_dir), "original", 0, mode="detail", parts=_parts(spark, sf_dir))), None)


def looked(name: str) -> Query:
    return lambda spark, sf_dir: O.long_form(O.with_look(_images(spark, sf_dir), name, INTENSITY, parts=_parts(spark, sf_dir)))


def _alpha(image: DataFrame) -> DataFrame:
    return image.select("image", "x", "y", F.when((F.col("x") + F.col("y")) % 2 == 0, 120).otherwise(255).alias("a"))


def flatten_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _bytes(spark, sf_dir)
    a = F.when((F.col("x") + F.col("y")) % 2 == 0, 120).otherwise(255)
    return image.select("image", "x", "y", *[P.flatten_on_white(F.col(c), a).alias(c) for c in O.CHANNELS])


def alpha_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _bytes(spark, sf_dir)
    return O.with_alpha(O.enlarge_nearest(image, 2), _alpha(image), 2).select("image", "x", "y", *O.CHANNELS, "a")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = O.statistics(_images(spark, sf_dir))
    return s.select("image", *[F.round(c, 6).alias(c) for c in s.columns if c != "image"])


def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with alpha as PNG files, in bands of three rows, and back."""
    image = _bytes(spark, sf_dir)
    alpha = image.join(_alpha(image), ["image", "x", "y"])
    return png.decode(png.encode(alpha, band_rows=3))


def png_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is cut before its end, every fifth is over the pixel limit."""
    files = png.encode(_bytes(spark, sf_dir)).withColumn("content", F.when(F.col("image") % 3 == 0, F.expr("substring(content, 1, length(content) - 16)")).otherwise(F.col("content")))
    good = png.faults(files.filter("image % 5 <> 0"))
    return good.unionByName(png.faults(files.filter("image % 5 = 0"), max_pixels=63))


def png_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of PNG files, decoded again: whole images are shrunk to five, those of three rows and columns come as they are; some are cut."""
    image = _bytes(spark, sf_dir).filter("image % 2 = 0 or (x < 3 and y < 3)")
    files = png.encode(image).withColumn("content", F.when(F.col("image") % 7 == 0, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")))
    seen = png.views(files, 5)
    shown = seen.filter("error is null").withColumn("content", F.unbase64(F.substring_index("data_url", ",", -1)))
    facts = seen.select("image", "width", "delivered_edge", "original", "error")
    return facts.join(png.decode(shown.select("image", "content")), "image", "left")


def tiled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail, then soft, inside tiles of three with a halo of one; doubled, averaged back; every fourth run stops before a tile."""
    image = written(_images(spark, sf_dir), "images")  # read for its tiles, its alpha, its stops and their number
    stops = image.select("image").distinct().filter("image % 4 = 0").select("image", (F.col("image") % 9).alias("tile"))
    return O.run_tiles(image, 8, 8, 2, 1, 3, 1, "soft", INTENSITY, "detail", _alpha(image), stops)


def _doubled(tile, scale):
    """A model of one tile in numpy: every pixel four times; it fails on tiles whose first pixel is very dark, and cuts bright ones."""
    import numpy as np
    import pyarrow as pa

    x, y, r, g, b = (tile.column(c).to_numpy() for c in ("x", "y", "r", "g", "b"))
    if r[(x == x.min()) & (y == y.min())][0] < 0.35:
        raise ValueError("a dark corner")
    dx, dy = np.tile([0, 1], 2 * len(x)), np.tile([0, 0, 1, 1], len(x))
    keep = slice(0, -1) if r[(x == x.min()) & (y == y.min())][0] > 0.65 else slice(None)
    four = lambda v: np.repeat(v, scale * scale)
    made = [four(x) * scale + dx, four(y) * scale + dy, *map(four, (r, g, b))]
    return pa.table([v[keep] for v in made], names=["x", "y", "r", "g", "b"])


def backend_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's model in tiles of four without halo: bands before a tile that failed, by raising or by its size, are written."""
    return O.run_tiles(_images(spark, sf_dir), 8, 8, 2, 2, 4, 0, backend=O.contained(_doubled))


def queries() -> dict[str, Query]:
    return {
        "px_unsharp_detail": unsharp_detail,
        **{f"px_look_{name}": looked(name) for name in P.LOOKS},
        "px_box_resample_2x": lambda s, d: O.box_resample(_bytes(s, d), 2),
        "px_view_blocks": lambda s, d: O.view_blocks(_bytes(s, d), O.view_step(8, 8, 3)),
        "px_nearest_2x": lambda s, d: O.enlarge_nearest(_bytes(s, d), 2),
        "px_tile_roundtrip": lambda s, d: O.tiled_enlarge(_bytes(s, d), 8, 8, 2, 3, 1),
        "px_flatten_white": flatten_white,
        "px_alpha_nearest": alpha_nearest,
        "px_stats": stats,
        "px_png_roundtrip": png_roundtrip,
        "px_png_faults": png_faults,
        "px_png_views": png_views,
        "px_area_resample": lambda s, d: O.area_resample(_bytes(s, d), 8, 8, 5, 3),
        "px_thumbnails": lambda s, d: O.thumbnails(_bytes(s, d).filter("image % 2 = 0 or y < 3"), 5),
        "px_tiled_run": tiled_run,
        "px_backend_run": backend_run,
    }


# --- SQL (fixed values: the factors of the looks, stated once more) ---------------------------------

_PX = """
px0 AS (SELECT vec_id // 3 AS image, vec_id % 3 AS c, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings),
px1 AS (SELECT image, c, i, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 1.2::DOUBLE * e::DOUBLE)) AS v FROM px0),
px AS (SELECT image, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, max(CASE WHEN c = 0 THEN v END) AS r, max(CASE WHEN c = 1 THEN v END) AS g, max(CASE WHEN c = 2 THEN v END) AS b
       FROM px1 GROUP BY image, i HAVING count(*) = 3)"""
_BLUR = """
h AS (SELECT *, count(*) OVER w AS n, sum(r) OVER w AS hr, sum(g) OVER w AS hg, sum(b) OVER w AS hb FROM px WINDOW w AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
q AS (SELECT image, x, y, r, g, b, sum(hr) OVER w / sum(n) OVER w AS br, sum(hg) OVER w / sum(n) OVER w AS bg, sum(hb) OVER w / sum(n) OVER w AS bb
      FROM h WINDOW w AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
_U8 = """
u AS (SELECT image, x, y, CAST(floor(r * 255 + 0.5) AS INTEGER) AS r, CAST(floor(g * 255 + 0.5) AS INTEGER) AS g, CAST(floor(b * 255 + 0.5) AS INTEGER) AS b FROM px)"""
_LONG = "SELECT image, x, y, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM "
_ROUND = "SELECT image, x, y, unnest([0, 1, 2]) AS c, round(unnest([r, g, b]), 6) AS v FROM "


def _c(e: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {e}))"


def _sel(name: str, source: str, r: str, g: str, b: str, rest: str = "") -> str:
    return f"{name} AS (SELECT image, x, y, {r} AS r, {g} AS g, {b} AS b{rest} FROM {source})"


def _tone(name: str, source: str, s: float, c: float) -> str:
    grey = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
    return _sel(name, source, *[_c(f"({grey} + ({v} - {grey}) * {s!r} - 0.5) * {c!r} + 0.5") for v in "rgb"])


def _look_sql() -> dict[str, str]:
    k = INTENSITY / 100
    cast = lambda name, source, f: _sel(name, source, *[_c(f"{v} * {x!r}") for v, x in zip("rgb", f, strict=True)])
    mono = _c(f"(0.2126 * r + 0.7152 * g + 0.0722 * b - 0.5) * {1 + 0.18 * k!r} + 0.5")
    m = lambda v: f"(({v} - 0.5) * 1.18)"
    t = lambda v: _c(f"0.5 + {m(v)} / (1 + 0.42 * abs({m(v)}))")
    curve = lambda v: _c(f"{t(v)} + 0.06 * (1 - {t(v)}) * (1 - {t(v)})")
    key = "((r + g + b) / 3 - 0.5)"
    bodies = {
        "original": ("px", []),
        "natural": ("a", [_tone("a", "px", 1 + 0.12 * k, 1 + 0.06 * k)]),
        "vivid": ("a", [_tone("a", "px", 1 + 0.6 * k, 1 + 0.2 * k)]),
        "warm": ("a", [cast("a", "px", (1 + 0.07 * k, 1.0, 1 - 0.09 * k))]),
        "cool": ("a", [cast("a", "px", (1 - 0.07 * k, 1.0, 1 + 0.08 * k))]),
        "mono": ("a", [_sel("a", "px", *[f"{v} * {1 - k!r} + {mono} * {k!r}" for v in "rgb"])]),
        "cinematic": (
            "z",
            [_sel("a", "px", *map(curve, "rgb")), _sel("d", "a", *[_c(f"{v} + {f * 0.06 * k!r} * {key}") for v, f in zip("rgb", (1.0, 0.2, -1.2), strict=True)]), _tone("z", "d", 1 - 0.18 * k, 1.0)],
        ),
        "soft": ("a", [_BLUR, _sel("a", "q", *[_c(f"{v} + {0.35 * k!r} * (b{v} - {v}) + {0.02 * k!r}") for v in "rgb"])]),
        "portrait": (
            "z",
            [
                _BLUR,
                _sel("a", "q", *[_c(f"{v} + {0.28 * k!r} * (b{v} - {v})") for v in "rgb"]),
                cast("d", "a", (1 + 0.03 * k, 1.0, 1 - 0.02 * k)),
                _tone("f", "d", 1 - 0.06 * k, 1.0),
                _sel("z", "f", *[_c(f"{v} + {0.04 * k!r}") for v in "rgb"]),
            ],
        ),
        "sharp": ("a", [_BLUR, _sel("a", "q", *[f"{v} + {k!r} * ({v} - b{v})" for v in "rgb"])]),
        "product": ("z", [_BLUR, _sel("a", "q", *[f"{v} + {0.4 * k!r} * ({v} - b{v})" for v in "rgb"]), _tone("z", "a", 1 - 0.05 * k, 1 + 0.18 * k)]),
    }
    return {f"px_look_{name}": "WITH " + ", ".join([_PX, *steps]) + f" {_ROUND}{last}" for name, (last, steps) in bodies.items()}


def _blur_of(source: str, name: str) -> str:
    """CTEs name_h and name: source with br, bg, bb."""
    return f"""{name}_h AS (SELECT *, count(*) OVER w AS n, sum(r) OVER w AS hr, sum(g) OVER w AS hg, sum(b) OVER w AS hb FROM {source} WINDOW w AS (PARTITION BY image, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{name} AS (SELECT image, x, y, r, g, b, sum(hr) OVER w / sum(n) OVER w AS br, sum(hg) OVER w / sum(n) OVER w AS bg, sum(hb) OVER w / sum(n) OVER w AS bb FROM {name}_h WINDOW w AS (PARTITION BY image, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def _tiled_sql() -> str:
    """The whole image at once; rows from a stopped band on are missing."""
    k = INTENSITY / 100
    double = "n AS (SELECT image, CAST(x * 2 + dx AS INTEGER) AS x, CAST(y * 2 + dy AS INTEGER) AS y, r, g, b FROM px, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))"
    sharp = _sel("s", "q1", *[f"{v} + 0.5 * ({v} - b{v})" for v in "rgb"])
    soft = _sel("t", "q2", *[f"CAST(floor({_c(_c(f'{v} + {0.35 * k!r} * (b{v} - {v}) + {0.02 * k!r}'))} * 255 + 0.5) AS INTEGER)" for v in "rgb"])
    mean = ", ".join(f"CAST(floor(sum({v}) / 4.0 + 0.5) AS INTEGER) AS {v}" for v in "rgb")
    return f"""WITH {_PX}, {double}, {_blur_of("n", "q1")}, {sharp}, {_blur_of("s", "q2")}, {soft}, m AS (SELECT image, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {mean} FROM t GROUP BY image, x // 2, y // 2)
        SELECT *, CASE WHEN (x + y) % 2 = 0 THEN 120 ELSE 255 END AS a FROM m WHERE image % 4 <> 0 OR y // 3 < image % 9 // 3"""


def _area_sql(name: str, source: str, w: str, h: str, ow: str, oh: str, sides: str = "") -> str:
    """Means over the parts of the pixels under each new one, straight from the rule."""
    part = lambda v, n, m, i: f"greatest(0, least(({v} + 1) * {m}, ({i} + 1) * {n}) - greatest({v} * {m}, {i} * {n}))"
    area = f"{part('x', w, ow, 'i')} * {part('y', h, oh, 'j')}"
    values = ", ".join(f"CAST((2 * sum({v} * area) + any_value({w}) * any_value({h})) // (2 * any_value({w}) * any_value({h})) AS INTEGER) AS {v}" for v in "rgb")
    return f"""{name} AS (SELECT image, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, {values} FROM (SELECT *, {area} AS area FROM {source}, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) WHERE i < {ow} AND j < {oh}) WHERE area > 0 GROUP BY image, i, j)"""


def oracle_sql() -> dict[str, str]:
    sharp = _sel("a", "q", *[f"CAST(floor({_c(f'{v} + 0.5 * ({v} - b{v})')} * 255 + 0.5) AS INTEGER)" for v in "rgb"])
    near = "SELECT image, CAST(x * 2 + dx AS INTEGER) AS x, CAST(y * 2 + dy AS INTEGER) AS y, r, g, b FROM u, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)"
    flat = ", ".join(f"CAST(({v} * a + 255 * (255 - a)) // 255 AS INTEGER) AS {v}" for v in "rgb")
    return {
        "px_unsharp_detail": f"WITH {_PX}, {_BLUR}, {sharp} {_LONG}a",
        **_look_sql(),
        "px_box_resample_2x": f"WITH {_PX}, {_U8} SELECT image, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {', '.join(f'CAST(floor(sum({v}) / 4.0 + 0.5) AS INTEGER) AS {v}' for v in 'rgb')} FROM u GROUP BY image, x // 2, y // 2",
        "px_view_blocks": f"WITH {_PX}, {_U8} SELECT image, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, {', '.join(f'CAST((sum({v}) + count(*) // 2) // count(*) AS INTEGER) AS {v}' for v in 'rgb')} FROM u GROUP BY image, x // 3, y // 3",
        "px_nearest_2x": f"WITH {_PX}, {_U8} {near}",
        "px_tile_roundtrip": f"WITH {_PX}, {_U8} {near}",
        "px_flatten_white": f"WITH {_PX}, {_U8}, w AS (SELECT *, CASE WHEN (x + y) % 2 = 0 THEN 120 ELSE 255 END AS a FROM u) SELECT image, x, y, {flat} FROM w",
        "px_alpha_nearest": f"WITH {_PX}, {_U8}, n AS ({near}) SELECT n.*, CASE WHEN (x // 2 + y // 2) % 2 = 0 THEN 120 ELSE 255 END AS a FROM n",
        "px_png_roundtrip": f"WITH {_PX}, {_U8} SELECT *, CASE WHEN (x + y) % 2 = 0 THEN 120 ELSE 255 END AS a FROM u",
        "px_png_faults": f"WITH {_PX} SELECT DISTINCT image, CASE WHEN image % 3 = 0 THEN 'invalid_image' WHEN image % 5 = 0 THEN 'file_too_large' END AS error FROM px",
        "px_png_views": f"""WITH {_PX}, {_U8}, f AS (SELECT *, CASE WHEN image % 2 = 0 THEN 8 ELSE 3 END AS w, CASE WHEN image % 2 = 0 THEN 5 ELSE 3 END AS ow FROM u WHERE image % 2 = 0 OR (x < 3 AND y < 3)), {_area_sql("o", "f", "w", "w", "ow", "ow")},
            i AS (SELECT DISTINCT image, w, ow, image % 7 = 0 AS cut FROM f)
            SELECT i.image, CASE WHEN NOT cut THEN CAST(w AS BIGINT) END AS width, CASE WHEN NOT cut THEN CAST(ow AS BIGINT) END AS delivered_edge, CASE WHEN NOT cut THEN w = 3 END AS original, CASE WHEN cut THEN 'invalid_image' END AS error, o.x, o.y, o.r, o.g, o.b, CASE WHEN o.image IS NOT NULL THEN 255 END AS a
            FROM i LEFT JOIN o ON o.image = i.image AND NOT cut""",
        "px_area_resample": f"WITH {_PX}, {_U8}, {_area_sql('o', 'u', '8', '8', '5', '3')} SELECT * FROM o",
        "px_thumbnails": f"""WITH {_PX}, {_U8}, f AS (SELECT *, 8 AS w, CASE WHEN image % 2 = 0 THEN 8 ELSE 3 END AS h FROM u WHERE image % 2 = 0 OR y < 3),
            e AS (SELECT *, 5 AS ow, CASE WHEN image % 2 = 0 THEN 5 ELSE 2 END AS oh FROM f), {_area_sql("o", "e", "w", "h", "ow", "oh")} SELECT * FROM o""",
        "px_tiled_run": _tiled_sql(),
        "px_backend_run": f"""WITH {_PX}, {_U8}, n AS ({near}), bad AS (SELECT image, min(y // 4) AS band FROM px WHERE x % 4 = 0 AND y % 4 = 0 AND (r < 0.35 OR r > 0.65) GROUP BY image)
            SELECT n.* FROM n LEFT JOIN bad ON bad.image = n.image WHERE bad.band IS NULL OR n.y // 8 < bad.band""",
        "px_stats": f"""WITH {_PX}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, greatest(r, g, b) - least(r, g, b) AS s FROM px),
            d AS (SELECT *, abs(l - lag(l) OVER (PARTITION BY image, y ORDER BY x)) AS step, ntile(10) OVER (PARTITION BY image ORDER BY l, y, x) AS tenth FROM l)
            SELECT image, round(avg(l), 6) AS mean_luma, round(avg(r - b), 6) AS mean_warmth, round(avg(s), 6) AS mean_spread, round(avg(step), 6) AS mean_step,
                   round(avg(CASE WHEN tenth = 1 THEN l END), 6) AS dark, round(avg(CASE WHEN tenth = 10 THEN l END), 6) AS bright FROM d GROUP BY image""",
    }
