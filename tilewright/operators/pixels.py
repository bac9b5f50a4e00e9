"""Image tables: one row a pixel, with channels r, g, b in [0, 1] and its place x, y.

Neighbourhood passes use two window passes (along x, then along y), so an image of any size streams
through sorted partitions of single rows and columns; resampling and tiling are groupings on integer
coordinates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import pixels as P
from tilewright.functions.geometry import fitted_size
from tilewright.functions.scalars import VIEW_EDGE
from tilewright.operators.ordered import written

CHANNELS = ("r", "g", "b")
#: Pixels that a task sorts at a time, some 100 bytes each: a table of more is dealt to more tasks.
TASK_PIXELS = 1 << 19


def parts_for(spark: SparkSession, pixels: int) -> int:
    """Tasks for so many pixels. Neither a fixed number of partitions nor the size of a shuffle bounds a task: enlarged pixels shrink to a fortieth when they are written."""
    return max(spark.sparkContext.defaultParallelism, -(-pixels // TASK_PIXELS))


def images_from_vectors(vectors: DataFrame, side: int = 8) -> DataFrame:
    """vectors (vec_id, embedding of side * side values): three neighbours make an RGB image; an incomplete last one is dropped."""
    flat = vectors.select(
        F.expr("vec_id div 3").alias("image"), (F.col("vec_id") % 3).alias("c"), F.posexplode("embedding").alias("i", "e")
    ).withColumn("v", P.clamp01(0.5 + 1.2 * F.col("e").cast("double")))
    wide = flat.groupBy("image", "i").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate(CHANNELS)])
    return wide.dropna(subset=list(CHANNELS)).select("image", (F.col("i") % side).cast("int").alias("x"), F.expr(f"i div {side}").cast("int").alias("y"), *CHANNELS)


def blurred(image: DataFrame, keys: tuple[str, ...] = ("image",), parts: int | None = None) -> DataFrame:
    """With br, bg, bb: means of the 3 x 3 neighbours that exist; keys: the columns that tell one image, or tile, from another.

    parts: so many tasks sort the rows, and then the columns, of pixels (`parts_for`); without it they stay as they are
    dealt if that is by keys, and Spark's settings decide else.
    """
    dealt = lambda df, c: df.repartition(parts, *keys, c) if parts else df
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-1, 1)
    first = dealt(image, "y").select("*", F.count(F.lit(1)).over(across).alias("_n"), *[F.sum(c).over(across).alias(f"_{c}") for c in CHANNELS])
    second = dealt(first, "x").select(*image.columns, F.sum("_n").over(down).alias("_n"), *[F.sum(f"_{c}").over(down).alias(f"_{c}") for c in CHANNELS])
    return second.select(*image.columns, *[(F.col(f"_{c}") / F.col("_n")).alias(f"b{c}") for c in CHANNELS])


def _triple(prefix: str = "") -> P.Triple:
    return tuple(F.col(prefix + c) for c in CHANNELS)


def _blurs(name: str, intensity: int) -> bool:
    return name in ("soft", "portrait", "sharp", "product") and intensity > 0


def with_look(image: DataFrame, name: str, intensity: int, mode: str = "standard", keys: tuple[str, ...] = ("image",), parts: int | None = None) -> DataFrame:
    """The mode's own pass first (detail sharpens), then the look; columns r, g, b replaced.

    Looks that need no neighbours run without a window. parts: see `blurred`.
    """
    if mode == "detail":
        image = _replace(blurred(image, keys, parts), P.unsharp(_triple(), _triple("b"), P.DETAIL_STRENGTH)).drop("br", "bg", "bb")
    near = _blurs(name, intensity)
    source = blurred(image, keys, parts) if near else image
    return _replace(source, P.look(name, _triple(), _triple("b") if near else _triple(), intensity)).drop("br", "bg", "bb")


def _replace(image: DataFrame, to: P.Triple) -> DataFrame:
    return image.select(*[c for c in image.columns if c not in CHANNELS], *[v.alias(c) for v, c in zip(to, CHANNELS, strict=True)])


def as_bytes(image: DataFrame) -> DataFrame:
    return _replace(image, tuple(P.to_u8(F.col(c)) for c in CHANNELS))


def long_form(image: DataFrame, round_to: int | None = 6) -> DataFrame:
    """One row a channel value: image, x, y, c, v."""
    value = (lambda c: F.round(F.col(c), round_to)) if round_to is not None else F.col
    return image.select("image", "x", "y", F.inline(F.array(*[F.struct(F.lit(k).alias("c"), value(c).alias("v")) for k, c in enumerate(CHANNELS)])))


def box_resample(image: DataFrame, factor: int, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Byte image, shrunk by an integer factor: rounded means of factor x factor blocks, none of which lies in two of keys."""
    by = [F.expr(f"x div {factor}").cast("int").alias("x"), F.expr(f"y div {factor}").cast("int").alias("y")]
    return image.groupBy(*keys, *by).agg(*[F.floor(F.sum(c) / float(factor * factor) + 0.5).cast("int").alias(c) for c in CHANNELS])


def _overlaps(at: Column, n: Column | int, into: Column | int) -> Column:
    """Of n equal cells laid over `into` cells: which of these the cell `at` covers, and how much, in parts of which a whole one has n."""
    n, into = (v if isinstance(v, Column) else F.lit(v) for v in (n, into))
    low, high = at * into, (at + 1) * into
    cells = F.sequence(F.floor(low / n).cast("int"), F.floor((high - 1) / n).cast("int"))
    return F.transform(cells, lambda i: F.struct(i.alias("i"), (F.least(high, (i + 1) * n) - F.greatest(low, i * n)).cast("long").alias("w")))


def area_resample(image: DataFrame, width: Column | int, height: Column | int, out_width: Column | int, out_height: Column | int) -> DataFrame:
    """Byte image at any other size: every new pixel is the mean of the area it covers, halves up.

    Two passes, along x and then along y, each joining a pixel with the few cells of the new axis it
    overlaps; weights are whole numbers and sums are exact, so the order of rows does not matter. Sizes
    may be columns of image.
    """
    sides = {"_w": width, "_h": height, "_ow": out_width, "_oh": out_height}
    channels = [c for c in (*CHANNELS, "a") if c in image.columns]
    rows = image.withColumns({k: (v if isinstance(v, Column) else F.lit(v)) for k, v in sides.items()})
    weighted = lambda c: F.sum(F.col(c).cast("long") * F.col("o.w")).alias(c)
    across = rows.select("image", "y", "_w", "_h", "_oh", *channels, F.explode(_overlaps(F.col("x"), F.col("_w"), F.col("_ow"))).alias("o"))
    across = across.groupBy("image", "y", F.col("o.i").alias("x")).agg(*[weighted(c) for c in channels], *[F.first(k).alias(k) for k in ("_w", "_h", "_oh")])
    down = across.select("image", "x", "_w", "_h", *channels, F.explode(_overlaps(F.col("y"), F.col("_h"), F.col("_oh"))).alias("o"))
    down = down.groupBy("image", "x", F.col("o.i").alias("y")).agg(*[weighted(c) for c in channels], (F.first("_w").cast("long") * F.first("_h")).alias("_n"))
    return down.select("image", "x", "y", *[F.expr(f"(2 * {c} + _n) div (2 * _n)").cast("int").alias(c) for c in channels])


def thumbnails(image: DataFrame, edge: int = VIEW_EDGE) -> DataFrame:
    """Byte images, whatever their sizes, shrunk to fit a square of `edge`; those that fit come as they are."""
    sizes = image.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    out_w, out_h = fitted_size(F.col("width"), F.col("height"), edge)
    sized = image.join(sizes.withColumn("out_w", out_w).withColumn("out_h", out_h), "image")
    return area_resample(sized, *[F.col(c) for c in ("width", "height", "out_w", "out_h")])


def view_step(width: int, height: int, edge: int) -> int:
    return max(2, -(-max(width, height) // edge))


def view_blocks(image: DataFrame, step: int) -> DataFrame:
    """Byte image, block means in integers; blocks at the edges divide by the pixels they have."""
    by = [F.expr(f"x div {step}").cast("int").alias("x"), F.expr(f"y div {step}").cast("int").alias("y")]
    sums = image.groupBy("image", *by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_{c}") for c in CHANNELS])
    return sums.select("image", "x", "y", *[F.expr(f"(_{c} + n div 2) div n").cast("int").alias(c) for c in CHANNELS])


def enlarge_nearest(image: DataFrame, scale: int) -> DataFrame:
    """Every pixel as scale x scale pixels: the stand-in for a learned model."""
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    tall = image.select("*", F.explode(steps).alias("_dy"))
    wide = tall.select("*", F.explode(steps).alias("_dx"))
    return wide.select("image", (F.col("x") * scale + F.col("_dx")).alias("x"), (F.col("y") * scale + F.col("_dy")).alias("y"), *CHANNELS)


def to_tiles(image: DataFrame, width: int, height: int, tile: int, pad: int) -> DataFrame:
    """Pixels under each tile (band, col) whose padded area holds them: at most four or nine rows a pixel, no range join."""
    cols, bands = -(-width // tile), -(-height // tile)
    reach = lambda v, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(v) - pad) / tile).cast("int")), F.least(F.lit(n - 1), F.floor((F.col(v) + pad) / tile).cast("int")))
    return image.select("*", F.explode(reach("y", bands)).alias("band")).select("*", F.explode(reach("x", cols)).alias("col"))


def tiled_enlarge(image: DataFrame, width: int, height: int, scale: int, tile: int, pad: int) -> DataFrame:
    """Tiles with halo, each enlarged on its own, cropped and put together again."""
    big = nearest_tiles(to_tiles(image, width, height, tile, pad), scale)
    inside = F.expr(f"x div {tile * scale} = col and y div {tile * scale} = band")
    return big.filter(inside).select("image", "x", "y", *CHANNELS)


TILE = ("image", "band", "col")
#: A model: tiles (image, band, col, x, y, r, g, b) and a scale -> the same, every tile `scale` times as wide and high.
Backend = Callable[[DataFrame, int], DataFrame]


def nearest_tiles(tiles: DataFrame, scale: int) -> DataFrame:
    """Every pixel of every tile as scale x scale pixels."""
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    big = tiles.select("*", F.explode(steps).alias("_dy")).select("*", F.explode(steps).alias("_dx"))
    return big.select(*TILE, (F.col("x") * scale + F.col("_dx")).alias("x"), (F.col("y") * scale + F.col("_dy")).alias("y"), *CHANNELS)


def contained(run_tile: Callable[[pa.Table, int], pa.Table]) -> Backend:
    """A backend of a Python function on one tile's pixels (x, y, r, g, b, an Arrow table). A tile on which it raises gives
    no pixels, so the failure stays with its image (`failed_tiles`) and the other tiles and images go on."""

    def backend(tiles: DataFrame, scale: int) -> DataFrame:
        schema = tiles.select(*TILE, "x", "y", *CHANNELS).schema
        names = [f.name for f in schema.fields]

        def one(table: pa.Table) -> pa.Table:
            try:
                made = run_tile(table.select(["x", "y", *CHANNELS]), scale)
                keys = [pa.repeat(table.column(k)[0], made.num_rows).cast(table.schema.field(k).type) for k in TILE]
                return pa.table([*keys, *[made.column(c).cast(table.schema.field(c).type) for c in ("x", "y", *CHANNELS)]], names=names)
            except Exception:  # noqa: BLE001  whatever a caller's function raises is its tile's failure
                return table.select(names).slice(0, 0)

        return tiles.select(*names).groupBy(*TILE).applyInArrow(one, schema)

    return backend


def failed_tiles(tiles: DataFrame, big: DataFrame, scale: int) -> DataFrame:
    """image, band, col of tiles that did not come back scale times as wide and high, every pixel once."""
    want = tiles.groupBy(*TILE).agg((F.count(F.lit(1)) * scale * scale).alias("want"), *[(F.min(c) * scale).alias(f"lo_{c}") for c in "xy"], *[((F.max(c) + 1) * scale).alias(f"hi_{c}") for c in "xy"])
    got = big.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x", "y").alias("places"), *[F.min(c).alias(f"min_{c}") for c in "xy"], *[F.max(c).alias(f"max_{c}") for c in "xy"])
    right = (F.col("n") == F.col("want")) & (F.col("places") == F.col("want"))
    for c in "xy":
        right = right & (F.col(f"min_{c}") == F.col(f"lo_{c}")) & (F.col(f"max_{c}") == F.col(f"hi_{c}") - 1)
    return want.join(got, list(TILE), "left").filter(~F.coalesce(right, F.lit(False))).select(*TILE)


def run_tiles(
    image: DataFrame, width: int, height: int, scale: int, target: int, tile: int, pad: int, look: str = "original", intensity: int = 0, mode: str = "standard", alpha: DataFrame | None = None, stops: DataFrame | None = None, backend: Backend | None = None
) -> DataFrame:
    """The whole run on images (values in [0, 1]) of one size: tiles with halo, each enlarged by `scale`, finished
    by mode and look on its own, cropped to bytes, averaged down to `target` times the size and joined with alpha.

    The halo gives the finishing passes the neighbours they would have in the whole image, so tiles do
    not show: pad is 1 at least if a pass reads neighbours. stops (image, tile): the first tile, counted
    band by band, before which the run was cancelled. backend stands in for the nearest pixels; a tile that
    it gives back in another size has failed. The band of a tile that was cancelled or failed and the
    later bands of its image write no row, as a band is written only when all its tiles are done.

    If a pass reads neighbours or alpha is given, the pixels of image are counted first, and tasks are as many as they
    need. A task has whole tiles, so all passes share one shuffle, of pixels not yet enlarged; tiles of more than
    TASK_PIXELS are dealt by rows and columns instead.
    """
    cols = -(-width // tile)
    source = image.select("image", "x", "y", *CHANNELS)
    near = mode == "detail" or _blurs(look, intensity)
    pixels = source.count() if near or alpha is not None else 0
    spark = image.sparkSession
    parts = parts_for(spark, pixels * _padded(width, tile, pad) * _padded(height, tile, pad) * scale * scale // (width * height))
    whole = min(width, tile + 2 * pad) * min(height, tile + 2 * pad) * scale * scale <= TASK_PIXELS
    dealt = lambda df: df.repartition(parts, *TILE) if near and whole else df
    ends = [] if stops is None else [stops.select("image", F.expr(f"tile div {cols}").alias("band"))]
    if backend is None:
        running = _before(source, ends) if ends else source.withColumn("_stop", F.lit(None).cast("int"))
        tiles = to_tiles(running, width, height, tile, pad).filter("_stop is null or band < _stop").select(*TILE, "x", "y", *CHANNELS)
        big = nearest_tiles(dealt(tiles), scale)
    else:
        tiles = to_tiles(source, width, height, tile, pad).select(*TILE, "x", "y", *CHANNELS)
        big = written(backend(tiles, scale), "tiles")  # run once, whatever reads it
        ends.append(failed_tiles(tiles, big, scale).select("image", "band"))
        big = dealt(_before(big, ends).filter("_stop is null or band < _stop").drop("_stop"))
    finished = with_look(big, look, intensity, mode, TILE, None if whole else parts)
    inside = as_bytes(finished.filter(F.expr(f"x div {tile * scale} = col and y div {tile * scale} = band"))).select(*TILE, "x", "y", *CHANNELS)
    out = (inside if target == scale else box_resample(inside, scale // target, TILE)).select("image", "x", "y", *CHANNELS)
    return out if alpha is None else with_alpha(out, alpha, target, parts_for(spark, pixels * target * target))


def _padded(size: int, tile: int, pad: int) -> int:
    """Pixels along one side of an image, those in several tiles as often."""
    return sum(min(size, at + tile + pad) - max(0, at - pad) for at in range(0, size, tile))


def _before(rows: DataFrame, ends: list[DataFrame]) -> DataFrame:
    """rows of images with _stop, the first band that is not written, null if all are."""
    first = reduce(DataFrame.unionByName, ends).groupBy("image").agg(F.min("band").alias("_stop"))
    return rows.join(first, "image", "left")


def with_alpha(enlarged: DataFrame, alpha: DataFrame, scale: int, parts: int | None = None) -> DataFrame:
    """alpha (image, x, y, a) of the source joined to its enlargement by the nearest source pixel, in so many tasks if parts is given."""
    keyed = enlarged.withColumn("_sx", F.expr(f"x div {scale}").cast("int")).withColumn("_sy", F.expr(f"y div {scale}").cast("int"))
    source = alpha.select("image", F.col("x").alias("_sx"), F.col("y").alias("_sy"), "a")
    if parts:
        keyed, source = (df.repartition(parts, "image", "_sx", "_sy") for df in (keyed, source))
    return keyed.join(source, ["image", "_sx", "_sy"]).drop("_sx", "_sy")


def statistics(image: DataFrame) -> DataFrame:
    """Per image: mean luma, mean red minus blue, mean chroma spread, mean horizontal step of luma, means of the darkest and brightest tenth.

    One pass over the pixels sums everything by image and value of luma, combined before the shuffle.
    The tenths are cut exactly without sorting an image: sums of 4,096 ranges of luma give all ranges
    that lie wholly inside, and only the values of the one range that a cut goes through are put in order.
    """
    rows = image.withColumn("l", P.luma(_triple())).withColumn("s", F.greatest(*CHANNELS) - F.least(*CHANNELS)).withColumn("bucket", F.floor(F.col("l") * 4096))
    stepped = rows.withColumn("step", F.abs(F.col("l") - F.lag("l").over(Window.partitionBy("image", "y").orderBy("x"))))
    values = stepped.groupBy("image", "bucket", "l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") - F.col("b")).alias("warmth"), F.sum("s").alias("spread"), F.sum("step").alias("steps"), F.count("step").alias("n_steps"))

    order = Window.partitionBy("image").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("image")
    sums = ["warmth", "spread", "steps", "n_steps"]
    sizes = values.groupBy("image", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("l") * F.col("n")).alias("own"), *[F.sum(c).alias(c) for c in sums])
    placed = sizes.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(whole))
    placed = placed.withColumn("above", F.col("total") - F.col("below") - F.col("n"))
    # the first tenth takes the odd ones, the last has none of fewer than ten pixels
    dark, bright = F.expr("(total + 9) div 10"), F.expr("total div 10")
    cuts = placed.withColumn("low", F.least("n", F.greatest(F.lit(0), dark - F.col("below")))).withColumn("high", F.least("n", F.greatest(F.lit(0), bright - F.col("above"))))
    inside = cuts.groupBy("image").agg(
        F.first("total").alias("total"), F.first(dark).alias("n_dark"), F.first(bright).alias("n_bright"), F.sum("own").alias("own"), *[F.sum(c).alias(c) for c in sums],
        F.sum(F.when(F.col("low") == F.col("n"), F.col("own")).otherwise(0.0)).alias("dark_sum"), F.sum(F.when(F.col("high") == F.col("n"), F.col("own")).otherwise(0.0)).alias("bright_sum"),
    )
    through = cuts.filter("(low > 0 and low < n) or (high > 0 and high < n)").select("image", "bucket", "low", "high", F.col("n").alias("all"))
    by_value = Window.partitionBy("image", "bucket").orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select("image", "bucket", "l", "n").join(through, ["image", "bucket"]).withColumn("upto", F.sum("n").over(by_value))
    first, last = F.col("upto") - F.col("n"), F.col("all") - F.col("upto")  # pixels of lower and of higher values
    taken = lambda cut, before: F.greatest(F.lit(0), F.least("n", F.col(cut) - before))
    part = ranked.groupBy("image").agg(F.sum(F.when(F.col("low") < F.col("all"), F.col("l") * taken("low", first))).alias("dark_part"), F.sum(F.when(F.col("high") < F.col("all"), F.col("l") * taken("high", last))).alias("bright_part"))
    mean = lambda name: (F.when(F.col(f"n_{name}") > 0, (F.col(f"{name}_sum") + F.coalesce(f"{name}_part", F.lit(0.0))) / F.col(f"n_{name}"))).alias(name)
    every = lambda c, name: (F.col(c) / F.col("total")).alias(name)
    step = F.when(F.col("n_steps") > 0, F.col("steps") / F.col("n_steps")).alias("mean_step")
    return inside.join(part, "image", "left").select("image", every("own", "mean_luma"), every("warmth", "mean_warmth"), every("spread", "mean_spread"), step, mean("dark"), mean("bright"))


def gradient(spark, width: int, height: int) -> DataFrame:
    """A deterministic byte image (fixed values: the three formulas)."""
    return _grid(spark, width, height).select(F.lit(0).cast("long").alias("image"), "x", "y", F.expr("(x + y) % 255").alias("r"), F.expr("x * 3 % 251").alias("g"), F.expr("y * 7 % 249").alias("b"))


def scene(spark, width: int, height: int) -> DataFrame:
    """A deterministic byte image of a ramp with a disc and stripes (fixed values: the formulas)."""
    px = _grid(spark, width, height)
    disc = F.expr(f"pow(x - {width} / 2, 2) + pow(y - {height} / 2, 2) < pow({min(width, height)} / 4, 2)")
    return px.select(F.lit(0).cast("long").alias("image"), "x", "y", F.when(disc, 230).otherwise(F.expr(f"x * 255 div {max(width - 1, 1)}")).cast("int").alias("r"), F.expr(f"y * 255 div {max(height - 1, 1)}").cast("int").alias("g"), F.when(F.expr("(x div 4) % 2 = 0"), 40).otherwise(200).alias("b"))


def checkerboard(spark, width: int, height: int, cell: int) -> DataFrame:
    """A byte image of white and black squares, the first one white."""
    light = F.when(F.expr(f"(x div {cell} + y div {cell}) % 2 = 0"), 255).otherwise(0)
    return _grid(spark, width, height).select(F.lit(0).cast("long").alias("image"), "x", "y", *[light.alias(c) for c in CHANNELS])


def _grid(spark, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.expr(f"id div {width}").cast("int").alias("y"))
