"""Sizes of tiles, plans, budgets and views as column expressions over integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of sources, outputs and tiles.
MAX_SOURCE_PIXELS, MAX_SOURCE_BYTES, MAX_OUTPUT_PIXELS = 64_000_000, 200 * 1024 * 1024, 256_000_000
MIN_TILE, LEAST_TILE = 64, 16
MIB = 1024 * 1024
#: Zoom limits and the margin around a fitted image.
MIN_ZOOM, MAX_ZOOM, FIT_MARGIN = 0.02, 32.0, 28


def _div_up(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def tile_bytes(tile: Column, pad: Column, scale: Column) -> Column:
    side = (tile + 2 * pad) * scale
    return 3 * side * side * 4


def band_bytes(width: Column, tile: Column, scale: Column) -> Column:
    return width * scale * tile * scale * 3


def plan(width: Column, height: Column, scale: Column, target: Column, tile: Column) -> dict[str, Column]:
    t = F.greatest(tile, F.lit(LEAST_TILE))
    cols, bands = _div_up(width, t), _div_up(height, t)
    return {"tile": t, "cols": cols, "bands": bands, "tiles": cols * bands, "out_w": width * target, "out_h": height * target, "factor": F.greatest(F.lit(1), F.floor(scale / target).cast("long"))}


def fitted_size(width: Column, height: Column, edge: Column | int) -> tuple[Column, Column]:
    """Sides of an image shrunk to fit a square of `edge`, 1 at least; an image that fits keeps its own."""
    edge = F.greatest(F.lit(1), edge if isinstance(edge, Column) else F.lit(edge))
    by = F.least(F.lit(1.0), edge / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(side * by + 0.5)).cast("int") for side in (width, height))


def adaptive_tile(width: Column, scale: Column, tile_budget: Column, band_budget: Column, pad: Column, ceiling: Column, halvings: int = 12) -> tuple[Column, Column]:
    """(tile, fits): the first of the halved tiles that fits both budgets or has reached the floor."""
    floor, start = F.least(ceiling, F.lit(MIN_TILE)), F.greatest(ceiling, F.lit(LEAST_TILE))
    over = lambda t: (tile_bytes(t, pad, scale) > tile_budget) | (band_bytes(width, t, scale) > band_budget)
    tries = F.transform(F.sequence(F.lit(0), F.lit(halvings)), lambda k: F.floor(start / F.pow(F.lit(2), k)).cast("long"))
    tile = F.element_at(F.filter(tries, lambda t: (t <= floor) | ~over(t)), 1)
    return tile, ~over(tile)


def budgets(free: Column, vram: Column, has_gpu: Column) -> tuple[Column, Column]:
    """(tile, band) byte budgets from free memory (0: unknown) and a GPU's own memory."""
    ram = F.when(free == 0, F.lit(2048 * MIB).cast("long")).otherwise(free)
    quarter = F.floor(ram / 4).cast("long")
    pool = F.when(~has_gpu, quarter).otherwise(F.least(quarter, F.when(vram > 0, F.floor(vram / 4).cast("long")).otherwise(F.floor(quarter / 2).cast("long"))))
    cut = lambda v, lo, hi: F.least(F.lit(hi * MIB).cast("long"), F.greatest(F.lit(lo * MIB).cast("long"), v))
    return cut(pool, 64, 512), cut(quarter, 32, 512)


def clamp_zoom(z: Column) -> Column:
    return F.least(F.lit(MAX_ZOOM), F.greatest(F.lit(MIN_ZOOM), z))


def _clamp_axis(offset: Column, drawn: Column, stage: Column) -> Column:
    inside = F.when(drawn <= stage, (stage - drawn) / 2).otherwise(F.least(F.lit(0.0), F.greatest(stage - drawn, offset)))
    return F.when((stage > 0) & (drawn > 0), inside).otherwise(offset)


def clamp_view(zoom: Column, x: Column, y: Column, w: Column, h: Column, sw: Column, sh: Column) -> tuple[Column, Column, Column]:
    return zoom, _clamp_axis(x, w * zoom, sw), _clamp_axis(y, h * zoom, sh)


def fit_view(w: Column, h: Column, sw: Column, sh: Column) -> tuple[Column, Column, Column]:
    """(zoom, x, y) that shows a whole image, never enlarged; null while a size is unknown."""
    room = lambda s: F.greatest(F.lit(1.0), s - 2.0 * FIT_MARGIN)
    known = (w > 0) & (h > 0) & (sw > 0) & (sh > 0)
    zoom = F.when(known, clamp_zoom(F.least(F.lit(1.0), room(sw) / w, room(sh) / h)))
    view = clamp_view(zoom, F.lit(0.0), F.lit(0.0), w, h, sw, sh)
    return zoom, *(F.when(known, v) for v in view[1:])


def zoom_view(zoom: Column, x: Column, y: Column, by: Column, ax: Column, ay: Column, w: Column, h: Column, sw: Column, sh: Column) -> tuple[Column, Column, Column]:
    """Zoom with the anchor staying over its image point; unchanged where the zoom does not change."""
    new = clamp_zoom(zoom * by)
    moved = clamp_view(new, ax - (ax - x) / zoom * new, ay - (ay - y) / zoom * new, w, h, sw, sh)
    return tuple(F.when(new == zoom, old).otherwise(v) for old, v in zip((zoom, x, y), moved, strict=True))


def wheel_factor(delta: Column) -> Column:
    return F.pow(F.lit(1.0015), -delta)


def pan_view(zoom: Column, x: Column, y: Column, dx: Column, dy: Column, w: Column, h: Column, sw: Column, sh: Column) -> tuple[Column, Column, Column]:
    """The image moved by a drag, kept over its stage."""
    return clamp_view(zoom, x + dx, y + dy, w, h, sw, sh)


def set_scale(zoom: Column, x: Column, y: Column, to: Column, w: Column, h: Column, sw: Column, sh: Column) -> tuple[Column, Column, Column]:
    """A zoom chosen by its value: the middle of the stage stays where it is."""
    return zoom_view(zoom, x, y, clamp_zoom(to) / zoom, sw / 2, sh / 2, w, h, sw, sh)


def result(w: Column, h: Column, target: Column, mode: Column) -> dict[str, Column]:
    """A result's sizes and its label."""
    label = F.concat(target.cast("string"), F.lit("× · "), F.initcap(mode))
    return {"source_width": w, "source_height": h, "output_width": w * target, "output_height": h * target, "label": label}
