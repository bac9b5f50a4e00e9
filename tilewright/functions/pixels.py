"""Pixel arithmetic as column expressions: values in [0, 1], one column a channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

#: Luma weights.
LUMA = (0.2126, 0.7152, 0.0722)
#: The strength of the detail mode's sharpening.
DETAIL_STRENGTH = 0.5


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def luma(p: Triple) -> Column:
    return LUMA[0] * p[0] + LUMA[1] * p[1] + LUMA[2] * p[2]


def to_u8(v: Column) -> Column:
    """Byte value of a channel; what rings outside [0, 1] is cut here and only here."""
    return F.floor(clamp01(v) * 255 + 0.5).cast("int")


def amount(intensity: Column | int) -> Column:
    return F.least(F.lit(100), F.lit(intensity) if isinstance(intensity, int) else intensity) / 100.0


def unsharp(p: Triple, blurred: Triple, strength: Column | float) -> Triple:
    return tuple(v + strength * (v - b) for v, b in zip(p, blurred, strict=True))


def tone(p: Triple, saturation: Column | float, contrast: Column | float) -> Triple:
    grey = luma(p)
    return tuple(clamp01((grey + (v - grey) * saturation - 0.5) * contrast + 0.5) for v in p)


def gains(p: Triple, by: tuple[Column | float, ...]) -> Triple:
    return tuple(clamp01(v * g) for v, g in zip(p, by, strict=True))


def film_curve(x: Column) -> Column:
    m = (x - 0.5) * 1.18
    t = clamp01(0.5 + m / (1 + 0.42 * F.abs(m)))
    return clamp01(t + 0.06 * (1 - t) * (1 - t))


def _mono(p: Triple, k: Column) -> Triple:
    grey = clamp01((luma(p) - 0.5) * (1 + 0.18 * k) + 0.5)
    return tuple(v * (1 - k) + grey * k for v in p)


def _cinematic(p: Triple, k: Column) -> Triple:
    curved = tuple(film_curve(clamp01(v)) for v in p)
    shift = 0.06 * k * ((curved[0] + curved[1] + curved[2]) / 3 - 0.5)
    split = tuple(clamp01(v + f * shift) for v, f in zip(curved, (1.0, 0.2, -1.2), strict=True))
    return tone(split, 1 - 0.18 * k, 1.0)


def _soft(p: Triple, b: Triple, k: Column) -> Triple:
    return tuple(clamp01(v + 0.35 * k * (s - v) + 0.02 * k) for v, s in zip(p, b, strict=True))


def _portrait(p: Triple, b: Triple, k: Column) -> Triple:
    smooth = tuple(clamp01(v + 0.28 * k * (s - v)) for v, s in zip(p, b, strict=True))
    warm = tone(gains(smooth, (1 + 0.03 * k, 1.0, 1 - 0.02 * k)), 1 - 0.06 * k, 1.0)
    return tuple(clamp01(v + 0.04 * k) for v in warm)


#: The looks, in catalogue order; each takes the triple, its blurred twin and the amount. The order, and the
#: factors here and in the four functions above.
LOOKS: dict[str, Callable[[Triple, Triple, Column], Triple]] = {
    "original": lambda p, b, k: p,
    "natural": lambda p, b, k: tone(p, 1 + 0.12 * k, 1 + 0.06 * k),
    "vivid": lambda p, b, k: tone(p, 1 + 0.60 * k, 1 + 0.20 * k),
    "warm": lambda p, b, k: gains(p, (1 + 0.07 * k, 1.0, 1 - 0.09 * k)),
    "cool": lambda p, b, k: gains(p, (1 - 0.07 * k, 1.0, 1 + 0.08 * k)),
    "mono": lambda p, b, k: _mono(p, k),
    "cinematic": lambda p, b, k: _cinematic(p, k),
    "soft": _soft,
    "portrait": _portrait,
    "sharp": lambda p, b, k: unsharp(p, b, k),
    "product": lambda p, b, k: tone(unsharp(p, b, 0.4 * k), 1 - 0.05 * k, 1 + 0.18 * k),
}


def look(name: str, p: Triple, blurred: Triple, intensity: Column | int) -> Triple:
    """The look at an intensity of 0 to 100; at 0 nothing changes."""
    k = amount(intensity)
    made = LOOKS[name](p, blurred, k)
    return tuple(F.when(k == 0, v).otherwise(m) for v, m in zip(p, made, strict=True))


def flatten_on_white(colour: Column, alpha: Column) -> Column:
    """Bytes: a colour with alpha over white."""
    return F.floor((colour * alpha + 255 * (255 - alpha)) / 255).cast("int")
