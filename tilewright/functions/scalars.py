"""Small rules on single values: sliders, shares, money, devices, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geometry import MAX_SOURCE_BYTES, MAX_SOURCE_PIXELS

#: Labels of looks, modes and formats, and what looks and features say of themselves.
LOOK_LABELS = {
    "original": "Original", "natural": "Natural", "vivid": "Vivid", "warm": "Warm", "cool": "Cool", "cinematic": "Cinematic", "soft": "Soft", "sharp": "Sharp", "mono": "Black & White", "product": "Product", "portrait": "Portrait",
}
LOOK_NOTES = {
    "original": "No finishing pass — exactly what the model produced",
    "natural": "Slight saturation and contrast lift, no colour cast",
    "vivid": "Strong saturation and contrast — punchy, for content that pops",
    "warm": "Warms the balance: red up, blue down",
    "cool": "Cools the balance: blue up, red down",
    "cinematic": "Filmic curve — lifted blacks, warm highlights, teal shadows",
    "soft": "Blends toward a blur — gentle skin, calmer detail",
    "sharp": "Unsharp local contrast on top of the result",
    "mono": "Toward luminance with tonal contrast — intensity sets how far",
    "product": "Clarity and neutral contrast, colours kept accurate",
    "portrait": "Mild softening, small exposure lift, warmth, eased saturation",
}
MODE_KEYS = ("standard", "natural", "detail")
FORMAT_KEYS = {"png": "png", "jpeg": "jpeg", "jpg": "jpeg", "webp": "webp"}
#: The slider's ends and steps, the zoom's slack, edges that encoders take, the default edge of a view.
SLIDER, STEP, LONG_STEP, SLACK = (3.0, 97.0), 2.0, 10.0, 1.02
MAX_EDGE = {"jpeg": 65535, "webp": 16383}
VIEW_EDGE = 2600


def lookup(table: dict, key: Column) -> Column:
    """The value of a key, null if the key is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def slider_at(x: Column, left: Column, width: Column, now: Column) -> Column:
    """Where a pointer puts the slider, in percent; a frame without a width leaves it."""
    lo, hi = SLIDER
    return F.when(width > 0, F.least(F.lit(hi), F.greatest(F.lit(lo), (x - left) / F.nullif(width, F.lit(0.0)) * 100))).otherwise(now)


def slider_key(key: Column, shift: Column, now: Column) -> Column:
    lo, hi = SLIDER
    step = F.when(shift, LONG_STEP).otherwise(STEP)
    return F.when(key == "ArrowLeft", F.greatest(F.lit(lo), now - step)).when(key == "ArrowRight", F.least(F.lit(hi), now + step)).when(key == "Home", lo).when(key == "End", hi).otherwise(now)


def source_quality(there: Column, original: Column, edge: Column, w: Column, h: Column) -> Column:
    """Pixels delivered for each of the source; 0 without a view, infinite for the original bytes."""
    return F.when(~there, 0.0).when(original, float("inf")).otherwise(edge / F.greatest(w, h))


def needs_full(quality: Column, zoom: Column) -> Column:
    return (quality < float("inf")) & (zoom > quality * SLACK)


def to_cents(total: Column) -> Column:
    """Major units as cents, halves up; null for what is no finite number."""
    return F.when(total.isNotNull() & ~F.isnan(total) & (F.abs(total) != float("inf")), F.floor(total * 100 + 0.5).cast("long"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5)).cast("int"))


def threads(full_power: Column, logical: Column, physical: Column) -> Column:
    most = F.greatest(logical, F.lit(1))
    return F.when(full_power, most).otherwise(F.least(F.greatest(physical, F.lit(1)), most))


def quality_in_range(q: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), q))


def export_limit(fmt: Column, w: Column, h: Column) -> Column:
    """export_limit where the format cannot hold an edge, else null."""
    return F.when(F.greatest(w, h) > lookup(MAX_EDGE, fmt), "export_limit")


def view_plan(w: Column, h: Column, max_edge: Column | None = None) -> dict[str, Column]:
    """original (deliver the bytes as they are) and the edge that is delivered."""
    edge = F.greatest(F.lit(1), F.coalesce(max_edge, F.lit(VIEW_EDGE)) if max_edge is not None else F.lit(VIEW_EDGE))
    longest = F.greatest(w, h)
    return {"original": longest <= edge, "delivered_edge": F.least(longest, edge)}


def view_error(exists: Column, is_dir: Column, size: Column, kind: Column, w: Column, h: Column) -> Column:
    """The first failure before a view is made, or null; the extension does not count here."""
    return (
        F.when(~exists, "file_missing").when(is_dir, "unsupported_format").when(size > MAX_SOURCE_BYTES, "file_too_large").when(kind.isNull(), "invalid_image").when(kind == "other", "unsupported_format")
        .when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), "invalid_image").when(w * h > MAX_SOURCE_PIXELS, "file_too_large")
    )


def accelerator_summary(name: Column, memory: Column) -> Column:
    """name null: no device (fixed value: the sentence)."""
    gib = F.greatest(F.lit(1), F.floor(memory / float(1 << 30) + 0.5).cast("long"))
    return F.when(name.isNull(), "CPU (no DirectX 12 GPU found)").otherwise(F.concat(name, F.lit(" · "), gib.cast("string"), F.lit(" GB VRAM")))


def when_label(millis: Column) -> Column:
    """Month, day, hour and minute in English, in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis.cast("long")), "MMM d, hh:mm a")


def hex_decode(text: Column) -> Column:
    """Bytes of an even number of hex digits, else null."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def stored_key(credential: Column, file_there: Column, file_text: Column) -> Column:
    """The credential store's key, else the file's. A file that is there and cannot be read gives "", which is no key but not none."""
    return F.coalesce(credential, F.when(file_there, F.coalesce(file_text, F.lit(""))))


def stored_record(raw: Column, schema: str, version: int) -> Column:
    """A versioned JSON record; missing, damaged or of another version: null, for the caller's defaults."""
    found = F.from_json(raw, f"version int, {schema}", {"mode": "PERMISSIVE"})
    return F.when(found["version"] == version, found)


def label_of(native: Column, catalogue: Column) -> Column:
    return F.coalesce(native, catalogue)
