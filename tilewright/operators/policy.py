"""Plans, features, licence states and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features in policy order with the edition each needs (null: none), and ranks of editions.
FEATURES = (
    ("enhance", None), ("export", None), ("batch", None), ("journal", None), ("upscale_4x", "pro"), ("advanced_restoration", "pro"),
    ("face_enhancement", "pro"), ("unlimited_processing", "pro"), ("engine_controls", "studio"),
)
RANKS = {"pro": 1, "studio": 2}
FREE_MAX_SCALE = 2
#: Presets (scale, mode, filter, intensity).
PRESETS = (
    ("photo", 2, "standard", "natural", 40), ("portrait", 2, "standard", "portrait", 55), ("old-photo", 4, "natural", "soft", 35), ("product", 2, "detail", "product", 60),
    ("print", 4, "detail", "natural", 35), ("web", 2, "standard", "vivid", 45), ("illustration", 4, "natural", "natural", 60),
)
#: Allowed clock differences in seconds.
ISSUE_SKEW, ROLLBACK_GRACE = 300, 3600


def rank_of(edition: Column) -> Column:
    return F.when(edition == "studio", 2).when(edition == "pro", 1).otherwise(0)


def features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, RANKS.get(e, 0)) for i, (n, e) in enumerate(FEATURES)], "ordinal int, feature string, required_rank int")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PRESETS)], "ordinal int, preset string, scale int, mode string, filter string, intensity int")


def capabilities(holders: DataFrame) -> DataFrame:
    """holders (holder, edition or null): the features each may use, in policy order."""
    joined = holders.join(F.broadcast(features(holders.sparkSession)), rank_of(F.col("edition")) >= F.col("required_rank"))
    made = joined.groupBy("holder", "edition").agg(F.sort_array(F.collect_list(F.struct("ordinal", "feature"))).alias("f"))
    return made.select("holder", "edition", F.transform("f", lambda x: x["feature"]).alias("features"))


def needs_of(scale: Column, mode: Column, look: Column) -> Column:
    """The features a recipe needs beyond the free plan."""
    return F.array_compact(F.array(F.when(scale > FREE_MAX_SCALE, "upscale_4x"), F.when(mode != "standard", "advanced_restoration"), F.when(look == "portrait", "face_enhancement")))


def recipe_gate(items: DataFrame) -> DataFrame:
    """items (batch, edition, scale, mode, filter): one locked item refuses its whole batch."""
    locked = (F.size(needs_of(F.col("scale"), F.col("mode"), F.col("filter"))) > 0) & (rank_of(F.col("edition")) < 1)
    return items.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(locked).alias("n_locked"), F.bool_or(locked).alias("refused"))


def match_preset(recipes: DataFrame) -> DataFrame:
    """recipes (recipe, scale, mode, filter, intensity) with the first preset equal in all four, or null."""
    return recipes.join(F.broadcast(presets(recipes.sparkSession).drop("ordinal")), ["scale", "mode", "filter", "intensity"], "left")


def license_state(has_key: Column, signature_ok: Column, version: Column, product_ok: Column, machine: Column, own_machine: Column, issued: Column, expires: Column, revoked: Column, max_seen: Column, now: Column) -> Column:
    """One of seven states; the order of the branches is the rule."""
    shape = signature_ok & (version == 1) & product_ok
    other = machine.isNotNull() & ~machine.eqNullSafe(own_machine)  # a bound key on a machine without an id is on another one
    future, over = issued > now + ISSUE_SKEW, expires.isNotNull() & (now >= expires)
    back = max_seen.isNotNull() & (now + ROLLBACK_GRACE < max_seen)
    return (
        F.when(~has_key, "not_activated").when(~shape, "tampered").when(other, "wrong_machine").when(future, "clock_suspect").when(over, "expired").when(back, "clock_suspect").when(revoked, "revoked").otherwise("active")
    )


def in_force(state: Column, edition: Column) -> Column:
    """Only an active licence unlocks its edition."""
    return F.when(state == "active", edition)


def watermark(max_seen: Column, now: Column) -> Column:
    return F.greatest(F.coalesce(max_seen, now), now)


def plan_repairs(engine_locked: Column, engine_path: Column, speed: Column) -> Column:
    """Settings a plan cannot honour, as the values that it can; null: nothing to repair."""
    return F.struct(F.when(engine_locked & (engine_path != "auto"), "auto").alias("engine_path"), F.when(engine_locked & (speed != "balanced"), "balanced").alias("speed"))


#: Looks in product order, what settings may hold, and their defaults.
LOOKS = ("original", "natural", "vivid", "warm", "cool", "cinematic", "soft", "sharp", "mono", "product", "portrait")
MODES, SCALES, THEMES = ("standard", "natural", "detail"), ("2", "4"), ("system", "light", "dark")
CHOICES = {
    "general.theme": (THEMES, "light"), "general.startupView": (("last", "enhance", "batch", "history"), "last"), "processing.defaultScale": (SCALES, "4"), "processing.defaultMode": (MODES, "standard"),
    "processing.defaultFilter": (LOOKS, "original"), "processing.enginePath": (("auto", "cpu"), "auto"), "export.format": (("png", "jpeg", "webp"), "png"), "performance.speed": (("balanced", "maximum"), "balanced"),
}
RANGES = {"general.recentFilesLimit": (3, 12, 6), "processing.defaultIntensity": (0, 100, 50), "export.quality": (1, 100, 90)}


def normalise_settings(raw: Column, old_theme: Column | None = None, old_choices: Column | None = None) -> Column:
    """A settings record from JSON text: every field falls back on its own.

    Without a record, the theme and the choices (JSON of mode and scale) that older versions kept
    under keys of their own count; with one, they are not looked at.
    """
    at = lambda path: F.get_json_object(raw, f"$.{path}")
    none = F.lit(None).cast("string")
    old = {
        "general.theme": none if old_theme is None else old_theme,
        "processing.defaultMode": none if old_choices is None else F.get_json_object(old_choices, "$.mode"),
        "processing.defaultScale": none if old_choices is None else F.get_json_object(old_choices, "$.scale"),
    }

    def pick(path: str) -> Column:
        allowed, default = CHOICES[path]
        found = F.when(raw.isNull(), old[path]).otherwise(at(path)) if path in old else at(path)
        return F.when(found.isin(*allowed), found).otherwise(default)

    def number(path: str) -> Column:
        lo, hi, default = RANGES[path]
        value = at(path).try_cast("double")
        return F.when(value.isNull() | F.isnan(value), default).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(value + 0.5).cast("int"))))

    return F.struct(
        pick("general.theme").alias("theme"), pick("general.startupView").alias("startup_view"), F.coalesce(at("general.rememberRecentFiles").try_cast("boolean"), F.lit(True)).alias("remember_recents"),
        number("general.recentFilesLimit").alias("recents_limit"), pick("processing.defaultScale").cast("int").alias("scale"), pick("processing.defaultMode").alias("mode"), pick("processing.defaultFilter").alias("filter"),
        number("processing.defaultIntensity").alias("intensity"), pick("processing.enginePath").alias("engine_path"), pick("export.format").alias("format"), number("export.quality").alias("quality"),
        F.coalesce(at("export.folder"), F.lit("")).alias("folder"), pick("performance.speed").alias("speed"),
    )


def patch_settings(settings: Column, patch: dict[str, Column]) -> Column:
    """A normalised record with some fields replaced; what a field may not hold gives its default."""
    named = {"theme": "general.theme", "startup_view": "general.startupView", "scale": "processing.defaultScale", "mode": "processing.defaultMode", "filter": "processing.defaultFilter", "engine_path": "processing.enginePath", "format": "export.format", "speed": "performance.speed"}
    ranged = {"recents_limit": "general.recentFilesLimit", "intensity": "processing.defaultIntensity", "quality": "export.quality"}
    out = settings
    for field, value in patch.items():
        if field in named:
            allowed, default = CHOICES[named[field]]
            value = F.when(value.cast("string").isin(*allowed), value.cast("string")).otherwise(default)
            value = value.cast("int") if field == "scale" else value
        elif field in ranged:
            lo, hi, default = RANGES[ranged[field]]
            value = F.coalesce(F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(value + 0.5).cast("int"))), F.lit(default))
        out = out.withField(field, value)
    return out


def engine_hints(settings: Column) -> Column:
    return F.struct((settings["engine_path"] == "cpu").alias("cpu_only"), (settings["speed"] == "maximum").alias("full_power"), settings["remember_recents"].alias("record_recents"))


# --- what a plan shows -----------------------------------------------------------------------------


def needed_edition(feature: Column) -> Column:
    """The edition that a feature needs, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name, e in FEATURES if e for x in (name, e)]), feature)


def preset_need(scale: Column, mode: Column, look: Column) -> Column:
    """The most demanding feature of a recipe, or null; of equal ones the first (scale, mode, filter)."""
    needs = needs_of(scale, mode, look)
    rank = lambda f: rank_of(needed_edition(f))
    worst = F.aggregate(needs, F.lit(None).cast("string"), lambda w, f: F.when(w.isNull() | (rank(f) > rank(w)), f).otherwise(w))
    return worst


def plan_view(state: Column, edition: Column, listed: Column) -> dict[str, Column]:
    """state null: not read yet, which is unknown and not free. listed: the features that the licence names."""
    known = state.isNotNull()
    tier = F.when((state == "active") & edition.isin("pro", "studio"), edition).otherwise("free")
    listed = F.coalesce(listed, F.array().cast("array<string>"))
    return {"known": known, "tier": tier, "listed": listed, "scale_ceiling": F.when(known & ~F.array_contains(listed, "upscale_4x"), FREE_MAX_SCALE)}


def plan_lock(plan: dict[str, Column], feature: Column) -> Column:
    """The edition to name on a control, or null if the plan has the feature: the licence's list decides, the table only names the tier."""
    needed = needed_edition(feature)
    open_ = ~plan["known"] | feature.isNull() | F.coalesce(F.array_contains(plan["listed"], feature), F.lit(False)) | needed.isNull() | (rank_of(plan["tier"]) >= rank_of(needed))
    return F.when(~open_, needed)


def available_looks(offered: Column) -> Column:
    """offered: array of (key, available), or null while unknown; known keys only."""
    names = F.transform(F.filter(offered, lambda f: f["available"]), lambda f: f["key"])
    every = F.array(*map(F.lit, LOOKS))
    return F.coalesce(F.filter(names, lambda k: F.array_contains(every, k)), every)


def runnable(plan: dict[str, Column], scales: Column, modes: Column, looks: Column, scale: Column, mode: Column, look: Column) -> dict[str, Column]:
    """Options that the plan can run, and the stored choice or what stands in for it: the last scale, the first mode, `original`."""
    ceiling = plan["scale_ceiling"]
    ok_scales = F.filter(scales, lambda s: ceiling.isNull() | (s <= ceiling))
    ok_modes = F.filter(modes, lambda m: plan_lock(plan, F.when(m != "standard", "advanced_restoration")).isNull())
    ok_looks = F.filter(looks, lambda f: plan_lock(plan, F.when(f == "portrait", "face_enhancement")).isNull())
    held = lambda options, wanted, other: F.when(F.array_contains(options, wanted), wanted).otherwise(other)
    return {
        "scales": ok_scales, "modes": ok_modes, "looks": ok_looks,
        "scale": held(ok_scales, scale, F.try_element_at(ok_scales, F.lit(-1))), "mode": held(ok_modes, mode, F.get(ok_modes, F.lit(0))), "look": held(ok_looks, look, F.lit("original")),
    }
