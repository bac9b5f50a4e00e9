"""Queries of meters, orders, jobs, plans, files and labels, with their SQL.

The tables hold none of these records, so each query derives its input by a fixed rule from the star
schema, the events or the documents; the SQL states the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import text as T
from tilewright.operators import jobs as J
from tilewright.operators import ledger as L
from tilewright.operators import policy as Y
from tilewright.sources import images as S

Query = Callable[[SparkSession, str], DataFrame]
MONTH = "1998-02"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- geometry --------------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return part.select(
        "p_partkey",
        (F.col("p_size").cast("long") * 100 + 7).alias("w"),
        F.floor(F.col("p_retailprice")).cast("long").alias("h"),
        F.element_at(F.array(F.lit(2), F.lit(3), F.lit(4)), (F.col("p_partkey") % 3).cast("int") + 1).cast("long").alias("scale"),
        (F.lit(16) * (1 + F.col("p_partkey") % 20)).cast("long").alias("ceiling"),
        (F.lit(G.MIB // 4).cast("long") * (1 + F.col("p_partkey") % 97)).alias("budget"),
    )


def plan_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    made = G.plan(F.col("w"), F.col("h"), F.col("scale"), F.lit(2).cast("long"), F.col("ceiling"))
    tile = made["tile"].cast("long")
    return s.select("p_partkey", *[v.cast("long").alias(k) for k, v in made.items()], G.tile_bytes(tile, F.lit(8), F.col("scale")).cast("long").alias("tile_bytes"), (F.col("w") * F.col("h") * 4 > G.MAX_OUTPUT_PIXELS).alias("too_large"))


def plan_adaptive_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    tile, fits = G.adaptive_tile(F.col("w"), F.col("scale"), F.col("budget"), F.col("budget") * 2, F.lit(8).cast("long"), F.col("ceiling"))
    return s.select("p_partkey", tile.alias("tile"), fits.alias("fits"))


def plan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    free = (F.col("p_partkey") % 70).cast("long") * (128 * G.MIB)
    vram = (F.col("p_size") % 9).cast("long") * (512 * G.MIB)
    tile, band = G.budgets(free, vram, F.col("p_partkey") % 2 == 0)
    return part.select("p_partkey", tile.cast("long").alias("tile_budget"), band.cast("long").alias("band_budget"))


def view_fit_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).select("p_partkey", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    sw, sh = F.lit(1000.0), F.lit(600.0)
    s = s.withColumns(dict(zip(("z", "x", "y"), G.fit_view(F.col("w"), F.col("h"), sw, sh), strict=True)))
    args = [F.col(c) for c in ("z", "x", "y")]
    s = s.withColumns(dict(zip(("z2", "x2", "y2"), G.zoom_view(*args, G.wheel_factor(-(F.col("p_partkey") % 7) * 100.0), F.lit(250.0), F.lit(100.0), F.col("w"), F.col("h"), sw, sh), strict=True)))
    return s.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("z", "x", "y", "z2", "x2", "y2")])


_SRC_SQL = """s AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 100 + 7 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h, CAST(2 + p_partkey % 3 AS BIGINT) AS scale,
    CAST(16 * (1 + p_partkey % 20) AS BIGINT) AS ceiling, CAST(262144 * (1 + p_partkey % 97) AS BIGINT) AS budget FROM part)"""

# --- meters ----------------------------------------------------------------------------------------


def _spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    meter = F.concat(F.when(F.col("o_custkey") % 4 == 0, "iph").otherwise("dev"), F.col("o_custkey").cast("string"))
    return o.select(meter.alias("meter"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderkey") % 5).cast("long").alias("n"))


def meter_month_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.meter_state(_spends(spark, sf_dir))
    return s.select("meter", "month", "used", F.col("remaining").cast("long").alias("remaining"), F.col("limit").cast("long").alias("limit"))


def meter_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    spends = _spends(spark, sf_dir)
    s = L.peek(spends.select("meter").distinct(), spends, MONTH)
    return s.select("meter", "month", F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"), F.col("limit").cast("long").alias("limit"))


_SPEND_SQL = """sp AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN 'iph' ELSE 'dev' END || o_custkey AS meter, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 5 AS n FROM orders),
u AS (SELECT meter, month, CAST(sum(n) AS BIGINT) AS used, CASE WHEN meter LIKE 'iph%' THEN 30 ELSE 10 END AS lim FROM sp WHERE n BETWEEN 1 AND 1000 GROUP BY meter, month),
st AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY meter ORDER BY month DESC) = 1)"""


def meter_two_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    installs = c.select(F.col("c_custkey").alias("install"), F.col("c_nationkey").alias("network"), (F.col("c_custkey") % 3).cast("int").alias("remaining"))
    networks = n.filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("network"), (F.col("n_nationkey") % 4).alias("network_remaining"))
    return L.two_meter_verdict(installs, networks)


def meter_check_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    made = L.check_decision(k % 2 == 0, k % 3 != 0, k % 11, F.lit(10), k % 5 != 0, k % 7 != 0, k % 9, 1 + k % 13)
    later = L.settle(F.when(k % 2 == 0, MONTH).otherwise("1998-01"), k % 11, k % 4, F.lit(MONTH), k % 6, F.lit(10))
    return c.select("c_custkey", made.alias("decision"), *[v.cast("long").alias(f"settled_{n}") for n, v in later.items()])


# --- orders ----------------------------------------------------------------------------------------


def pool_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 2 == 0, "pro").otherwise("studio").alias("edition"), F.col("o_orderdate").alias("paid_at"))
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("KEY-"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 3 == 0, "studio").otherwise("pro").alias("edition"), (F.col("p_partkey") * 7919 % 10007).alias("issued_at"))
    return L.claim_keys(o, p).select("order_id", "edition", "key")


def order_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    now = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.lit("paid").alias("status"), F.floor("o_totalprice").cast("long").alias("cents"), F.col("o_orderpriority").alias("note"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "canceled").alias("status"), F.when(F.col("o_orderkey") % 8 != 0, F.floor("o_totalprice").cast("long") + 1).alias("cents"))
    return L.upsert(now, new, "id", {"status": F.lit("pending")})


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 10 == 0, "fulfilled").when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "refunded").when(F.col("event_type") == "signup", "canceled")
    return L.order_lifecycle(e.select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), kind.alias("kind")))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"))
    new = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("id"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("id"), F.lit("x")))
    m = L.merge_metadata(F.col("p"), new)
    return e.withColumn("m", m).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("id")).alias("id"), F.size("m").cast("int").alias("n_keys"))


# --- jobs ------------------------------------------------------------------------------------------


def _item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_id") % 29 == 0, "completed").when(F.col("event_id") % 31 == 0, "failed").when(F.col("event_id") % 37 == 0, "cancelled")
        .when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "signup", "saving").when(F.col("event_type") == "purchase", "device").otherwise("noise")
    )
    return e.select(
        F.col("user_id").alias("item"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.floor("value").cast("long").alias("done"), F.lit(100).cast("long").alias("total"), F.when(F.col("event_id") % 2 == 0, "GPU").otherwise("CPU").alias("device"),
    )


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _item_events(spark, sf_dir)
    return J.fold_items(e.select("item").distinct(), e)


def progress_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.monotone_progress(_item_events(spark, sf_dir))


def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.counters(_folded(spark, sf_dir))


def single_job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _item_events(spark, sf_dir)
    phase = F.when(F.col("kind") == "started", "processing").when(F.col("kind") == "saving", "completing").otherwise(F.col("kind"))
    return J.fold_single_job(e.select(F.col("item").alias("job"), "seq", phase.alias("phase")))


def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("ok", "oom", "open_failed", "failed", "disk_full")])
    k = F.col("c_custkey")
    out = F.array(F.get(kinds, (k % 5).cast("int")), F.get(kinds, F.expr("cast(c_custkey div 5 % 5 as int)")), F.get(kinds, F.expr("cast(c_custkey div 25 % 5 as int)")))
    c = _t(spark, sf_dir, "customer").select("c_custkey", J.attempt_ladder(out, F.lit(256)).alias("r"))
    return c.select("c_custkey", "r.result", "r.attempts", "r.device", "r.ceiling")


_ITEM_SQL = """ev AS (SELECT user_id AS item, event_id AS seq, CASE WHEN event_id % 29 = 0 THEN 'completed' WHEN event_id % 31 = 0 THEN 'failed' WHEN event_id % 37 = 0 THEN 'cancelled'
    WHEN event_type = 'view' THEN 'started' WHEN event_type = 'click' THEN 'progress' WHEN event_type = 'signup' THEN 'saving' WHEN event_type = 'purchase' THEN 'device' ELSE 'noise' END AS kind,
    CAST(floor(value) AS BIGINT) AS done, CAST(100 AS BIGINT) AS total, CASE WHEN event_id % 2 = 0 THEN 'GPU' ELSE 'CPU' END AS device FROM events)"""
_FOLD_SQL = (
    _ITEM_SQL
    + """,
nu AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS n FROM ev WHERE kind <> 'noise'),
fo AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS n, 'waiting' AS state, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS device FROM ev
  UNION ALL
  SELECT f.item, e.n, CASE WHEN e.kind = 'started' AND f.state = 'waiting' THEN 'processing' WHEN e.kind IN ('completed', 'failed', 'cancelled') THEN e.kind ELSE f.state END,
    CASE WHEN e.kind = 'progress' AND e.done >= f.done THEN e.done WHEN e.kind = 'saving' AND f.total > 0 THEN f.total WHEN e.kind = 'completed' THEN f.total ELSE f.done END,
    CASE WHEN e.kind = 'progress' AND e.done >= f.done THEN e.total ELSE f.total END, CASE WHEN e.kind = 'device' THEN e.device ELSE f.device END
  FROM fo f JOIN nu e ON e.item = f.item AND e.n = f.n + 1 WHERE f.state NOT IN ('completed', 'failed', 'cancelled')),
fi AS (SELECT item, state, done, total, device, CAST(n AS INTEGER) AS n_events FROM fo QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC) = 1)"""
)
_F = "WITH RECURSIVE " + _FOLD_SQL

# --- lists and files -------------------------------------------------------------------------------


def recents_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return L.recents(e.select(F.concat(F.lit("/img/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq")))


def journal_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.journal(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderstatus"))


def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.least_recent_out(_t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq")))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("source"), F.lit("/"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("id"), "doc_id", "n_chars")
    return L.add_first(d.filter("doc_id % 10 = 0").dropDuplicates(["id"]).select("id", F.lit(-1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_chars")), d.filter("doc_id % 10 <> 0"), "id", "doc_id")


def import_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    k = F.col("doc_id")
    ext = F.when(F.col("lang") == "en", "JPG").when(F.col("lang") == "fr", "png").when(F.col("lang") == "de", "webp").otherwise("gif")
    kind = F.when(k % 13 == 0, None).when(k % 17 == 0, "other").when(F.col("lang") == "en", "jpeg").when(F.col("lang") == "fr", "png").otherwise("webp")
    error = S.import_error(F.when(k % 41 == 0, "").otherwise("a"), ext, k % 11 != 0, k % 19 == 0, F.col("n_chars") * 50_000, kind, F.when(k % 23 != 0, F.col("n_chars") * 10), F.lit(2000))
    return d.select("doc_id", error.alias("error_code"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    stem = T.safe_stem(F.concat(F.when(F.col("p_partkey") % 9 == 0, " a<b").when(F.col("p_partkey") % 9 == 1, "...").otherwise("img"), (F.col("p_size") % 5).cast("string"), F.when(F.col("p_partkey") % 9 < 5, "").otherwise(F.concat(F.lit("-"), (F.col("p_partkey") % 4 + 1).cast("string")))), "image")
    files = p.select(F.col("p_brand").alias("dir"), stem.alias("stem"), F.lit("png").alias("ext"), F.col("p_partkey").alias("ordinal"))
    taken = p.select(F.col("p_brand").alias("dir")).distinct().select("dir", F.explode(F.array(F.lit("img1.png"), F.lit("img2-2.png"), F.lit("other.png"))).alias("name"))
    return L.safe_names(files, taken)


# --- plans -----------------------------------------------------------------------------------------


def _edition() -> Column:
    return F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 3 == 1, "pro").otherwise("studio")


def entitlement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("holder"), _edition().alias("edition"))
    return Y.capabilities(c).select("holder", F.array_join("features", ",").alias("features"))


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), F.expr(f"cast(c_custkey div {n} % {len(names)} as int)"))
    return _t(spark, sf_dir, "customer").select(
        k.alias("recipe"), (k % 40).alias("batch"), F.when(k % 40 < 20, "pro").alias("edition"), pick((2, 4), 1).alias("scale"), pick(("standard", "natural", "detail"), 2).alias("mode"),
        pick(("natural", "portrait", "soft", "product", "vivid"), 6).alias("filter"), pick((40, 55, 35, 60, 45), 6).alias("intensity"),
    )


def license_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, now = F.col("c_custkey"), F.lit(1_760_000_000)
    state = Y.license_state(
        k % 17 != 0, k % 13 != 0, F.when(k % 11 == 0, 2).otherwise(1), k % 19 != 0, F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 5).cast("string"))), F.when(k % 29 != 0, "m0"), now - 86400 * (k % 30) + F.when(k % 7 == 0, 3_000_000).otherwise(0),
        F.when(k % 4 == 0, now + 86400 * (k % 9 - 4)), k % 23 == 0, F.when(k % 5 == 0, now + 1800 * (k % 6)), now,
    )
    c = _t(spark, sf_dir, "customer").select("c_custkey", state.alias("state"))
    return c.select("c_custkey", "state", Y.in_force(F.col("state"), _edition()).alias("edition"))


# --- labels ----------------------------------------------------------------------------------------


def text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    k, size = F.col("p_partkey"), F.pow(F.lit(3.7), (F.col("p_partkey") % 19).cast("double")) * (1 + F.col("p_partkey") % 7)
    return s.select(
        "p_partkey", T.format_bytes(F.floor(size).cast("long")).alias("bytes"), T.format_dimensions(F.col("w"), F.col("h")).alias("dims"), T.format_megapixels(F.col("w"), F.col("h")).alias("mp"),
        T.format_zoom((k % 50 + 1) / 256.0).alias("zoom"), T.period_label(F.concat(F.lit("199"), (k % 10).cast("string"), F.lit("-"), F.lpad((k % 15).cast("string"), 2, "0"))).alias("period"),
        T.preset_label(F.col("scale"), F.lit("detail")).alias("preset"), T.dimensions_label(F.when(k % 5 == 0, "failed").otherwise("completed"), F.when(k % 3 == 0, 0).otherwise(F.col("w")), F.col("h"), F.when(k % 4 == 0, 0).otherwise(F.col("w") * 2), F.col("h") * 2).alias("label"),
        T.meter_line(k % 2 == 0, k % 4, F.lit(10), F.lit("1998-02")).alias("meter"),
    )


def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    end = T.parse_endpoint(F.col("url"))
    return p.select("page_id", T.display_name(F.col("url")).alias("name"), end["host"].alias("host"), end["port"].cast("int").alias("port"), end["path"].alias("path"), end["error"].alias("error"))


def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", T.machine_id(F.col("url")).alias("machine"), T.network_id(F.lit("salt"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url"))).alias("network"), T.data_url(F.lit("text/plain"), F.col("url").cast("binary")).alias("data"))


def queries() -> dict[str, Query]:
    return {
        "plan_geometry": plan_geometry, "plan_adaptive_tile": plan_adaptive_tile, "plan_budgets": plan_budgets, "view_fit_zoom": view_fit_zoom,
        "meter_month_state": meter_month_state, "meter_peek": meter_peek, "meter_two_bucket": meter_two_bucket, "meter_check_decision": meter_check_decision,
        "pool_claim": pool_claim, "order_upsert": order_upsert, "order_lifecycle": order_lifecycle, "metadata_merge": metadata_merge,
        "batch_fold": _folded, "batch_counters": batch_counters, "batch_history": lambda s, d: J.history_rows(_folded(s, d)), "batch_retry": lambda s, d: J.retry(_folded(s, d)), "batch_sweep": lambda s, d: J.sweep(_folded(s, d)),
        "progress_monotone": progress_monotone, "single_job_fold": single_job_fold, "attempt_ladder": attempt_ladder,
        "recents_mru": recents_mru, "journal_cap": journal_cap, "lru_cache": lru_cache, "dedup_first": dedup_first, "import_ladder": import_ladder, "safe_names": safe_names,
        "entitlement_matrix": entitlement_matrix, "recipe_gate": lambda s, d: Y.recipe_gate(_recipes(s, d)), "preset_match": lambda s, d: Y.match_preset(_recipes(s, d)).select("recipe", "preset"), "license_state": license_state,
        "text_format": text_format, "text_paths": text_paths, "hash_ids": hash_ids,
    }


def _tile_sql() -> str:
    over = "(3 * ((t + 16) * scale) * ((t + 16) * scale) * 4 > budget OR w * scale * t * scale * 3 > 2 * budget)"
    return f"""WITH RECURSIVE {_SRC_SQL}, r AS (SELECT p_partkey, w, scale, budget, ceiling, greatest(ceiling, 16) AS t FROM s
        UNION ALL SELECT p_partkey, w, scale, budget, ceiling, t // 2 FROM r WHERE t > least(ceiling, 64) AND {over})
        SELECT p_partkey, CAST(min(t) AS BIGINT) AS tile, arg_min(NOT {over}, t) AS fits FROM r GROUP BY p_partkey"""


def oracle_sql() -> dict[str, str]:
    edition = "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'pro' ELSE 'studio' END"
    pick = lambda names, n: f"list_extract({list(names)!r}, CAST(c_custkey // {n} % {len(names)} + 1 AS BIGINT))"
    recipes = f"""rc AS (SELECT c_custkey AS recipe, c_custkey % 40 AS batch, CASE WHEN c_custkey % 40 < 20 THEN 'pro' END AS edition, {pick((2, 4), 1)} AS scale, {pick(("standard", "natural", "detail"), 2)} AS mode,
        {pick(("natural", "portrait", "soft", "product", "vivid"), 6)} AS filter, {pick((40, 55, 35, 60, 45), 6)} AS intensity FROM customer)"""
    clamp = lambda z: f"least(32::DOUBLE, greatest(0.02::DOUBLE, {z}))"
    axis = lambda o, d, s: f"CASE WHEN {d} <= {s} THEN ({s} - {d}) / 2 ELSE least(0::DOUBLE, greatest({s} - {d}, {o})) END"
    dims = lambda a, b: f"format('{{:,}}', {a}) || ' × ' || format('{{:,}}', {b})"
    months = "['January','February','March','April','May','June','July','August','September','October','November','December']"
    rank = lambda a: f"row_number() OVER (PARTITION BY {a})"
    presets = ", ".join(f"({i}, '{n}', {s}, '{m}', '{f}', {k})" for i, (n, s, m, f, k) in enumerate(Y.PRESETS))
    return {
        "plan_geometry": f"""WITH {_SRC_SQL}, t AS (SELECT *, greatest(ceiling, 16) AS tile FROM s)
            SELECT p_partkey, CAST(tile AS BIGINT) AS tile, (w + tile - 1) // tile AS cols, (h + tile - 1) // tile AS bands, ((w + tile - 1) // tile) * ((h + tile - 1) // tile) AS tiles, w * 2 AS out_w, h * 2 AS out_h,
                   greatest(1, scale // 2) AS factor, 3 * ((tile + 16) * scale) * ((tile + 16) * scale) * 4 AS tile_bytes, w * h * 4 > 256000000 AS too_large FROM t""",
        "plan_adaptive_tile": _tile_sql(),
        "plan_budgets": """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 70 = 0 THEN 2048 ELSE p_partkey % 70 * 128 END * 1048576 AS ram, (p_size % 9) * 512 * 1048576::BIGINT AS vram FROM part)
            SELECT p_partkey, CAST(least(536870912, greatest(67108864, CASE WHEN p_partkey % 2 <> 0 THEN ram // 4 ELSE least(ram // 4, CASE WHEN vram > 0 THEN vram // 4 ELSE ram // 4 // 2 END) END)) AS BIGINT) AS tile_budget,
                   CAST(least(536870912, greatest(33554432, ram // 4)) AS BIGINT) AS band_budget FROM a""",
        "view_fit_zoom": f"""WITH {_SRC_SQL}, f AS (SELECT p_partkey, w::DOUBLE AS w, h::DOUBLE AS h, {clamp("least(1::DOUBLE, 944 / w::DOUBLE, 544 / h::DOUBLE)")} AS z FROM s),
            v AS (SELECT *, {axis("0", "w * z", "1000")} AS x, {axis("0", "h * z", "600")} AS y, {clamp("z * pow(1.0015::DOUBLE, (p_partkey % 7) * 100.0::DOUBLE)")} AS n FROM f),
            m AS (SELECT *, 250 - (250 - x) / z * n AS mx, 100 - (100 - y) / z * n AS my FROM v)
            SELECT p_partkey, round(z, 6) AS z, round(x, 6) AS x, round(y, 6) AS y, round(n, 6) AS z2, round(CASE WHEN n = z THEN x ELSE {axis("mx", "w * n", "1000")} END, 6) AS x2, round(CASE WHEN n = z THEN y ELSE {axis("my", "h * n", "600")} END, 6) AS y2 FROM m""",
        "meter_month_state": f"WITH {_SPEND_SQL} SELECT meter, month, used, CAST(greatest(lim - used, 0) AS BIGINT) AS remaining, CAST(lim AS BIGINT) AS \"limit\" FROM st",
        "meter_peek": f"""WITH {_SPEND_SQL}, m AS (SELECT DISTINCT meter, CASE WHEN meter LIKE 'iph%' THEN 30 ELSE 10 END AS lim FROM sp)
            SELECT m.meter, '{MONTH}' AS month, coalesce(st.used, 0) AS used, CAST(CASE WHEN st.meter IS NULL THEN m.lim ELSE greatest(st.lim - st.used, 0) END AS BIGINT) AS remaining, CAST(m.lim AS BIGINT) AS "limit" FROM m LEFT JOIN st ON st.meter = m.meter AND st.month = '{MONTH}'""",
        "meter_two_bucket": """SELECT c_custkey AS install, c_nationkey AS network, CAST(c_custkey % 3 AS INTEGER) AS remaining, n.n_nationkey % 4 AS network_remaining, c_custkey % 3 > 0 AND (n.n_nationkey IS NULL OR n.n_nationkey % 4 > 0) AS allowed
            FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON n.n_nationkey = c_nationkey""",
        "meter_check_decision": f"""WITH a AS (SELECT c_custkey, c_custkey AS k, 1 + c_custkey % 13 AS n FROM customer), b AS (SELECT *, k % 2 = 0 AND k % 3 <> 0 AND n <= k % 11 AS cov FROM a)
            SELECT c_custkey, CASE WHEN cov THEN 'ok' WHEN k % 2 = 0 AND n > 10 THEN 'quota_exceeded' WHEN k % 5 = 0 AND k % 2 <> 0 THEN 'meter_unreachable' WHEN k % 5 <> 0 AND k % 7 <> 0 AND n <= k % 9 THEN 'ok' ELSE 'quota_exceeded' END AS decision,
              CASE WHEN k % 2 = 0 THEN k % 4 ELSE 0 END AS settled_pending, least(k % 6, 10) AS settled_used, greatest(0, 10 - (k % 6 + CASE WHEN k % 2 = 0 THEN k % 4 ELSE 0 END)) AS settled_remaining FROM b""",
        "pool_claim": f"""WITH o AS (SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 2 = 0 THEN 'pro' ELSE 'studio' END AS edition, o_orderdate FROM orders),
            p AS (SELECT 'KEY-' || p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'studio' ELSE 'pro' END AS edition, p_partkey * 7919 % 10007 AS issued FROM part),
            a AS (SELECT *, {rank("edition ORDER BY o_orderdate, order_id")} AS n FROM o), b AS (SELECT *, {rank("edition ORDER BY issued, key")} AS n FROM p)
            SELECT a.order_id, a.edition, b.key FROM a LEFT JOIN b ON a.edition = b.edition AND a.n = b.n""",
        "order_upsert": """WITH a AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS cents, o_orderpriority AS note FROM orders WHERE o_orderkey % 3 <> 0),
            b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'canceled' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 1 END AS cents FROM orders WHERE o_orderkey % 2 = 0)
            SELECT coalesce(a.id, b.id) AS id, coalesce(b.status, 'paid') AS status, coalesce(b.cents, a.cents) AS cents, a.note FROM a FULL JOIN b ON a.id = b.id""",
        "order_lifecycle": """WITH e AS (SELECT user_id AS order_id, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'fulfilled' WHEN event_type = 'purchase' THEN 'paid' WHEN event_type = 'error' THEN 'refunded' WHEN event_type = 'signup' THEN 'canceled' END AS kind FROM events)
            SELECT order_id, count(*) AS n_events, min(seq) FILTER (kind = 'fulfilled') AS fulfilled_at, CASE WHEN bool_or(kind = 'fulfilled') THEN 'fulfilled' ELSE arg_max(kind, seq) END AS status FROM e WHERE kind IS NOT NULL GROUP BY order_id""",
        "metadata_merge": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
            SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE k END AS k, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'x' END AS id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 <> 0 AND k IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_keys FROM e""",
        "batch_fold": f"{_F} SELECT * FROM fi",
        "batch_counters": f"{_F} SELECT count(*) FILTER (state = 'completed') AS n_done, count(*) FILTER (state IN ('failed', 'cancelled')) AS n_failed, bool_and(state IN ('completed', 'failed', 'cancelled')) AS settled, bool_or(state IN ('failed', 'cancelled')) AS retryable, bool_or(state IN ('waiting', 'processing')) AS running FROM fi",
        "batch_history": f"{_F} SELECT item, state AS status, CASE WHEN state = 'failed' THEN 0 ELSE done END AS size FROM fi WHERE state IN ('completed', 'failed')",
        "batch_retry": f"{_F}, x AS (SELECT *, state IN ('failed', 'cancelled') AS a FROM fi) SELECT item, CASE WHEN a THEN 'waiting' ELSE state END AS state, CASE WHEN a THEN 0 ELSE done END AS done, CASE WHEN a THEN 0 ELSE total END AS total, CASE WHEN a THEN NULL ELSE device END AS device FROM x",
        "batch_sweep": f"{_F} SELECT item, CASE WHEN state IN ('waiting', 'processing') THEN 'cancelled' ELSE state END AS state, done, total, device, n_events FROM fi",
        "progress_monotone": f"WITH {_ITEM_SQL} SELECT item, seq, done, max(done) OVER (PARTITION BY item ORDER BY seq) AS shown FROM ev WHERE kind = 'progress'",
        "single_job_fold": f"""WITH {_ITEM_SQL}, p AS (SELECT item AS job, seq, CASE kind WHEN 'started' THEN 'processing' WHEN 'saving' THEN 'completing' ELSE kind END AS phase FROM ev)
            SELECT job, CASE WHEN bool_or(phase = 'cancelled') THEN 'cancelled' WHEN bool_or(phase = 'failed') THEN 'failed' ELSE coalesce(arg_max(phase, seq) FILTER (phase IN ('processing', 'completing', 'completed')), 'preparing') END AS phase FROM p GROUP BY job""",
        "attempt_ladder": f"""WITH RECURSIVE o AS (SELECT c_custkey, [{", ".join(pick(("ok", "oom", "open_failed", "failed", "disk_full"), n) for n in (1, 5, 25))}] AS o FROM customer),
            r AS (SELECT c_custkey, o, 0 AS attempts, 'gpu' AS device, 256 AS ceiling, '' AS result FROM o
              UNION ALL SELECT c_custkey, o, attempts + 1, CASE WHEN o[attempts + 1] = 'oom' OR (o[attempts + 1] = 'open_failed' AND device = 'gpu') THEN 'cpu' ELSE device END,
                CASE WHEN o[attempts + 1] = 'oom' OR (o[attempts + 1] = 'open_failed' AND device = 'gpu') THEN (ceiling + 1) // 2 ELSE ceiling END,
                CASE WHEN o[attempts + 1] = 'ok' THEN 'done' WHEN o[attempts + 1] = 'disk_full' THEN 'insufficient_disk' WHEN o[attempts + 1] = 'open_failed' AND device = 'cpu' THEN 'engine_unavailable' WHEN o[attempts + 1] = 'failed' THEN 'failed' ELSE '' END
              FROM r WHERE result = '' AND attempts < 3)
            SELECT c_custkey, CASE WHEN result = '' THEN 'insufficient_resources' ELSE result END AS result, attempts, device, ceiling FROM r QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY attempts DESC) = 1""",
        "recents_mru": "SELECT '/img/' || user_id AS path, max(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 12",
        "journal_cap": "SELECT o_orderkey AS seq, o_custkey, o_orderstatus FROM orders ORDER BY 1 DESC LIMIT 200",
        "lru_cache": "SELECT user_id AS id, max(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 24",
        "dedup_first": """WITH d AS (SELECT lang || '/' || source || '/' || sha256(coalesce(text, '')) AS id, doc_id, n_chars FROM documents), k AS (SELECT DISTINCT id FROM d WHERE doc_id % 10 = 0)
            SELECT id, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n_chars FROM k UNION ALL SELECT id, min(doc_id), arg_min(n_chars, doc_id) FROM d WHERE doc_id % 10 <> 0 AND id NOT IN (SELECT id FROM k) GROUP BY id""",
        "import_ladder": """SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'file_missing' WHEN lang = 'es' THEN 'unsupported_format' WHEN doc_id % 11 = 0 THEN 'file_missing' WHEN doc_id % 19 = 0 THEN 'unsupported_format' WHEN n_chars * 50000 > 209715200 THEN 'file_too_large'
            WHEN doc_id % 13 = 0 THEN 'invalid_image' WHEN doc_id % 17 = 0 THEN 'unsupported_format' WHEN doc_id % 23 = 0 OR n_chars = 0 THEN 'invalid_image' WHEN n_chars * 10 * 2000 > 64000000 THEN 'file_too_large' END AS error_code FROM documents""",
        "safe_names": """WITH RECURSIVE f AS (SELECT p_brand AS dir, CASE p_partkey % 9 WHEN 0 THEN 'a_b' WHEN 1 THEN '' ELSE 'img' END || p_size % 5 || CASE WHEN p_partkey % 9 < 5 THEN '' ELSE '-' || (p_partkey % 4 + 1) END AS stem, p_partkey AS ordinal FROM part),
            n AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY ordinal) AS i FROM f),
            r AS (SELECT dir, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS name, ['img1.png', 'img2-2.png', 'other.png'] AS held FROM f GROUP BY dir
              UNION ALL SELECT dir, i, ordinal, stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.png', list_append(held, stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.png')
              FROM (SELECT n.dir, n.i, n.ordinal, n.stem, r.held, min(k) AS k FROM r JOIN n ON n.dir = r.dir AND n.i = r.i + 1, (SELECT unnest(range(1, 1000)) AS k)
                    WHERE NOT list_contains(r.held, n.stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.png') GROUP BY n.dir, n.i, n.ordinal, n.stem, r.held))
            SELECT dir, ordinal, name FROM r WHERE i > 0""",
        "entitlement_matrix": f"""SELECT c_custkey AS holder, 'enhance,export,batch,journal' || CASE WHEN e IS NULL THEN '' ELSE ',upscale_4x,advanced_restoration,face_enhancement,unlimited_processing' END || CASE WHEN e = 'studio' THEN ',engine_controls' ELSE '' END AS features
            FROM (SELECT c_custkey, {edition} AS e FROM customer)""",
        "recipe_gate": f"WITH {recipes}, x AS (SELECT *, edition IS NULL AND (scale > 2 OR mode <> 'standard' OR filter = 'portrait') AS l FROM rc) SELECT batch, count(*) AS n_items, count(*) FILTER (l) AS n_locked, bool_or(l) AS refused FROM x GROUP BY batch",
        "preset_match": f"WITH {recipes}, p(o, preset, scale, mode, filter, intensity) AS (VALUES {presets}) SELECT rc.recipe, p.preset FROM rc LEFT JOIN p USING (scale, mode, filter, intensity)",
        "license_state": f"""WITH a AS (SELECT c_custkey, c_custkey AS k, 1760000000 AS now, {edition} AS e FROM customer), s AS (SELECT c_custkey, e, CASE WHEN k % 17 = 0 THEN 'not_activated' WHEN k % 13 = 0 OR k % 11 = 0 OR k % 19 = 0 THEN 'tampered' WHEN k % 3 = 0 AND (k % 5 <> 0 OR k % 29 = 0) THEN 'wrong_machine'
            WHEN now - 86400 * (k % 30) + CASE WHEN k % 7 = 0 THEN 3000000 ELSE 0 END > now + 300 THEN 'clock_suspect' WHEN k % 4 = 0 AND k % 9 - 4 <= 0 THEN 'expired' WHEN k % 5 = 0 AND 3600 < 1800 * (k % 6) THEN 'clock_suspect' WHEN k % 23 = 0 THEN 'revoked' ELSE 'active' END AS state FROM a)
            SELECT c_custkey, state, CASE WHEN state = 'active' THEN e END AS edition FROM s""",
        "text_format": f"""WITH {_SRC_SQL}, a AS (SELECT *, p_partkey AS k, CAST(floor(pow(3.7::DOUBLE, p_partkey % 19) * (1 + p_partkey % 7)) AS BIGINT) AS n, (p_partkey % 50 + 1) / 256.0::DOUBLE * 100 AS pct, '199' || p_partkey % 10 AS yr, p_partkey % 15 AS mo FROM s),
            b AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE w END AS iw, CASE WHEN k % 4 = 0 THEN 0 ELSE w * 2 END AS ow FROM a)
            SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0::DOUBLE < 1000 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' WHEN n / 1048576.0::DOUBLE < 10 THEN format('{{:.1f}} MB', n / 1048576.0::DOUBLE) WHEN n / 1048576.0::DOUBLE < 1000 THEN CAST(floor(n / 1048576.0::DOUBLE + 0.5) AS BIGINT) || ' MB' ELSE format('{{:.1f}} GB', n / 1073741824.0::DOUBLE) END AS bytes,
              {dims("w", "h")} AS dims, format('{{:.1f}} MP', w * h / 1e6::DOUBLE) AS mp,
              CASE WHEN pct >= 10 THEN CAST(CAST(floor(pct + 0.5) AS BIGINT) AS VARCHAR) WHEN floor(pct * 10 + 0.5) / 10 = floor(floor(pct * 10 + 0.5) / 10) THEN CAST(CAST(floor(pct * 10 + 0.5) / 10 AS BIGINT) AS VARCHAR) ELSE format('{{:.1f}}', floor(pct * 10 + 0.5) / 10) END || '%' AS zoom,
              CASE WHEN mo BETWEEN 1 AND 12 THEN {months}[mo] || ' ' || yr ELSE yr || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') END AS period, scale || '× · Detail' AS preset,
              CASE WHEN k % 5 = 0 THEN 'no output' WHEN iw = 0 OR ow = 0 THEN CASE WHEN ow > 0 THEN '→ ' || {dims("ow", "h * 2")} ELSE '—' END ELSE {dims("iw", "h")} || ' → ' || {dims("ow", "h * 2")} END AS label,
              CASE WHEN k % 2 <> 0 THEN 'The free plan allows 10 enhancements a month — one internet connection sets this month’s count up' WHEN k % 4 = 0 THEN 'All 10 free enhancements used in February 1998' ELSE k % 4 || ' of 10 free enhancements left in February 1998' END AS meter FROM b""",
        "text_paths": r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^([^:]*)://', 1) AS sc, regexp_extract(url, '^[^:]*://([^/]*)', 1) AS host, regexp_extract(url, '^[^:]*://[^/]*(.*)$', 1) AS path FROM pages)
            SELECT page_id, CASE WHEN list_extract(string_split(url, '/'), -1) = '' THEN url ELSE list_extract(string_split(url, '/'), -1) END AS name, host, CASE WHEN sc = 'https' THEN 443 ELSE 80 END AS port, CASE WHEN path = '' THEN '/' ELSE path END AS path, CASE WHEN sc = 'http' THEN 'plain http' END AS error FROM a""",
        "hash_ids": "SELECT page_id, substr(sha256(url), 1, 32) AS machine, CASE WHEN page_id % 5 <> 0 THEN 'iph' || substr(sha256('salt|' || url), 1, 40) END AS network, 'data:text/plain;base64,' || base64(encode(url)) AS data FROM pages",
    }
