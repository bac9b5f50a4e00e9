"""Queries of image headers, models, queues, collections, settings and shops, with their SQL.

Like the ledger queries, each derives its input by a fixed rule from whole tables; the SQL states the
same rule and what has to come out. Fixed values: the notices, reasons, error codes and labels in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import scalars as V
from tilewright.functions import text as T
from tilewright.operators import collection as C
from tilewright.operators import commerce as M
from tilewright.operators import jobs as J
from tilewright.operators import ledger as L
from tilewright.operators import policy as Y
from tilewright.operators import registry as R
from tilewright.sources import images as S

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple, k: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.expr(f"cast({k} % {len(names)} as int)"))


def _pick_sql(names: tuple, k: str) -> str:
    return f"list_extract({list(names)!r}, CAST({k} % {len(names)} + 1 AS BIGINT))"


# --- image headers ---------------------------------------------------------------------------------


def _hex(n: Column, size: int, little: bool = False) -> Column:
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]) if little else digits


def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, h = F.col("doc_id"), F.col("w"), F.col("h")
    d = _t(spark, sf_dir, "documents").select("doc_id", (1 + F.col("n_chars") % 9999).alias("w"), (1 + k * 7 % 9999).alias("h"))
    riff = lambda chunk, body: F.concat(F.lit(f"52494646000000005745425056503{chunk}00000000"), body)
    segments = F.concat(F.lit("FFD8FFE0000400FF"), F.when(k % 2 == 0, "FFFFE100050102FF").otherwise(""), F.lit("FFC4000401FFFFC2001108"))
    made = (
        F.when(k % 6 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 4), _hex(h, 4)))
        .when(k % 6 == 1, F.concat(segments, _hex(h, 2), _hex(w, 2), F.lit("03011100")))
        .when(k % 6 == 2, riff("858", F.concat(F.lit("10000000"), _hex(w - 1, 3, True), _hex(h - 1, 3, True))))
        .when(k % 6 == 3, riff("84C", F.concat(F.lit("2F"), _hex((w - 1) + F.shiftleft(h - 1, 14), 4, True))))
        .when(k % 6 == 4, riff("820", F.concat(F.lit("0000009D012A"), _hex(w + 0x4000, 2, True), _hex(h, 2, True))))
        .otherwise(F.concat(F.lit("FFD8FFE00040"), _hex(h, 2)))
    )
    d = d.withColumn("content", F.unhex(made)).withColumn("kind", S.sniff(F.col("content")))
    got_w, got_h = S.header_size(F.col("content"), F.col("kind"))
    ext = F.when(F.col("kind") == "jpeg", "jpg").otherwise(F.col("kind"))
    d = d.withColumn("width", got_w).withColumn("height", got_h)
    error = S.import_error(F.lit("a"), ext, F.lit(True), F.lit(False), F.lit(100), F.col("kind"), F.col("width"), F.col("height"))
    return d.select("doc_id", "kind", "width", "height", error.alias("error_code"))


_HEADER_SQL = """WITH d AS (SELECT doc_id, doc_id % 6 AS m, 1 + n_chars % 9999 AS w, 1 + doc_id * 7 % 9999 AS h FROM documents)
SELECT doc_id, CASE WHEN m = 0 THEN 'png' WHEN m IN (1, 5) THEN 'jpeg' ELSE 'webp' END AS kind, CASE WHEN m < 5 THEN w END AS width, CASE WHEN m < 5 THEN h END AS height,
  CASE WHEN m = 5 THEN 'invalid_image' WHEN w * h > 64000000 THEN 'file_too_large' END AS error_code FROM d"""

# --- single values ---------------------------------------------------------------------------------


def control_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_retailprice")
    quality = V.source_quality(k % 7 != 0, k % 5 == 0, F.lit(2600.0), size * 100.0, price)
    view = V.view_plan(size * 100, F.floor(price).cast("long"), F.when(k % 3 == 0, k % 4000))
    fmt = F.when(k % 2 == 0, "jpeg").otherwise("webp")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", V.slider_at(size * 20.0, F.lit(40.0), F.when(k % 11 == 0, 0.0).otherwise(800.0), F.lit(50.0)).alias("slider"),
        V.slider_key(_pick(("ArrowLeft", "ArrowRight", "Home", "End", "x"), "p_partkey"), k % 2 == 0, (k % 95 + 3).cast("double")).alias("nudged"), V.needs_full(quality, (k % 40) / 10.0).alias("escalate"),
        F.when(quality < 1e9, F.round(quality, 9)).alias("quality"), V.to_cents(F.when(k % 9 != 0, F.when(k % 31 == 0, float("-inf")).when(k % 37 == 0, float("nan")).otherwise(price))).alias("cents"), V.percent(k % 130, size % 10 * 13).alias("percent"),
        V.threads(k % 3 == 0, (k % 17).cast("int"), (k % 9).cast("int")).alias("threads"), V.quality_in_range((k % 140 - 20).cast("int")).alias("jpeg_quality"),
        V.export_limit(fmt, size * 1000, size * 900).alias("export_error"), view["original"].alias("original"), view["delivered_edge"].cast("long").alias("delivered_edge"),
    )


_CONTROL_SQL = f"""WITH a AS (SELECT p_partkey, p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_retailprice::DOUBLE AS price FROM part),
b AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0::DOUBLE WHEN k % 5 = 0 THEN 'infinity'::DOUBLE ELSE 2600::DOUBLE / greatest(s * 100.0::DOUBLE, price) END AS q, CASE WHEN k % 3 = 0 THEN greatest(1, k % 4000) ELSE 2600 END AS e, greatest(s * 100, CAST(floor(price) AS BIGINT)) AS longest,
  {_pick_sql(("ArrowLeft", "ArrowRight", "Home", "End", "x"), "p_partkey")} AS key, CASE WHEN k % 2 = 0 THEN 10 ELSE 2 END AS step, k % 95 + 3 AS p FROM a)
SELECT p_partkey, CASE WHEN k % 11 = 0 THEN 50::DOUBLE ELSE least(97::DOUBLE, greatest(3::DOUBLE, (s * 20 - 40) / 800::DOUBLE * 100)) END AS slider,
  CAST(CASE key WHEN 'ArrowLeft' THEN greatest(3, p - step) WHEN 'ArrowRight' THEN least(97, p + step) WHEN 'Home' THEN 3 WHEN 'End' THEN 97 ELSE p END AS DOUBLE) AS nudged,
  q < 'infinity'::DOUBLE AND (k % 40) / 10.0::DOUBLE > q * 1.02::DOUBLE AS escalate, CASE WHEN q < 1e9 THEN round(q, 9) END AS quality, CASE WHEN k % 9 <> 0 AND k % 31 <> 0 AND k % 37 <> 0 THEN CAST(floor(price * 100 + 0.5) AS BIGINT) END AS cents,
  CASE WHEN s % 10 > 0 THEN CAST(least(100, floor((k % 130) / (s % 10 * 13)::DOUBLE * 100 + 0.5)) AS INTEGER) END AS percent, CAST(CASE WHEN k % 3 = 0 THEN greatest(k % 17, 1) ELSE least(greatest(k % 9, 1), greatest(k % 17, 1)) END AS INTEGER) AS threads,
  CAST(greatest(1, least(100, k % 140 - 20)) AS INTEGER) AS jpeg_quality, CASE WHEN s * 1000 > CASE WHEN k % 2 = 0 THEN 65535 ELSE 16383 END THEN 'export_limit' END AS export_error, longest <= e AS original, CAST(least(longest, e) AS BIGINT) AS delivered_edge FROM b"""


def key_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    k, look = F.col("page_id"), _pick((*V.LOOK_LABELS, "nonesuch"), "page_id")
    wire = F.when(k % 4 == 0, F.hex(F.col("url").cast("binary"))).otherwise(F.concat(F.col("url"), F.lit("x")))
    return p.select(
        "page_id", V.label_of(F.when(k % 5 == 0, "Own name"), V.lookup(V.LOOK_LABELS, look)).alias("label"), V.lookup(V.LOOK_NOTES, look).alias("note"), V.lookup(V.FORMAT_KEYS, F.lower(_pick(("PNG", "jpg", "webp", "gif"), "page_id"))).alias("format"),
        R.backing(_pick(("standard", "natural", "detail", "other"), "page_id")).alias("model_mode"), V.when_label(k * 86_400_000 + k * 61_000).alias("when_text"), V.hex_decode(wire).cast("string").alias("decoded"), T.stem(F.col("url")).alias("stem"),
    )


_LABEL_SQL = f"""WITH a AS (SELECT page_id, page_id AS k, url, {_pick_sql((*V.LOOK_LABELS, "nonesuch"), "page_id")} AS look, list_extract(string_split(url, '/'), -1) AS last, epoch_ms(page_id * 86400000 + page_id * 61000) AS t FROM pages)
SELECT page_id, CASE WHEN k % 5 = 0 THEN 'Own name' ELSE list_extract({[*V.LOOK_LABELS.values()]!r}, list_position({[*V.LOOK_LABELS]!r}, look)) END AS label, list_extract({[*V.LOOK_NOTES.values()]!r}, list_position({[*V.LOOK_NOTES]!r}, look)) AS note,
  CASE k % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS format, CASE k % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'natural' WHEN 2 THEN 'standard' END AS model_mode, strftime(t, '%b %-d, %I:%M %p') AS when_text,
  CASE WHEN k % 4 = 0 THEN url END AS decoded, CASE WHEN last = '' THEN 'image' WHEN regexp_matches(last, '^.+\\.[^.]*$') THEN regexp_extract(last, '^(.+)\\.[^.]*$', 1) ELSE last END AS stem FROM a"""

# --- models and devices ----------------------------------------------------------------------------


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files: the true content is byte 8 and the part's name; some specs expect another size, sum or first byte."""
    k = F.col("p_partkey")
    content = F.concat(F.when(k % 7 == 0, F.lit("x")).otherwise(F.char(F.lit(8))), F.col("p_name"))
    return _t(spark, sf_dir, "part").select(
        k.alias("model"), k.alias("file"), (F.length(content) + (k % 5 == 0).cast("int")).cast("long").alias("size_bytes"), F.sha2(F.concat(content, F.when(k % 3 == 0, "!").otherwise("")), 256).alias("sha256"), content.cast("binary").alias("content"), F.length(content).cast("long").alias("length"),
    )


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _specs(spark, sf_dir)
    first = specs.filter("file % 11 <> 0").select(F.lit(1).alias("dir_order"), "file", "length", "content")
    second = specs.filter("file % 2 = 0").select(F.lit(2).alias("dir_order"), "file", F.lit(1).cast("long").alias("length"), F.lit(b"\x08").alias("content"))
    return R.locate(specs.select("model", "file", "size_bytes", "sha256"), first.union(second)).select("model", "state", "reason")


_STATE_SQL = """WITH a AS (SELECT p_partkey AS k, length(p_name) + 1 AS n FROM part),
b AS (SELECT *, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'size differs from the expected model' WHEN k % 3 = 0 THEN 'checksum mismatch' WHEN k % 7 = 0 THEN 'not an ONNX model file' ELSE '' END WHEN k % 2 = 0 THEN 'size differs from the expected model' END AS r FROM a)
SELECT k AS model, CASE WHEN r IS NULL THEN 'missing' WHEN r = '' THEN 'ready' ELSE 'corrupt' END AS state, nullif(r, '') AS reason FROM b"""


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _t(spark, sf_dir, "part").select(F.col("p_name").alias("model"), _pick(("standard", "natural", "other"), "p_partkey").alias("mode"), F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") % 4 == 0, "ready").otherwise("missing").alias("state"))
    modes = spark.createDataFrame([("standard",), ("natural",), ("detail",), ("nonesuch",)], "mode string")
    return R.model_for(modes, specs)


def engine_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _t(spark, sf_dir, "part").select((F.col("p_size") % 9).cast("int").alias("scale"), F.when(F.col("p_partkey") % 3 == 0, "ready").otherwise("corrupt").alias("state"))
    offer = R.offered(specs)
    return offer.select("ready", F.array_join(F.transform("scales", lambda s: s.cast("string")), ",").alias("scales"))


def device_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    gpus = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), k.alias("ordinal"), F.col("s_name").alias("name"), (k % 4).cast("long").alias("m"), (k % 3 != 0).alias("directx12"), (k % 5 == 0).alias("software"))
    return R.accelerators(gpus.withColumn("memory", F.col("m") * F.lit(3 << 29).cast("long")))


def output_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    masters = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("image"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    return R.registry_lookup(e.select(F.col("user_id").alias("image")).distinct(), masters)


def superseded_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    return R.superseded(e, e.filter("seq % 5 = 0").select("path"))


def bench_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("case"), (F.col("l_linenumber") * 1000).cast("long").alias("out_w"), (F.col("l_orderkey") % 2000).cast("long").alias("out_h"), (1 + F.col("l_partkey") % 7).alias("seconds"), F.col("l_suppkey").cast("long").alias("peak_bytes"))
    return R.throughput(li).select("case", F.round("mp_per_s", 6).alias("mp_per_s"), "peak_bytes")


# --- the collection --------------------------------------------------------------------------------


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(F.col("source"), F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("imported").alias("status"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") % 50).alias("id"), F.col("lang").alias("message"), F.col("n_chars").cast("long").alias("size_bytes"))


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each language and source, and for each source in one language of ten documents."""
    d = _t(spark, sf_dir, "documents")
    whole = d.select(F.concat_ws("/", "lang", "source").alias("collection"), (F.col("n_chars") * (1 + F.col("doc_id") % 5 * 300)).alias("size_bytes"))
    tens = d.select(F.concat(F.lit("ten/"), F.expr("cast(doc_id div 10 as string)")).alias("collection"), F.col("n_chars").alias("size_bytes"))
    return C.summary(whole.unionByName(tens), "collection")


def new_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, _ = C.split_outcomes(_outcomes(spark, sf_dir))
    return C.count_new(images, images.filter("ordinal % 9 = 0"))


def failure_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.failure_notices(_outcomes(spark, sf_dir).filter("status = 'failed'"), "source")


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("view"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("id")).filter("view % 6 <> 0")
    wanted = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view"), (F.col("n_nationkey") * 3).alias("id"))
    return C.selected(images, wanted, "view")


def remove_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three tables that follow an image hold after some images went, and what a cache keeps."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("id"))
    gone = e.filter("id % 7 = 0").select("id").distinct()
    left = C.remove_images(gone, e, e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"))
    named = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")).withColumn("what", F.lit(w)) for df, w in zip([*left, C.keep_ids(e, gone)], ("images", "results", "exports", "kept"), strict=True)]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out.select("what", "n", "total")


def journal_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.concat(F.lit("s"), (F.col("o_custkey")).cast("string")).alias("source"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("output"))
    files = _t(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("path")).union(o.filter("o_orderkey % 5 = 0").select("output"))
    return C.with_existence(o, files).select("o_orderkey", "source_exists", "output_exists")


def shown_recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    opened = L.recents(e.select(F.concat(F.lit("/img/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq")))
    there = C.recents_there(opened, e.select(F.concat(F.lit("/img/"), F.col("user_id").cast("string")).alias("path")).filter("path not like '%7'").distinct())
    return C.shown_recents(there, 2)


def notice_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.notices(_t(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.col("event_type").alias("notice")), "user")


def record_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"))
    put = C.put(F.coalesce("p", F.create_map().cast("map<string,string>")), F.lit("k"), F.col("event_id").cast("string"))
    return e.select("event_id", F.try_element_at(put, F.lit("k")).alias("k"), F.size(put).cast("int").alias("n_put"), F.size(C.remove(put, F.lit("k"))).cast("int").alias("n_left"))


# --- queues ----------------------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    states = ("waiting", "processing", "completed", "failed", "cancelled")
    return _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("queue"), k.alias("ordinal"), k.alias("item"), _pick(states, "o_orderkey").alias("state"), (k % 3 == 0).alias("cancelling"))


_ITEMS_SQL = f"""i AS (SELECT o_custkey % 100 AS queue, o_orderkey AS item, {_pick_sql(("waiting", "processing", "completed", "failed", "cancelled"), "o_orderkey")} AS state, o_orderkey % 3 = 0 AS cancelling FROM orders)"""


def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_waiting(_items(spark, sf_dir)).select("queue", "item")


def queue_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return J.pick_up(J.cancel(items, items.filter("item % 4 = 0").select("item")))


def retry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.retry_check(_items(spark, sf_dir), F.lit(5000))


def batch_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 97).alias("batch"), F.when(F.col("l_suppkey") % 97 > 2, F.col("l_linenumber")).alias("item"))
    return J.accept_batch(li)


def tile_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (1 + F.col("p_size") % 5).alias("cols"), (1 + F.col("p_partkey") % 4).alias("bands"))
    tiles = size.select("image", "cols", F.explode(F.expr("sequence(0L, bands - 1)")).alias("band")).select("image", "band", F.explode(F.expr("sequence(0L, cast(cols as bigint) - 1)")).alias("col"))
    return J.tile_progress(tiles)


# --- meters ----------------------------------------------------------------------------------------


def meter_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "purchase", "ack").when(F.col("event_type") == "view", "read")
    month = F.when(F.col("event_id") % 500 < 250, "2024-01").otherwise("2024-02")
    return L.owed(e.select(F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("meter"), F.col("event_id").alias("seq"), month.alias("month"), kind.alias("kind"), (F.col("event_id") % 7).alias("n")).filter("kind is not null"))


_OWED_SQL = """WITH RECURSIVE e AS (SELECT 'dev' || user_id AS meter, CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'ack' WHEN 'view' THEN 'read' END AS kind, CASE WHEN event_id % 500 < 250 THEN '2024-01' ELSE '2024-02' END AS month, event_id % 7 AS n, event_id FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY event_id) AS i FROM e WHERE kind IS NOT NULL),
r AS (SELECT meter, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS owed, CAST(NULL AS VARCHAR) AS was FROM k GROUP BY meter
  UNION ALL SELECT r.meter, k.i, CASE WHEN k.kind = 'add' THEN least(10, r.owed + k.n) WHEN k.kind = 'ack' THEN greatest(0, r.owed - k.n) WHEN r.was IS NOT NULL AND r.was <> k.month THEN 0 ELSE r.owed END, CASE WHEN k.kind IN ('read', 'ack') THEN k.month ELSE r.was END FROM r JOIN k ON k.meter = r.meter AND k.i = r.i + 1)
SELECT meter, arg_max(owed, i) AS owed FROM r GROUP BY meter"""


def relay_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.relay_charge(_items(spark, sf_dir).withColumnRenamed("queue", "meter"))


def meter_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    whole = F.to_json(F.struct(F.when(k % 5 == 0, "2024-99").when(k % 7 == 0, "2024").otherwise("2024-03").alias("period"), (k % 30).alias("limit"), (k % 40).alias("used"), (k % 3).alias("remaining"), F.when(k % 4 == 0, k % 2 == 0).alias("allowed"), F.when(k % 6 != 0, k).alias("server_time")))
    reply = L.read_reply(F.when(k % 11 == 0, 503).otherwise(200), F.when(k % 13 == 0, "<html>").otherwise(whole))
    return _t(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n, v in reply.items()])


_REPLY_SQL = """WITH a AS (SELECT c_custkey, c_custkey AS k, NOT (c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR (c_custkey % 7 = 0 AND c_custkey % 5 <> 0)) AS ok FROM customer)
SELECT c_custkey, CASE WHEN NOT ok THEN 'meter_unreachable' END AS error, CASE WHEN ok THEN CASE WHEN k % 5 = 0 THEN '2024-99' ELSE '2024-03' END END AS period, CASE WHEN ok THEN k % 30 END AS "limit", CASE WHEN ok THEN least(k % 40, k % 30) END AS used,
  CASE WHEN ok THEN CASE WHEN k % 4 = 0 THEN true ELSE k % 3 > 0 END END AS allowed, CASE WHEN ok THEN CASE WHEN k % 6 <> 0 THEN k ELSE 1 END END AS synced_at FROM a"""


def spend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.when(k % 17 == 0, "").when(k % 13 == 0, "not json").when(k % 11 == 0, _pick(("[1]", "null", "7", '"x"', "{}", '{"install_id":12345678,"count":1}', '{"install_id":"abcd1234","count":"1"}', '{"install_id":"abcd1234","count":1.9}', '{"install_id":"abcd1234","count":0.9}', '{"install_id":"abcd1234"}'), "c_custkey")).otherwise(F.concat(F.lit('{"install_id":" '), F.when(k % 7 == 0, "AB").otherwise("Abcd12"), F.lpad(k.cast("string"), 6, "0"), F.lit('","count":'), (k % 1200 - 3).cast("string"), F.lit("}")))
    period = F.concat(F.lit("2024-"), F.lpad((k % 20).cast("string"), 2, "0"), F.when(k % 9 == 0, "x").otherwise(""))
    return _t(spark, sf_dir, "customer").select("c_custkey", L.spend_request_error(body).alias("error"), L.server_period(period).alias("server_ok"), L.client_period(period).alias("client_ok"), L.meter_id(F.concat(F.lit(" M"), k.cast("string"), F.lit("0000000"))).alias("meter"))


_SPEND_SQL = """SELECT c_custkey, CASE WHEN k % 17 = 0 THEN 'invalid body' WHEN k % 13 = 0 THEN 'invalid json' WHEN k % 11 = 0 THEN CASE WHEN k % 10 <= 5 THEN 'unknown install id' WHEN k % 10 <> 7 THEN 'count must be an integer from 1 to 1000' END WHEN k % 1200 - 3 < 1 OR k % 1200 - 3 > 1000 THEN 'count must be an integer from 1 to 1000' END AS error,
  k % 9 <> 0 AND k % 20 BETWEEN 1 AND 12 AS server_ok, k % 9 <> 0 AS client_ok, 'm' || k || '0000000' AS meter FROM (SELECT c_custkey, c_custkey AS k FROM customer)"""

# --- the shop --------------------------------------------------------------------------------------


def webhook_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("external_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "other").otherwise("b1").alias("business_id"), F.when(F.col("event_id") % 4 == 0, "r2").when(F.col("event_id") % 4 == 1, "r1").alias("brand_id"))
    done = e.filter("external_id % 9 = 0").select("external_id").distinct()
    return M.first_deliveries(M.ours(e, "b1", "r1"), done).select("external_id", "seq")


def shop_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tier, name = _pick(("pro", "studio", "evaluate", "gold"), "c_custkey"), _pick(("dodo", " Stripe", "lemonsqueezy", "manual", "else"), "c_custkey")
    keys = F.create_map(*[x for i, n in enumerate(("api_key", "product_pro", "product_studio", "webhook_secret", "business_id", "secret_key", "fastlink_pro", "fastlink_studio")) for x in (F.lit(n), F.when(k % (11 + i) == 0, " ").otherwise("v"))])
    product = F.when(k % 6 == 0, "").when(k % 6 == 1, "p-1").when(k % 6 == 2, "p-2").otherwise("p-3")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", M.edition_of(tier).alias("edition"), M.checkout_error(tier).alias("error"), M.provider(name).alias("provider"), M.configured(name, keys).alias("configured"), M.tier_of_product(product, {"pro": "p-1", "studio": "p-2"}).alias("product_tier"),
        L.resolve_tier(M.tier_of_product(product, {"pro": "p-1", "studio": "p-2"}), tier, k % 5 == 0).alias("tier"),
    )


_SHOP_SQL = """WITH a AS (SELECT c_custkey, c_custkey AS k, list_extract(['pro', 'studio', 'evaluate', 'gold'], c_custkey % 4 + 1) AS tier, CASE c_custkey % 6 WHEN 1 THEN 'pro' WHEN 2 THEN 'studio' END AS pt FROM customer)
SELECT c_custkey, CASE WHEN k % 4 < 2 THEN tier END AS edition, CASE WHEN k % 4 = 3 THEN 'unknown tier' END AS error, CASE k % 5 WHEN 0 THEN 'dodo' WHEN 1 THEN 'stripe' WHEN 2 THEN 'lemonsqueezy' ELSE 'manual' END AS provider,
  CASE k % 5 WHEN 0 THEN k % 11 <> 0 AND k % 12 <> 0 AND k % 13 <> 0 AND k % 14 <> 0 AND k % 15 <> 0 WHEN 1 THEN k % 16 <> 0 WHEN 2 THEN k % 17 <> 0 AND k % 18 <> 0 AND k % 14 <> 0 WHEN 3 THEN true ELSE false END AS configured, pt AS product_tier,
  coalesce(pt, CASE WHEN k % 5 <> 0 AND k % 4 < 2 THEN tier END) AS tier FROM a"""


def constraint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", _pick(("pro", "studio", "gold"), "o_orderkey").alias("tier"), _pick(("pro", "studio"), "o_orderkey").alias("edition"), F.when(k % 7 != 0, k % 100 - 5).alias("amount_cents"), _pick(("pending", "paid", "fulfilled", "canceled", "refunded", "lost"), "o_orderkey").alias("status"), (k % 50 - 1).alias("used"))
    return M.constraint_faults(rows).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


def order_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders found by a payment in their metadata, the visits of download pages with their orders, and the orders behind claimed keys."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("external_id"), F.col("o_orderstatus").alias("status"), F.to_json(F.struct(F.concat(F.lit("p"), (F.col("o_custkey") % 1000).cast("string")).alias("payment_id"))).alias("metadata"))
    wanted = _t(spark, sf_dir, "customer").filter("c_custkey % 13 = 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("value"))
    paid = M.by_metadata(o, "payment_id", wanted).select(F.lit("payment").alias("how"), F.col("id").cast("string").alias("key"), "status")
    c = F.col("c_custkey")
    x = lambda n: F.concat(F.lit("x"), n.cast("string"))
    visits = _t(spark, sf_dir, "customer").select(c.alias("visit"), F.when(c % 3 == 0, x(c)).alias("session_id"), F.when(c % 3 != 2, x(c * 2)).alias("ref"), F.when(c % 2 == 0, x(c * 3)).alias("order_id"))
    seen = M.orders_of_visits(visits, o.select("external_id", "status")).select(F.lit("visit").alias("how"), F.col("visit").cast("string").alias("key"), "status")
    pool = _t(spark, sf_dir, "part").select(F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("order_id"))
    held = M.claimed_keys(pool, o).select(F.lit("claim").alias("how"), "key", "status")
    return paid.union(seen).union(held)


_LOOKUP_SQL = """WITH o AS (SELECT o_orderkey AS id, 'x' || o_orderkey AS ext, o_orderstatus AS status, o_custkey % 1000 AS p FROM orders), c AS (SELECT c_custkey AS k FROM customer)
SELECT 'payment' AS how, CAST(id AS VARCHAR) AS key, status FROM o WHERE p IN (SELECT k FROM c WHERE k % 13 = 0)
UNION ALL SELECT 'visit', CAST(k AS VARCHAR), status FROM c LEFT JOIN o ON ext = CASE WHEN k % 3 = 0 THEN 'x' || k WHEN k % 3 <> 2 THEN 'x' || (k * 2) WHEN k % 2 = 0 THEN 'x' || (k * 3) END
UNION ALL SELECT 'claim', 'K' || p_partkey, status FROM part JOIN o ON o.id = p_partkey WHERE p_partkey % 2 = 0"""


def key_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return M.activations(e.select(F.col("user_id").alias("machine"), F.col("event_id").alias("seq"), F.concat(F.lit("K "), F.expr("event_id div 200 % 3").cast("string"), F.when(F.col("event_id") % 2 == 0, "\n").otherwise("")).alias("key"), (F.col("event_id") * 10).alias("at")))


def download_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), _pick(("exe", "msi", "size", "exe_pro", "size_pro", "exe_studio", "msi_studio"), "s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" v"), (F.col("s_suppkey") % 7).cast("string"))).alias("value"))
    built = M.builds(s)
    return built.join(M.any_published(built).withColumnRenamed("published", "any_published"), "site")


# --- settings and plans ----------------------------------------------------------------------------


def _plan(k: Column) -> dict[str, Column]:
    listed = F.when(k % 4 == 0, F.array(F.lit("upscale_4x"))).when(k % 4 == 1, F.array(F.lit("upscale_4x"), F.lit("advanced_restoration"), F.lit("face_enhancement"))).otherwise(F.array().cast("array<string>"))
    return Y.plan_view(F.when(k % 7 != 0, F.when(k % 3 == 0, "expired").otherwise("active")), F.when(k % 5 == 0, "studio").when(k % 5 == 1, "pro"), listed)


def plan_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plan = _plan(k)
    offered = F.when(k % 6 != 0, F.transform(F.array(*map(F.lit, ("vivid", "portrait", "extra", "soft"))), lambda n: F.struct(n.alias("key"), (F.length(n) != 4 + k % 3).alias("available"))))
    looks = Y.available_looks(offered)
    scale, mode, look = _pick((2, 4), "c_custkey"), _pick(("standard", "natural", "detail"), "c_custkey"), _pick(("vivid", "portrait", "original"), "c_custkey")
    can = Y.runnable(plan, F.array(F.lit(2), F.lit(4)), F.array(*map(F.lit, Y.MODES)), looks, scale, mode, look)
    need = Y.preset_need(scale, mode, look)
    join = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", plan["known"].alias("known"), plan["tier"].alias("tier"), need.alias("need"), Y.plan_lock(plan, need).alias("lock"), join(looks).alias("looks"), join(can["scales"]).alias("scales"), join(can["modes"]).alias("modes"),
        can["scale"].alias("scale"), can["mode"].alias("mode"), can["look"].alias("look"),
    )


_PLAN_SQL = f"""WITH a AS (SELECT c_custkey, c_custkey AS k, c_custkey % 7 <> 0 AS known, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'studio' WHEN 1 THEN 'pro' ELSE 'free' END ELSE 'free' END AS tier,
  {_pick_sql((2, 4), "c_custkey")} AS s, {_pick_sql(("standard", "natural", "detail"), "c_custkey")} AS m, {_pick_sql(("vivid", "portrait", "original"), "c_custkey")} AS f FROM customer),
b AS (SELECT *, k % 4 < 2 AS up, k % 4 = 1 AS more, tier <> 'free' AS paid, CASE WHEN k % 6 = 0 THEN {list(Y.LOOKS)!r} ELSE list_filter(['vivid', 'portrait', 'soft'], lambda x: length(x) <> 4 + k % 3) END AS looks,
  CASE WHEN s > 2 THEN 'upscale_4x' WHEN m <> 'standard' THEN 'advanced_restoration' WHEN f = 'portrait' THEN 'face_enhancement' END AS need FROM a),
c AS (SELECT *, NOT known OR up AS s4, NOT known OR more OR paid AS adv FROM b),
d AS (SELECT *, CASE WHEN adv THEN looks ELSE list_filter(looks, lambda x: x <> 'portrait') END AS ok FROM c)
SELECT c_custkey, known, tier, need, CASE WHEN known AND need IS NOT NULL AND NOT paid AND NOT (CASE WHEN need = 'upscale_4x' THEN up ELSE more END) THEN 'pro' END AS lock, array_to_string(looks, ',') AS looks, CASE WHEN s4 THEN '2,4' ELSE '2' END AS scales,
  CASE WHEN adv THEN 'standard,natural,detail' ELSE 'standard' END AS modes, CASE WHEN s4 THEN s ELSE 2 END AS scale, CASE WHEN adv THEN m ELSE 'standard' END AS mode, CASE WHEN list_contains(ok, f) THEN f ELSE 'original' END AS look FROM d"""


def settings_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    general = F.struct(_pick(("dark", "blue"), "c_custkey").alias("theme"), (k % 20).alias("recentFilesLimit"))
    raw = F.when(k % 5 != 0, F.to_json(F.struct(general.alias("general"), F.struct((k % 6).alias("defaultScale"), F.when(k % 2 == 0, "cpu").otherwise("gpu").alias("enginePath"), (k % 130 + 0.5).alias("defaultIntensity")).alias("processing"), F.struct(F.concat(F.lit("/d"), k.cast("string")).alias("folder"), F.lit("tiff").alias("format")).alias("export"))))
    c = _t(spark, sf_dir, "customer").select("c_custkey", Y.normalise_settings(raw, _pick(("system", "none"), "c_custkey"), F.when(k % 3 == 0, '{"mode":"detail","scale":2}')).alias("s"))
    c = c.withColumn("t", Y.patch_settings(F.col("s"), {"scale": k % 4, "speed": F.when(k % 4 == 0, "maximum").otherwise("warp")})).withColumn("h", Y.engine_hints(F.col("t")))
    return c.select("c_custkey", "s.theme", "s.recents_limit", "s.scale", "s.mode", "s.intensity", "s.engine_path", "s.folder", "s.format", F.col("t.scale").alias("patched_scale"), "h.cpu_only", "h.full_power", "h.record_recents")


_SETTINGS_SQL = """WITH a AS (SELECT c_custkey, c_custkey AS k, c_custkey % 5 <> 0 AS has FROM customer)
SELECT c_custkey, CASE WHEN has THEN CASE WHEN k % 2 = 0 THEN 'dark' ELSE 'light' END ELSE CASE WHEN k % 2 = 0 THEN 'system' ELSE 'light' END END AS theme, CAST(CASE WHEN has THEN least(12, greatest(3, k % 20)) ELSE 6 END AS INTEGER) AS recents_limit,
  CAST(CASE WHEN has THEN CASE WHEN k % 6 IN (2, 4) THEN k % 6 ELSE 4 END WHEN k % 3 = 0 THEN 2 ELSE 4 END AS INTEGER) AS scale, CASE WHEN NOT has AND k % 3 = 0 THEN 'detail' ELSE 'standard' END AS mode, CAST(CASE WHEN has THEN least(100, k % 130 + 1) ELSE 50 END AS INTEGER) AS intensity,
  CASE WHEN has AND k % 2 = 0 THEN 'cpu' ELSE 'auto' END AS engine_path, CASE WHEN has THEN '/d' || k ELSE '' END AS folder, 'png' AS format, CAST(CASE WHEN k % 4 = 2 THEN 2 ELSE 4 END AS INTEGER) AS patched_scale, has AND k % 2 = 0 AS cpu_only, k % 4 = 0 AS full_power, true AS record_recents FROM a"""


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, None).when(k % 4 == 1, "{broken").otherwise(F.concat(F.lit('{"version":'), (k % 3).cast("string"), F.lit(',"used":'), k.cast("string"), F.lit("}")))
    c = _t(spark, sf_dir, "customer").select("c_custkey", V.stored_record(raw, "used long", 2).alias("r"), V.stored_key(F.when(k % 5 == 0, "cred"), k % 3 == 0, F.when(k % 2 == 0, "file")).alias("key"))
    return c.select("c_custkey", F.coalesce("r.used", F.lit(0)).alias("used"), "key")


def queries() -> dict[str, Query]:
    found = (
        header_sizes, control_values, key_labels, model_states, model_choice, engine_offer, device_choice, output_registry, superseded_masters, bench_throughput, collection_summary, new_images, failure_notices, selection,
        remove_records, journal_existence, shown_recents, notice_queue, record_edits, queue_next, queue_cancel, retry_check, batch_caps, tile_progress, meter_owed, relay_charges, meter_replies, spend_requests, webhook_claims,
        shop_maps, constraint_faults, order_lookups, key_activations, download_builds, plan_controls, settings_records, stored_state,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "header_sizes": _HEADER_SQL,
        "control_values": _CONTROL_SQL,
        "key_labels": _LABEL_SQL,
        "model_states": _STATE_SQL,
        "model_choice": """WITH r AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'natural' END AS m, arg_min(p_name, p_partkey) AS model FROM part WHERE p_size % 4 = 0 AND p_partkey % 3 < 2 GROUP BY 1)
            SELECT v.mode, r.model FROM (VALUES ('standard', 'standard'), ('natural', 'natural'), ('detail', 'standard'), ('nonesuch', NULL)) v(mode, b) LEFT JOIN r ON r.m = v.b""",
        "engine_offer": """WITH s AS (SELECT DISTINCT unnest(CASE WHEN p_size % 9 >= 4 AND p_size % 9 % 2 = 0 THEN [p_size % 9 // 2, p_size % 9] ELSE [greatest(p_size % 9, 2)] END) AS s FROM part WHERE p_partkey % 3 = 0)
            SELECT count(*) > 0 AS ready, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS scales FROM s""",
        "device_choice": """WITH g AS (SELECT s_nationkey AS host, s_name, s_suppkey AS k, s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AS ok FROM supplier), b AS (SELECT host, arg_max(s_name, (k % 4) * 1000000000 + k) FILTER (ok) AS gpu, max(k % 4) FILTER (ok) AS m FROM g GROUP BY host)
            SELECT host, gpu, CASE WHEN gpu IS NULL THEN 'CPU (no DirectX 12 GPU found)' ELSE gpu || ' · ' || greatest(1, CAST(floor(m * 1.5::DOUBLE + 0.5) AS BIGINT)) || ' GB VRAM' END AS summary FROM b""",
        "output_registry": """SELECT image, path, CASE WHEN path IS NULL THEN 'file_missing' END AS error_code FROM (SELECT user_id AS image, 'm' || max(event_id) FILTER (event_type = 'purchase') AS path FROM events GROUP BY user_id)""",
        "superseded_masters": "SELECT user_id AS image, 'm' || event_id AS path FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events) WHERE event_id < newest OR event_id % 5 = 0",
        "bench_throughput": """SELECT l_returnflag AS "case", round(sum(l_linenumber * 1000 * (l_orderkey % 2000)) / 1e6::DOUBLE / sum(1 + l_partkey % 7), 6) AS mp_per_s, CAST(max(l_suppkey) AS BIGINT) AS peak_bytes FROM lineitem GROUP BY 1""",
        "collection_summary": """WITH i AS (SELECT lang || '/' || source AS collection, n_chars * (1 + doc_id % 5 * 300) AS b FROM documents UNION ALL SELECT 'ten/' || doc_id // 10, n_chars FROM documents),
            g AS (SELECT collection, count(*) AS c, CAST(sum(b) AS BIGINT) AS n FROM i GROUP BY collection)
            SELECT collection, c || CASE WHEN c = 1 THEN ' image · ' ELSE ' images · ' END || CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0::DOUBLE < 1000 THEN CAST(floor(n / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' KB' WHEN n / 1048576.0::DOUBLE < 10 THEN format('{:.1f} MB', n / 1048576.0::DOUBLE)
              WHEN n / 1048576.0::DOUBLE < 1000 THEN CAST(floor(n / 1048576.0::DOUBLE + 0.5) AS BIGINT) || ' MB' ELSE format('{:.1f} GB', n / 1073741824.0::DOUBLE) END AS line FROM g""",
        "new_images": "SELECT count(DISTINCT doc_id % 50) AS n_new FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 50 NOT IN (SELECT doc_id % 50 FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 9 = 0)",
        "failure_notices": """WITH f AS (SELECT source, 'f' || doc_id || ' — ' || lang AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) - 3 AS m FROM documents WHERE doc_id % 4 = 0)
            SELECT source, CAST(r AS INTEGER) AS place, t AS notice FROM f WHERE r <= 3 UNION ALL SELECT source, CAST(4 AS INTEGER), m || CASE WHEN m = 1 THEN ' more file could not be imported' ELSE ' more files could not be imported' END FROM f WHERE r = 1 AND m > 0""",
        "selection": """WITH i AS (SELECT s_nationkey AS v, min(s_suppkey) AS f FROM supplier WHERE s_nationkey % 6 <> 0 GROUP BY 1) SELECT n_nationkey AS view, coalesce(h.s_suppkey, i.f) AS id FROM nation LEFT JOIN i ON i.v = n_nationkey
            LEFT JOIN supplier h ON h.s_nationkey = n_nationkey AND h.s_suppkey = n_nationkey * 3 AND n_nationkey % 6 <> 0""",
        "remove_records": """WITH e AS (SELECT event_id AS i, user_id % 7 = 0 AS gone FROM events) SELECT 'images' AS what, count(*) AS n, CAST(sum(i) AS BIGINT) AS total FROM e WHERE NOT gone UNION ALL SELECT 'results', count(*), CAST(sum(i) AS BIGINT) FROM e WHERE NOT gone AND i % 2 = 0
            UNION ALL SELECT 'exports', count(*), CAST(sum(i) AS BIGINT) FROM e WHERE NOT gone AND i % 3 = 0 UNION ALL SELECT 'kept', count(*), CAST(sum(i) AS BIGINT) FROM e WHERE gone""",
        "journal_existence": "SELECT o_orderkey, o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS source_exists, o_orderkey % 5 = 0 AS output_exists FROM orders",
        "shown_recents": """WITH r AS (SELECT '/img/' || user_id AS path, max(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 12) SELECT * FROM r WHERE path NOT LIKE '%7' ORDER BY seq DESC LIMIT 3""",
        "notice_queue": "SELECT user_id AS user, event_id AS seq, event_type AS notice FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4",
        "record_edits": """SELECT event_id, CAST(event_id AS VARCHAR) AS k, CAST(coalesce(len(json_keys(props)), 0) + CASE WHEN coalesce(list_contains(json_keys(props), 'k'), false) THEN 0 ELSE 1 END AS INTEGER) AS n_put,
            CAST(coalesce(len(json_keys(props)), 0) - CASE WHEN coalesce(list_contains(json_keys(props), 'k'), false) THEN 1 ELSE 0 END AS INTEGER) AS n_left FROM events""",
        "queue_next": f"WITH {_ITEMS_SQL} SELECT queue, min(item) AS item FROM i WHERE state = 'waiting' AND NOT cancelling GROUP BY queue",
        "queue_cancel": f"""WITH {_ITEMS_SQL}, a AS (SELECT *, item % 4 = 0 AND state IN ('waiting', 'processing') AS accepted FROM i)
            SELECT item, CASE WHEN state = 'waiting' AND (cancelling OR accepted) THEN 'cancelled' ELSE state END AS state, cancelling OR accepted AS cancelling, accepted FROM a""",
        "retry_check": f"WITH {_ITEMS_SQL} SELECT count(*) FILTER (state IN ('failed', 'cancelled')) AS n_retried, count(*) FILTER (state IN ('failed', 'cancelled')) BETWEEN 1 AND 5000 AS allowed FROM i",
        "batch_caps": "SELECT l_suppkey % 97 AS batch, count(*) FILTER (l_suppkey % 97 > 2) AS n_items, count(*) FILTER (l_suppkey % 97 > 2) NOT BETWEEN 1 AND 500 AS refused FROM lineitem GROUP BY 1",
        "tile_progress": """WITH s AS (SELECT p_partkey AS image, 1 + p_size % 5 AS cols, 1 + p_partkey % 4 AS bands FROM part), t AS (SELECT image, cols, bands, unnest(range(cols * bands)) AS i FROM s)
            SELECT image, CAST(i // cols AS BIGINT) AS band, CAST(i % cols AS BIGINT) AS col, CAST(i + 1 AS BIGINT) AS done, CAST(cols * bands AS BIGINT) AS total FROM t""",
        "meter_owed": _OWED_SQL,
        "relay_charges": f"WITH {_ITEMS_SQL} SELECT queue AS meter, count(*) FILTER (state = 'completed') AS credits FROM i GROUP BY queue",
        "meter_replies": _REPLY_SQL,
        "spend_requests": _SPEND_SQL,
        "webhook_claims": """SELECT user_id AS external_id, min(event_id) AS seq FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0 AND event_id % 4 <> 0 AND user_id % 9 <> 0 GROUP BY user_id""",
        "shop_maps": _SHOP_SQL,
        "constraint_faults": """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN k % 3 = 2 THEN 'tier' END, CASE WHEN k % 7 <> 0 AND k % 100 < 5 THEN 'amount_cents' END, CASE WHEN k % 6 = 5 THEN 'status' END, CASE WHEN k % 50 = 0 THEN 'used' END], lambda x: x IS NOT NULL), ',') AS faults FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
        "order_lookups": _LOOKUP_SQL,
        "key_activations": """WITH a AS (SELECT user_id AS machine, event_id AS seq, event_id // 200 % 3 AS k FROM events), b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY machine ORDER BY seq) = k, false) AS same FROM a),
            c AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY machine ORDER BY seq) AS run FROM b) SELECT machine, seq, same AS already_active, min(seq * 10) OVER (PARTITION BY machine, run) AS activated_at FROM c""",
        "download_builds": """WITH s AS (SELECT s_nationkey AS site, s_suppkey % 7 AS n, CASE WHEN s_suppkey % 5 <> 0 THEN 'v' || s_suppkey % 7 END AS v FROM supplier), p AS (SELECT DISTINCT site, unnest(['free', 'pro', 'studio']) AS plan FROM s),
            f AS (SELECT site, CASE WHEN n < 3 THEN 'free' WHEN n < 5 THEN 'pro' ELSE 'studio' END AS plan, max(v) FILTER (n IN (0, 3, 5)) AS exe, max(v) FILTER (n IN (1, 6)) AS msi, max(v) FILTER (n IN (2, 4)) AS size FROM s GROUP BY 1, 2)
            SELECT p.site, p.plan, exe, msi, size, exe IS NOT NULL AS published, bool_or(exe IS NOT NULL) OVER (PARTITION BY p.site) AS any_published FROM p LEFT JOIN f USING (site, plan)""",
        "plan_controls": _PLAN_SQL,
        "settings_records": _SETTINGS_SQL,
        "stored_state": """SELECT c_custkey, CASE WHEN k % 4 >= 2 AND k % 3 = 2 THEN k ELSE 0 END AS used, CASE WHEN k % 5 = 0 THEN 'cred' WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'file' ELSE '' END END AS key FROM (SELECT c_custkey, c_custkey AS k FROM customer)""",
    }
