"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import conversation_repair as _conversations
from tilewright.llm import divergence as _divergence
from tilewright.llm import exact_dedup as _exact
from tilewright.llm import lm as _lm
from tilewright.llm import minhash as _minhash
from tilewright.llm import mixing as _mixing
from tilewright.llm import packing as _packing
from tilewright.llm import passages as _passages
from tilewright.llm import quality_classifier as _classifier
from tilewright.llm import quality_rules as _rules
from tilewright.llm import secret_scan as _secrets
from tilewright.llm import sharding as _sharding
from tilewright.llm import suffix_dedup as _suffix
from tilewright.llm import url_filter as _urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Hosts that the list names from the first day on.
KNOWN_BAD = ("spam-farm.example.org", "cheap-pills.example.com")
#: A capture's fetch time and a list's dates are derived, as the tables have none: from page_id and from md5 digits of the host.
_FETCHED = "timestamp_seconds(1704067200 + (page_id * 7919 % 366) * 86400 + page_id % 86400)"


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries: the known bad hosts from the start; a quarter of the other hosts added on one day and, of those, half removed later."""
    hosts = pages.select(_urls.host_of(F.col("url")).alias("h")).filter("h <> ''").distinct().withColumn("m", F.md5(F.col("h").cast("binary")))
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(m, {k}, 1)) - 1")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    listed = hosts.filter(digit(1) < 4).withColumn("d", digit(2) * 16 + digit(3)).withColumn("list", F.when(digit(5) < 8, "adult").otherwise("malware"))
    added = listed.select("list", F.lit("host").alias("kind"), F.col("h").alias("pattern"), F.lit("add").alias("action"), day(F.col("d")).alias("at"))
    removed = listed.filter(digit(4) < 8).select("list", F.lit("host").alias("kind"), F.col("h").alias("pattern"), F.lit("remove").alias("action"), day(F.col("d") + 60).alias("at"))
    known = pages.sparkSession.createDataFrame([("spam", "domain", h, "add", 1704067200) for h in KNOWN_BAD], "list string, kind string, pattern string, action string, at long")
    # by the url's own digits: an eighth of the urls as such, and of another eighth the first part of the path
    urls = pages.select("url").distinct().withColumn("h", _urls.host_of(F.col("url"))).filter("h <> ''").withColumn("m", F.md5(F.col("url").cast("binary")))
    whole = urls.filter(digit(1) < 2).select(F.lit("pages").alias("list"), F.lit("url").alias("kind"), F.col("url").alias("pattern"), F.lit("add").alias("action"), day(digit(2) * 16).alias("at"))
    first = F.try_element_at(F.array_remove(F.split(_urls.path_of(F.col("url")), "/"), ""), F.lit(1))
    parts = urls.filter((digit(1) >= 2) & (digit(1) < 4) & first.isNotNull()).select(F.lit("paths").alias("list"), F.lit("prefix").alias("kind"), F.concat("h", F.lit("/"), first).alias("pattern"), F.lit("add").alias("action"), day(digit(3) * 20).alias("at"))
    gone = parts.filter("substr(md5(cast(pattern as binary)), 1, 1) < '8'").withColumn("action", F.lit("remove")).withColumn("at", F.timestamp_seconds(F.unix_timestamp("at") + 90 * 86400))
    return known.withColumn("at", F.timestamp_seconds("at")).unionByName(added).unionByName(removed).unionByName(whole).unionByName(parts).unionByName(gone)


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = _urls.filter_urls(pages.withColumn("fetched_at", F.expr(_FETCHED)), url_list(pages))
    return judged.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_s"), "host", "blocked", "n_active", "lists")


OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919 % 366) * 86400 + page_id % 86400 AS t,
         list_extract(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@'), -1) AS authority,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages
), b AS (
  SELECT *, lower(CASE WHEN authority LIKE '[%' THEN split_part(authority, ']', 1) || ']' ELSE split_part(authority, ':', 1) END) AS dotted FROM a
), c AS (
  SELECT page_id, url, t, parts, CASE WHEN dotted LIKE '%.' THEN left(dotted, -1) ELSE dotted END AS host FROM b
), h AS (
  SELECT DISTINCT host, md5(host) AS m FROM c WHERE host <> ''
), x AS (
  SELECT host, CASE WHEN instr('0123456789abcdef', substr(m, 5, 1)) - 1 < 8 THEN 'adult' ELSE 'malware' END AS list,
         (instr('0123456789abcdef', substr(m, 2, 1)) - 1) * 16 + instr('0123456789abcdef', substr(m, 3, 1)) - 1 AS d,
         instr('0123456789abcdef', substr(m, 4, 1)) - 1 < 8 AS ends
  FROM h WHERE instr('0123456789abcdef', substr(m, 1, 1)) - 1 < 4
), y AS (
  SELECT DISTINCT url, host, parts, instr('0123456789abcdef', substr(md5(url), 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(md5(url), 2, 1)) - 1 AS d2, instr('0123456789abcdef', substr(md5(url), 3, 1)) - 1 AS d3
  FROM c WHERE host <> ''
), p AS (
  SELECT host || '/' || parts[1] AS pattern, 1704067200 + d3 * 20 * 86400 AS since FROM y WHERE d1 IN (2, 3) AND len(parts) > 0
), e AS (
  SELECT list, 'host' AS kind, host AS pattern, 'add' AS action, 1704067200 + d * 86400 AS since FROM x
  UNION ALL SELECT list, 'host', host, 'remove', 1704067200 + (d + 60) * 86400 FROM x WHERE ends
  UNION ALL SELECT 'spam', 'domain', unnest(['spam-farm.example.org', 'cheap-pills.example.com']), 'add', 1704067200
  UNION ALL SELECT 'pages', 'url', url, 'add', 1704067200 + d2 * 16 * 86400 FROM y WHERE d1 < 2
  UNION ALL SELECT 'paths', 'prefix', pattern, 'add', since FROM p
  UNION ALL SELECT 'paths', 'prefix', pattern, 'remove', since + 90 * 86400 FROM p WHERE substr(md5(pattern), 1, 1) < '8'
), s AS (
  SELECT list, kind, pattern, since, min(CASE action WHEN 'add' THEN 1 ELSE 0 END) AS live FROM e GROUP BY ALL
), k AS (
  SELECT page_id, t, 'host' AS kind, host AS pattern FROM c WHERE host <> ''
  UNION ALL SELECT page_id, t, 'url', url FROM c WHERE host <> ''
  UNION ALL SELECT page_id, t, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c WHERE host <> '')
  UNION ALL
  SELECT page_id, t, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
), l AS (
  SELECT DISTINCT list FROM e
), v AS (
  SELECT k.page_id, k.kind, k.pattern, l.list, arg_max(s.live, s.since) AS live
  FROM k CROSS JOIN l JOIN s ON s.kind = k.kind AND s.pattern = k.pattern AND s.list = l.list AND s.since <= k.t GROUP BY ALL
), f AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM v WHERE live = 1 GROUP BY page_id
)
SELECT c.page_id, c.url, CAST(c.t AS BIGINT) AS fetched_s, c.host, f.n IS NOT NULL AS blocked, CAST(coalesce(f.n, 0) AS BIGINT) AS n_active, coalesce(f.lists, '') AS lists
FROM c LEFT JOIN f ON f.page_id = c.page_id
"""


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_boosted_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.shard(_table(spark, sf_dir, "documents"))


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score_texts(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), max_rate=None)


def op9_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS sh
  FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

def op10_two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.remove_repeats(_table(spark, sf_dir, "documents"), passage_words=_passages.WORDS)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op11_weighted_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return _conversations.audit_conversations(conversations, _conversations.damaged(conversations))


def op12_chain_field_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_wide_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence.audit_sources(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(c.c), 0) AS HUGEINT) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v) AS p
  FROM n JOIN k ON k.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term
), q AS (
  SELECT c.lang, c.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.c) + 5)) // (any_value(l.n) + 5 * any_value(v.v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) l ON l.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, c.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS i, y.source AS j, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.i = a.source AND s.j = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_temporal_url_filter": op1_temporal_url_filter,
        "op2_circulant_minhash": op2_circulant_minhash,
        "op3_ngram_ratio_rules": op3_ngram_ratio_rules,
        "op4_boosted_tree_quality": op4_boosted_tree_quality,
        "op5_best_fit_shards": op5_best_fit_shards,
        "op6_elias_fano_lm": op6_elias_fano_lm,
        "op7_bounded_space_packing": op7_bounded_space_packing,
        "op8_soft_membership_mixing": op8_soft_membership_mixing,
        "op9_block_naming_dedup": op9_block_naming_dedup,
        "op10_two_stage_suffix_dedup": op10_two_stage_suffix_dedup,
        "op11_weighted_composition": op11_weighted_composition,
        "op12_chain_field_secrets": op12_chain_field_secrets,
        "op13_wide_term_vectors": op13_wide_term_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_temporal_url_filter": OP1_SQL, "op2_circulant_minhash": OP2_SQL, "op9_block_naming_dedup": OP9_SQL, "op13_wide_term_vectors": OP13_SQL}
