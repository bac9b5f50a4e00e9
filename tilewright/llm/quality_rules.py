"""Quality rules: simple text rules first, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two smoothed multinomials over the
buckets are counted, one over the trusted target (documents labelled good) and one over the raw
corpus (all documents). A document's score is the mean log ratio of its n-grams; every document at
or above the threshold is kept. Only DataFrame functions are used. The weights are one row with an
array of `n_buckets` numbers in Parquet; the scoring plan reads them as a scalar subquery, so no plan
holds the numbers themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import SPACE_CLASS, materialize, own_columns, text_or_empty, with_names

N_BUCKETS = 1 << 16
#: Up to so many trusted ids are broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.1
SMOOTHING = 10.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MADE = (*COUNTS, "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column) -> Column:
    """Words covered by a window hash that stands beside an equal one in sorted order."""

    def covered(order: Column) -> Column:
        same = lambda j, k: F.get(order, j)["h"].eqNullSafe(F.get(order, k)["h"])
        starts = F.transform(order, lambda s, j: F.when((j > 0) & same(j, j - 1) | same(j, j + 1), s["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(starts), lambda p: F.array(p, p + 1, p + 2)))))

    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(by_hash, covered)).otherwise(0)


def _rules(text: Column, words: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(windows, _repeat_words).cast("long").alias("n_repeat_words"),
    ]


def _bucket(n_buckets: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n_buckets)).cast("int")


def ngram_weights(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row: weights, log(p_target / p_raw) of each bucket. Raw counts cover every document, the target every trusted doc_id.

    The pseudo-counts of the target are those of the raw corpus times the target's share of all
    n-grams: a bucket seen a few times says little, whichever side it was seen on. Without a trusted
    n-gram every weight is 0.
    """
    ids = materialize(trusted.filter("doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1)), "trusted")
    text = docs.select("doc_id", text_or_empty().alias("text"))
    flagged = text.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left").select(words_of(F.col("text")).alias("w"), "trusted")
    pairs = flagged.select("trusted", F.inline(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))))
    grams = pairs.select("trusted", F.explode(F.array(_bucket(n_buckets, F.col("a")), F.when(F.col("b").isNotNull(), _bucket(n_buckets, F.col("a"), F.col("b"))))).alias("bucket"))
    counted = materialize(grams.filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")), "counted")
    sums = counted.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets")).first()
    if not sums["targets"]:
        log_ratio = F.lit(0.0)
    else:
        raw, target = (F.coalesce(F.col(c), F.lit(0)) for c in ("raw", "target"))
        log_ratio = F.log((target / F.lit(sums["targets"] / sums["raws"]) + F.lit(smoothing)) / (raw + F.lit(smoothing)))
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(counted, "bucket", "left").select("bucket", log_ratio.alias("weight"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "weight")))  # n_buckets entries
    return materialize(rows.agg(F.transform(ordered, lambda e: e["weight"]).alias("weights")), "weights")


def _score(words: Column, weights: Column, n_buckets: int) -> Column:
    """Mean log ratio over the words and word pairs; 0 without words."""
    n = F.size(words)
    pair = lambda i: F.when(i < n - 1, _bucket(n_buckets, F.get(words, i), F.get(words, i + 1)))
    buckets = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(_bucket(n_buckets, F.get(words, i)), pair(i))))
    total = F.aggregate(buckets, F.lit(0.0), lambda t, b: t + F.coalesce(F.get(weights, b), F.lit(0.0)))
    return F.when(n > 0, total / (2 * n - 1)).otherwise(0.0)


def quality_rules(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the rule counts, base_failed, score and kept; one row per input row.

    Null or empty text has no words and fails the base rules. With no trusted row every score is 0;
    an id with several labels is trusted if the least of them is 1. A document is kept if it passes
    the base rules and its score is at least the threshold (ties are kept). Repeated rows are judged
    alike and counted each; an empty table gives an empty result. Columns of docs with the names made
    here are replaced; `drop_rejected` keeps them.
    """
    judged, own = _judged(docs, labels, n_buckets, threshold)
    return judged.select(*[F.col(own[c]).alias(c) for c in docs.columns if c not in MADE], *MADE)


def drop_rejected(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all columns of docs, whatever their names.

    Null and empty texts fail the base rules and go. Repeated rows stay or go together; an empty
    table gives an empty result.
    """
    judged, own = _judged(docs, labels, n_buckets, threshold)
    return with_names(judged.filter("kept"), own)


def _judged(docs: DataFrame, labels: DataFrame, n_buckets: int, threshold: float) -> tuple[DataFrame, dict[str, str]]:
    """Rows of docs with what is made of them, and the names that the columns of docs have there."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    weights = ngram_weights(docs, trusted, n_buckets)
    rows, own = own_columns(docs)
    rows = rows.withColumn("_weights", weights.scalar())

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in COUNTS], failed.alias("base_failed"), m["score"].alias("score"), (~failed & (m["score"] >= F.lit(threshold))).alias("kept"))

    judge = lambda t: let(words_of(t), lambda w: let(F.struct(*_rules(t, w), _score(w, F.col("_weights"), n_buckets).alias("score")), verdict))
    made = rows.select(*own.values(), let(text_or_empty(own["text"]), judge).alias("_made"))
    return made.select(*own.values(), *[F.col(f"_made.{c}") for c in MADE]), own
