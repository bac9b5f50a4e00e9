"""Exact dedup by deterministic block naming.

Every text, its ASCII white space deleted, is cut into fixed-size byte blocks. The distinct blocks
are sorted and numbered from 0 without gaps, so equal blocks (and only equal blocks) share an integer
name. Adjacent names are then paired, the distinct pairs sorted and numbered again, and so on until
each document is a single name. Documents of one level and one name have identical normalised texts.

Block contents cross the network once, already combined per task: they travel with a 128-bit
fingerprint, and a fingerprint that meets two different contents is found there; the run then
starts again with another seed. References to blocks carry fingerprints only, which by then are
known to separate all contents, so the names are free of collisions. Blocks are sorted by those
verified fingerprints, not by their bytes: any total order of the distinct blocks names them alike
for all documents, and this one cannot pile up in one range where a third of the blocks begin with
the same passage. Names depend on the blocks alone, not on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import SPACE_CLASS, materialize, own_columns, row_ids, text_or_empty, with_names

BLOCK_BYTES = 4096


def _fingerprint(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)]


def normalise(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), f"{SPACE_CLASS}+", "")


def _blocks(size: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_norm") / F.lit(size))).cast("int")
    data = F.col("_norm").cast("binary")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _sorted_names(distinct: DataFrame, cols: list[str], tag: str) -> DataFrame:
    """Sort the distinct keys over the whole cluster and number them in that order, from 0 without gaps."""
    ordered = distinct.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), tag)
    part, rank = F.expr("shiftright(place, 33)"), F.expr(f"place & {(1 << 33) - 1}")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*cols, (F.col("first") + rank).alias("name"))


def block_names(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Callable[[Column, int], list[Column]] = _fingerprint,
) -> DataFrame:
    """One row per input row: `_rid`, the kept columns, n_chars, text_sha256, and the identity (level, name)."""
    base = docs.select(*[F.col(c) for c in keep], F.length(text_or_empty(text_col)).cast("long").alias("n_chars"), normalise(text_col).alias("_norm"))
    for seed in range(16):
        blocks = base.select(F.explode(_blocks(block_bytes)).alias("b"))
        prints = fingerprint(F.col("b"), seed)
        met = blocks.select(prints[0].alias("f1"), prints[1].alias("f2"), "b").groupBy("f1", "f2").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        known = materialize(met.select("f1", "f2", (F.col("lo") != F.col("hi")).alias("clash")), "blocks")
        if known.filter("clash").isEmpty():
            break
    else:
        raise RuntimeError("no seed separates the blocks")
    refs = materialize(
        row_ids(
            base.select(
                *keep,
                "n_chars",
                F.sha2("_norm", 256).alias("text_sha256"),
                F.transform(_blocks(block_bytes), lambda b: F.struct(*[p.alias(f"f{i + 1}") for i, p in enumerate(fingerprint(b, seed))])).alias("parts"),
            )
        ),
        "refs",
    )
    names = _sorted_names(known.select("f1", "f2"), ["f1", "f2"], "names")
    spread = refs.select("_rid", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "part")).select("_rid", "n", "pos", "part.f1", "part.f2")
    level, ended = 0, []
    current = materialize(spread.join(names, ["f1", "f2"]).select("_rid", "n", "pos", "name"), "level")
    while True:
        ended.append(current.filter("n = 1").select("_rid", F.lit(level).alias("level"), "name"))
        open_rows = current.filter("n > 1")
        if open_rows.isEmpty():
            break
        pairs = materialize(
            open_rows.groupBy("_rid", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(pos div 2 as int)").alias("pos")).agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("r")
            ),
            "pairs",
        )
        names = _sorted_names(pairs.select("l", "r").distinct(), ["l", "r"], "names")
        level += 1
        current = materialize(pairs.join(names, ["l", "r"]).select("_rid", "n", "pos", "name"), "level")
    identity = ended[0]
    for part in ended[1:]:
        identity = identity.unionByName(part)
    return refs.drop("parts").join(identity, "_rid")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column, int], list[Column]] = _fingerprint) -> DataFrame:
    """Groups of equal normalised texts: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Null text counts as empty; all texts without a non-space character are one group. Of a group the
    row with the most code points stays, then the smallest doc_id (null ids last), then, for repeated
    rows of one doc_id, one of them. An empty table gives an empty result; other columns are ignored.
    """
    named = block_names(docs, block_bytes=block_bytes, fingerprint=fingerprint)
    best = F.min(F.struct((-F.col("n_chars")).alias("len"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_rid")))
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("best._rid")).alias("kept"), "text_sha256", "level", "name"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns of docs, whatever their names: one of each group of equal texts.

    Null counts as empty, and one of all empty texts stays. Of rows repeated under one doc_id (or
    without one) with equal texts, one of the longest originals stays. An empty table gives an empty result.
    """
    verdict = materialize(
        exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("kept").select("doc_id", "text_sha256", "times"),
        "kept",
    )
    rows, own = own_columns(docs)
    rows = rows.withColumn("_sha", F.sha2(normalise(own["text"]), 256))
    out = rows.join(verdict, rows[own["doc_id"]].eqNullSafe(verdict["doc_id"]) & (rows["_sha"] == verdict["text_sha256"]), "left_semi")
    if not verdict.filter("times > 1").isEmpty():
        longest = F.max_by(F.struct(*own.values()), F.length(text_or_empty(own["text"])))
        out = out.groupBy(own["doc_id"], "_sha").agg(longest.alias("_row")).select("_row.*")
    return with_names(out, own)
