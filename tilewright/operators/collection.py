"""The imported collection: outcomes, selections, caches and records that follow an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.text import format_bytes

#: Failures that are named one by one, notices that stay, the bounds of the recents shown.
NAMED_FAILURES, KEPT_NOTICES, SHOWN = 3, 3, (3, 12)


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outcomes (ordinal, status, name, id, message): the imported images and the failures."""
    return outcomes.filter("status = 'imported'").select("ordinal", "id", "name"), outcomes.filter("status = 'failed'").select("ordinal", "name", "message")


def summary(images: DataFrame, by: str) -> DataFrame:
    """images (by, size_bytes): the header line of each collection."""
    made = images.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    return made.select(by, F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " image · ").otherwise(" images · "), format_bytes(F.col("bytes"))).alias("line"))


def count_new(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many different ids of arriving are not known yet."""
    return arriving.select("id").join(known.select("id"), "id", "left_anti").agg(F.count_distinct("id").alias("n_new"))


def failure_notices(failures: DataFrame, by: str) -> DataFrame:
    """failures (by, ordinal, name, message): the first three by name, and one line for the rest."""
    order = Window.partitionBy(by).orderBy("ordinal")
    first = failures.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= NAMED_FAILURES)
    named = first.select(by, F.col("_r").cast("int").alias("place"), F.concat("name", F.lit(" — "), "message").alias("notice"))
    rest = failures.groupBy(by).agg((F.count(F.lit(1)) - NAMED_FAILURES).alias("n")).filter("n > 0")
    more = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " more file could not be imported").otherwise(" more files could not be imported"))
    return named.unionByName(rest.select(by, F.lit(NAMED_FAILURES + 1).alias("place"), more.alias("notice")))


def selected(images: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """images (by, ordinal, id), wanted (by, id): the wanted image if it is there, else the first, else null."""
    hit = images.join(wanted, [by, "id"], "left_semi").select(by, F.col("id").alias("_hit")).distinct()
    first = images.groupBy(by).agg(F.min_by("id", "ordinal").alias("_first"))
    return wanted.select(by).distinct().join(first, by, "left").join(hit, by, "left").select(by, F.coalesce("_hit", "_first").alias("id"))


def keep_ids(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids.select("id"), "id", "left_semi")


def drop_ids(cache: DataFrame, ids: DataFrame) -> DataFrame:
    return cache.join(ids.select("id"), "id", "left_anti")


def remove_images(removed: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Every table keyed by id without the removed images: collection, results and exports go together."""
    return [drop_ids(t, removed) for t in tables]


def with_existence(journal: DataFrame, files: DataFrame) -> DataFrame:
    """journal (source, output, ...) with source_exists and output_exists, told by a listing (path)."""
    there = files.select("path").distinct()
    flag = lambda df, c: df.join(there.select(F.col("path").alias(c), F.lit(True).alias(f"{c}_exists")), c, "left").withColumn(f"{c}_exists", F.coalesce(f"{c}_exists", F.lit(False)))
    return flag(flag(journal, "source"), "output")


def recents_there(recents: DataFrame, files: DataFrame) -> DataFrame:
    return recents.join(files.select("path"), "path", "left_semi")


def shown_recents(recents: DataFrame, limit: int) -> DataFrame:
    """The newest of recents (path, seq), as many as the setting asks for within its bounds."""
    return recents.orderBy(F.desc("seq")).limit(min(SHOWN[1], max(SHOWN[0], limit)))


def notices(queue: DataFrame, by: str) -> DataFrame:
    """queue (by, seq, notice): the newest, and the three before it."""
    order = Window.partitionBy(by).orderBy(F.desc("seq"))
    return queue.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= KEPT_NOTICES + 1).drop("_r")


def listing(paths: DataFrame) -> DataFrame:
    """Paths in the order of their characters."""
    return paths.orderBy("path")


def put(records: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(records, lambda k, _: k != key), F.create_map(key, value))


def remove(records: Column, key: Column) -> Column:
    return F.map_filter(records, lambda k, _: k != key)
