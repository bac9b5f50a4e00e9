"""Model files, devices and what an engine offers, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.scalars import MODE_KEYS, accelerator_summary

#: Fixed value: modes that run on another mode's model.
BACKED_BY = {"detail": "standard"}


def locate(specs: DataFrame, files: DataFrame) -> DataFrame:
    """specs (model, file, size_bytes, sha256), files (dir_order, file, length, content): model, state, reason.

    The first folder that holds a file decides, damaged or not; then its size, its checksum and its
    first byte (8, a fixed value) are judged in this order.
    """
    first = files.groupBy("file").agg(F.min_by(F.struct("length", "content"), "dir_order").alias("f")).select("file", "f.length", "f.content")
    sha, magic = F.sha2("content", 256), F.hex(F.substring("content", 1, 1)) == "08"
    reason = (
        F.when(F.col("length") != F.col("size_bytes"), "size differs from the expected model").when(F.col("content").isNull(), "file unreadable").when(sha != F.col("sha256"), "checksum mismatch").when(~magic, "not an ONNX model file")
    )
    state = F.when(F.col("length").isNull(), "missing").when(reason.isNotNull(), "corrupt").otherwise("ready")
    return specs.join(first, "file", "left").select("model", state.alias("state"), F.when(F.col("length").isNotNull(), reason).alias("reason"))


def backing(mode: Column) -> Column:
    """The mode whose model runs a mode; null for an unknown key."""
    out = mode
    for name, other in BACKED_BY.items():
        out = F.when(mode == name, other).otherwise(out)
    return F.when(mode.isin(*MODE_KEYS), out)


def model_for(modes: DataFrame, specs: DataFrame) -> DataFrame:
    """modes (mode), specs (model, mode, ordinal, state): the first ready model of each mode, or null."""
    ready = specs.filter("state = 'ready'").filter(F.col("mode").isin(*MODE_KEYS)).groupBy(F.col("mode").alias("_backing")).agg(F.min_by("model", "ordinal").alias("model"))
    return modes.withColumn("_backing", backing(F.col("mode"))).join(F.broadcast(ready), "_backing", "left").select("mode", "model")


def product_scales(scale: Column) -> Column:
    half = F.when((scale >= 4) & (scale % 2 == 0), (scale / 2).cast("int"))
    return F.array_distinct(F.array_compact(F.array(half, F.greatest(scale, F.lit(2)).cast("int"))))


def offered(specs: DataFrame) -> DataFrame:
    """One row: ready (any model is) and the scales of the ready ones, sorted, once each."""
    scales = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("state") == "ready", product_scales(F.col("scale")))))))
    return specs.agg(F.coalesce(F.bool_or(F.col("state") == "ready"), F.lit(False)).alias("ready"), scales.alias("scales"))


def accelerators(gpus: DataFrame) -> DataFrame:
    """gpus (host, ordinal, name, memory, directx12, software): the device of each host and its summary.

    Only hardware with the needed interface counts; of equal memories the last device stands.
    """
    usable = F.col("directx12") & ~F.col("software")
    best = F.max(F.when(usable, F.struct("memory", "ordinal", "name")))
    found = gpus.groupBy("host").agg(best.alias("b"))
    return found.select("host", F.col("b.name").alias("gpu"), accelerator_summary(F.col("b.name"), F.col("b.memory")).alias("summary"))


def latest_masters(masters: DataFrame) -> DataFrame:
    """masters (image, path, seq): the newest of each image, which the registry holds."""
    return masters.groupBy("image").agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("seq"))


def superseded(masters: DataFrame, exported: DataFrame) -> DataFrame:
    """Files to remove: all but an image's newest (seq is unique in an image), and masters of a batch (exported: path) after their export."""
    newest = masters.groupBy("image").agg(F.max("seq").alias("_newest"))
    marked = masters.join(newest, "image").join(exported.select("path").distinct().withColumn("_out", F.lit(True)), "path", "left")
    return marked.filter("seq < _newest or _out").select("image", "path")


def registry_lookup(asked: DataFrame, masters: DataFrame) -> DataFrame:
    """asked (image): its latest master, or file_missing."""
    found = asked.join(latest_masters(masters), "image", "left")
    return found.select("image", "path", F.when(F.col("path").isNull(), "file_missing").alias("error_code"))


def throughput(runs: DataFrame) -> DataFrame:
    """runs (case, out_w, out_h, seconds, peak_bytes): megapixels a second and the largest working set."""
    mp = F.sum(F.col("out_w") * F.col("out_h")) / 1e6
    return runs.groupBy("case").agg((mp / F.sum("seconds")).alias("mp_per_s"), F.max("peak_bytes").alias("peak_bytes"))
