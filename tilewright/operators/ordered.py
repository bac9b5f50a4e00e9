"""Folds in order whose steps compose: runs of rows become one small value each, in any number of tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many numbers of `seq` make a run of rows, and so many runs a run of runs.
RUN_BITS = 12


def scratch(spark: SparkSession, tag: str) -> str:
    """A new place in the folder that driver and executors share; where none is set, a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what follows never computes it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_in_order(rows: DataFrame, key: str, seq: str, value: Column, then: Callable[[Column, Column], Column], levels: int = 3) -> DataFrame:
    """key, value: the values of each key's rows, joined by `then` in order of seq.

    `then(a, b)` must be associative and give a value of the same type. Rows are joined by runs of
    2^RUN_BITS numbers of seq, then runs by runs, so no list is longer than that, but the last one:
    a key's range of seq by 2^(RUN_BITS * (levels - 1)). Rows of equal seq are joined in order of value.
    """
    kind = rows.select(value.alias("v")).schema["v"].dataType.simpleString()  # without the nullability of its fields
    held = rows.select(key, F.col(seq).cast("long").alias("_at"), value.cast(kind).alias("_v"))
    for level in range(levels):
        run = F.shiftright("_at", RUN_BITS) if level < levels - 1 else F.lit(0)
        listed = held.withColumn("_run", run).groupBy(key, "_run").agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
        joined = F.aggregate(F.expr("slice(_l, 2, size(_l))"), F.expr("_l[0]._v"), lambda a, e: then(a, e["_v"]).cast(kind))
        held = listed.select(key, F.col("_run").cast("long").alias("_at"), joined.alias("_v"))
    return held.select(key, F.col("_v").alias("value"))


# --- clamped steps ---------------------------------------------------------------------------------

#: Wide enough to hold any count, small enough to be added to.
_FAR = 1 << 60


def clamped(by: Column | int, low: Column | int = -_FAR, high: Column | int = _FAR) -> Column:
    """The step x -> min(high, max(low, x + by)); such steps compose to such steps."""
    whole = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(whole(by).alias("by"), whole(low).alias("low"), whole(high).alias("high"))


def _cut(x: Column, step: Column) -> Column:
    return F.least(step["high"], F.greatest(step["low"], x))


def after(first: Column, second: Column) -> Column:
    return clamped(first["by"] + second["by"], _cut(first["low"] + second["by"], second), _cut(first["high"] + second["by"], second))


def applied(step: Column, x: Column) -> Column:
    return _cut(x + step["by"], step)
