"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the maximal runs of other characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a local session gets a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Paths that `materialize` has written, in order, until a `Scratch` takes them away.
_written: list[str] = []


class Scratch:
    """Tables that are written inside a `with` block and needed no longer after it, but for those that are kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.first = len(_written)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df was read from one table written here: that table stays."""
        self.kept |= {p for p in _written[self.first :] if any(p.rsplit("/", 1)[-1] in f for f in df.inputFiles())}
        return df

    def __exit__(self, *failed) -> None:
        gone = [p for p in _written[self.first :] if p not in self.kept]
        _written[self.first :] = [p for p in _written[self.first :] if p in self.kept]
        drop_tables(self.spark, gone)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors
    and pins values that depend on partitioning (row numbers, names)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path, compression=compression)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def own_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that no column of ours has, and those names by the old ones; `with_names` turns back."""
    own = {c: f"_own_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def with_names(df: DataFrame, own: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(o).alias(c) for c, o in own.items()])


def row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A row number of its own for every row; only stable once materialized."""
    return df.withColumn(name, F.monotonically_increasing_id())


def salted_rank(df: DataFrame, keys: list[str], order: list[str], n_salts: int, out: str) -> DataFrame:
    """0-based rank of each row among the rows of equal keys, without a window over a whole key.

    Rows of a key are split by a hash of `order` into n_salts parts, ranked inside each part, and
    shifted by the sizes of the parts before it (n_salts numbers a key). `order` must be unique in a key.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(shift, [*keys, "_salt"]).withColumn(out, F.col("_in") + F.col("_shift")).drop("_salt", "_in", "_shift")
