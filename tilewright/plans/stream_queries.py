"""Streaming queries, run to the end of what is there and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.ordered import scratch
from tilewright.plans import ledger_queries as Q
from tilewright.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    place = scratch(spark, "stream")
    write = lambda batch, n: batch.write.parquet(f"{place}/out/batch={n}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: a table may be one file or a folder


class _Streamed:
    """Hands streams instead of tables to a derivation that reads tables by name."""

    def __init__(self, spark: SparkSession) -> None:
        self.read, self._spark = self, spark

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        return _stream(self._spark, folder, name.removesuffix(".parquet"))


def stream_batch_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal to batch_fold for items that have an event of a known kind."""
    events = Q._item_events(_Streamed(spark), sf_dir)
    return folds.latest_items(_run(spark, folds.stream_items(events), "update")).drop("n_late")


def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _stream(spark, sf_dir, "orders")
    meter = F.concat(F.when(F.col("o_custkey") % 4 == 0, "iph").otherwise("dev"), F.col("o_custkey").cast("string"))
    spends = orders.select(meter.alias("meter"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderkey") % 5).cast("long").alias("n"))
    rows = _run(spark, folds.stream_meter(spends), "update")
    return rows.groupBy("meter", "month").agg(F.max("used").alias("used"), F.min("remaining").alias("remaining"))


def queries() -> dict[str, Query]:
    return {"stream_batch_fold": stream_batch_fold, "stream_meter": stream_meter}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_batch_fold": f"{Q._F} SELECT * FROM fi WHERE n_events > 0",
        "stream_meter": f"WITH {Q._SPEND_SQL} SELECT meter, month, used, CAST(greatest(lim - used, 0) AS BIGINT) AS remaining FROM u",
    }
