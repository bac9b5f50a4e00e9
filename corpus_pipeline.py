"""A corpus pipeline of five stages: documents in, packed token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import Scratch, drop_tables, materialize
from tilewright.llm.exact_dedup import drop_exact_copies
from tilewright.llm.minhash import drop_near_copies
from tilewright.llm.mixing import drawn
from tilewright.llm.packing import pack
from tilewright.llm.quality_rules import drop_rejected
from tilewright.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8 or more)."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that the domains' tokens meet their target weights: as a whole, fewer; single ones may come twice."""
    return drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rate=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids; the columns of documents are not in them."""
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashed n-grams, a learned classifier and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that the stages leave; a stage's own tables go when its output is written, and its input's with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as made:
            docs = made.keep(materialize(stage(spark, docs, sf_dir), name))
        drop_tables(spark, before)
        before = sorted(made.kept)
    return STAGES[-1][1](spark, docs, sf_dir)
