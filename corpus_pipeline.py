"""From documents to shards: quality, near copies, benchmark passages, mixing, sharding. Each stage is written and read again.

Every stage takes all rows that the one before kept and returns them with the columns of documents; the last one adds
the place of each row. Rows that agree in every column are interchangeable, so stages refer to rows by a hash of all
columns. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.llm import decontaminate, hilbert, mixing, neardup, quality
from shopgauge.llm.shared import KEYS, row_keys, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", *row_keys(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a null text is judged as an empty one."""
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; all documents without words."""
    found = neardup.near_duplicates(docs)
    lone = found.where("root is null").select(*KEYS)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *KEYS)).alias("first")
    chosen = found.where("root is not null and kept").groupBy("root").agg(first).select(*(f"first.{k}" for k in KEYS))
    return _keyed(docs).join(chosen.union(lone).distinct(), KEYS).dropDuplicates(KEYS).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(found.select(*KEYS).distinct(), KEYS, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.mix(docs).select(*KEYS, (F.col("copies") * F.col("rows")).alias("_copies")).where("_copies > 0")
    taken = _keyed(docs).dropDuplicates(KEYS).join(copies, KEYS)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, curve index, shard and slot."""
    placed = hilbert.shard(docs).select(*KEYS, "size", "curve", "shard", "slot")
    own = [c for c in docs.columns if c.lower() not in ("size", "curve", "shard", "slot")]
    return _keyed(docs).dropDuplicates(KEYS).select(*own, *KEYS).join(placed, KEYS).drop(*KEYS)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier and the similarity search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
