"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table in a folder. Every batch is reduced to one row per digest, joined by sort-merge with the
index, whose side needs no shuffle, and appended: digests that the index lacks with the id that stays, the others with
their number only, so that the index holds the size of every group over all batches.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.llm.shared import GAPS, stored, whole_text


#: Digests that a bucket should hold, and Spark's own limit on the number of buckets.
PER_BUCKET = 4_000_000
MOST_BUCKETS = 100_000


class DigestIndex:
    """The index in `folder`. It outlives the session: opening it again declares the same table over the same files.

    `expected` digests set the number of buckets when the index is created; the number is kept beside the files, so an
    index that is opened again has its own. `close` takes the table out of the catalog and leaves the files.
    """

    def __init__(self, spark: SparkSession, folder: str, expected: int = 0):
        self.spark = spark
        self.buckets = self._recorded(f"{folder}/_buckets", min(MOST_BUCKETS, max(48, -(-expected // PER_BUCKET))))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT, first BOOLEAN) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def _recorded(self, path: str, wanted: int) -> int:
        try:
            return self.spark.read.schema("buckets int").parquet(path).first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.parquet(path)
        return wanted

    def rows(self) -> DataFrame:
        """text_sha256, keep_id, group_size of every known digest, over all batches; buckets are grouped without a shuffle."""
        stays = F.max_by("keep_id", "first")
        return self.spark.table(self.table).groupBy("text_sha256").agg(stays.alias("keep_id"), F.sum("group_size").alias("group_size"))

    def append(self, groups: DataFrame) -> None:
        """Adds a batch: sort-merge anti-join for the digests that are new, one file per bucket and batch."""
        batch = groups.select("text_sha256", "keep_id", "group_size")
        known = self.rows().select("text_sha256").hint("merge")
        new = batch.join(known, "text_sha256", "left_anti").withColumn("first", F.lit(True))
        more = batch.join(known, "text_sha256", "left_semi").withColumns({"keep_id": F.lit(None).cast("bigint"), "first": F.lit(False)})
        added = stored(new.unionByName(more))  # the index must not be read while it is written
        added.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").write.insertInto(self.table)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the original text, and the digest of the text without white space. Null text is empty."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(text).alias("n_chars"),
        F.sha2(F.regexp_replace(text, GAPS, "").cast("binary"), 256).alias("text_sha256"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays (most code points, then smallest id; null only if no id is known), and the size."""
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    return rows.groupBy("text_sha256").agg(best["doc_id"].alias("keep_id"), F.count("*").alias("group_size"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Appends a batch to the index; one row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A document whose digest an earlier batch brought is dropped in favour of that batch's document. Empty texts are
    equal to each other. Rows repeated with the id that stays are all marked kept (they are the same document); a null
    id stays only if its group has no other of that length, and then is marked kept too. An empty batch changes nothing. Equal
    digests meet as one partially aggregated row; the join back is left to Spark's splitting of hot keys.
    """
    rows = stored(digests(docs))
    batch = stored(groups_of(rows))
    known = index.rows().select("text_sha256", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"), F.lit(True).alias("old"))
    decided = stored(batch.join(known.hint("merge"), "text_sha256", "left"))
    index.append(batch)
    decided = decided.select(
        "text_sha256",
        F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"),
        F.coalesce("old", F.lit(False)).alias("old"),
    )
    joined = rows.join(decided.hint("merge"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
