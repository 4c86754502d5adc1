"""Folder and tables that all executors share, and the order-preserving running sum built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls tab to carriage return.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir.

    Where that is unset, one is set for the session: a temporary folder where driver and tasks share a machine, as in
    tests, and on a cluster a folder in the warehouse, which all executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        one_machine = master.startswith("local") and not master.startswith("local-cluster")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}" if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text() -> Column:
    """The text column, an empty text for null."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


#: Two hashes that stand for a whole row; rows that agree in both are interchangeable.
KEYS = ["_row_key_a", "_row_key_b"]


def row_keys(docs: DataFrame) -> list[Column]:
    """The columns KEYS: 128 bits over all columns but maps, which have no hash."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return [F.xxhash64(*columns).alias(KEYS[0]), F.xxhash64(F.lit(1), *reversed(columns)).alias(KEYS[1])]


def id_remainder(divisor: int) -> Column:
    """crc32 of the id's text modulo `divisor`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def running_total(df: DataFrame, value: str, within: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the running sum of `value` (own row included) per `within`, in the total order `order`."""
    return running_totals(df, {out: value}, within, order)


def running_totals(df: DataFrame, values: dict[str, str], within: list[str], order: list[str]) -> DataFrame:
    """Adds running sums (own row included) per `within`, in the total order `order`: {new column: summed column}.

    The rows are range-sorted and stored with the number of their range. What precedes a range is a sum over one row
    per range and group, so no group is ever gathered in one task; ties in `order` must be identical rows.
    """
    ranged = stored(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*within, "_range").agg(*(F.sum(value).alias(f"_sum_{out}") for out, value in values.items()))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in values]
    sums = sums.select(*(F.col(c).alias(f"_{c}") for c in within), F.col("_range").alias("_of"), *ahead)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    # one row per range and group that touches it: never more than ranges plus groups
    joined = ranged.join(sums, [F.col("_range") == F.col("_of"), *same])
    inside = Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = {out: F.col(f"_before_{out}") + F.sum(value).over(inside) for out, value in values.items()}
    return joined.withColumns(totals).drop("_range", "_of", *(f"_before_{out}" for out in values), *(f"_{c}" for c in within))
