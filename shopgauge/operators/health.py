"""Health of the sources: what the figures would silently leave out, multiply or misplace.

Every finding comes from one chain of aggregates over partial sums, so each fact table is scanned once, for all findings
together. The counts are exact; metrics observed beside a scan would count the rows of tasks that run twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgauge.config import CostBuckets
from shopgauge.functions.expressions import in_bucket, month_start
from shopgauge.operators.sales import where_stores

#: Findings about facts, in the order of the report: (source, finding, sum over stores).
SALES_FINDINGS = ("rows", "without_month", "without_store", "unknown_store", "without_amount", "months_without_costs")
COSTS_FINDINGS = ("rows", "without_month", "without_store", "unknown_store", "without_amount", "months_without_sales", "in_no_bucket", "several_spellings")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _flag(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _sales_by_month(sales: DataFrame) -> DataFrame:
    """Rows per month and store, those without an amount apart."""
    missing = F.col("RevenueEUR").isNull() | F.col("TransferPriceEUR").isNull()
    return sales.groupBy(month_start(F.col("ID_CALMONTH")).alias("month"), F.col("ID_STORE").alias("store")).agg(
        F.count("*").alias("n"), _rows(missing).alias("missing")
    )


def _costs_by_month(costs: DataFrame, buckets: CostBuckets) -> DataFrame:
    """Rows per month and store, those without an amount or in no bucket apart, and the least and greatest spelling."""
    category = F.col("Kostenkategorie")
    used = [in_bucket(category, b, buckets.case_sensitive) for b in (buckets.personnel, buckets.operating, buckets.procurement)]
    return costs.groupBy(month_start(F.col("ID_CALMONTH")).alias("month"), F.col("ID_STORE").alias("store")).agg(
        F.count("*").alias("n"),
        _rows(F.col("WertEUR").isNull()).alias("missing"),
        _rows(~reduce(Column.__or__, used)).alias("unmapped"),
        F.min("StoreName").alias("first_name"),
        F.max("StoreName").alias("last_name"),
    )


def _rows(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _facts(sales: DataFrame, costs: DataFrame, stores: DataFrame, buckets: CostBuckets) -> DataFrame:
    nothing = {"unmapped": F.lit(0).cast("bigint"), "first_name": F.lit(None).cast("string"), "last_name": F.lit(None).cast("string")}
    sides = _sales_by_month(sales).withColumns({"side": F.lit("sales"), **nothing}).unionByName(
        _costs_by_month(costs, buckets).withColumn("side", F.lit("costs"))
    )
    sold, paid = F.col("side") == "sales", F.col("side") == "costs"

    def per(side: Column, value: str) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col(value))), F.lit(0))

    months = sides.groupBy("month", "store").agg(
        per(sold, "n").alias("sales_n"), per(paid, "n").alias("costs_n"),
        per(sold, "missing").alias("sales_missing"), per(paid, "missing").alias("costs_missing"),
        per(paid, "unmapped").alias("unmapped"), F.min("first_name").alias("first_name"), F.max("last_name").alias("last_name"),
    )
    dated = F.col("month").isNotNull() & F.col("store").isNotNull()
    sums = {c: F.sum(c).alias(c) for c in ("sales_n", "costs_n", "sales_missing", "costs_missing", "unmapped")}
    by_store = months.groupBy("store").agg(
        *sums.values(),
        *[F.sum(F.when(F.col("month").isNull(), F.col(f"{s}_n")).otherwise(0)).alias(f"{s}_undated") for s in ("sales", "costs")],
        _flag(dated & (F.col("sales_n") > 0) & (F.col("costs_n") == 0)).alias("sales_alone"),
        _flag(dated & (F.col("costs_n") > 0) & (F.col("sales_n") == 0)).alias("costs_alone"),
        F.min("first_name").alias("first_name"), F.max("last_name").alias("last_name"),
    )
    known = stores.select(F.col("SALESORG_ID").alias("store")).distinct().withColumn("known", F.lit(True))
    rows = by_store.join(known, "store", "left")
    unknown = F.col("known").isNull() & F.col("store").isNotNull()
    total = rows.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in {
        **{f"{s}_rows": F.sum(f"{s}_n") for s in ("sales", "costs")},
        **{f"{s}_without_month": F.sum(f"{s}_undated") for s in ("sales", "costs")},
        **{f"{s}_without_store": F.sum(F.when(F.col("store").isNull(), F.col(f"{s}_n"))) for s in ("sales", "costs")},
        **{f"{s}_unknown_store": F.sum(F.when(unknown, F.col(f"{s}_n"))) for s in ("sales", "costs")},
        **{f"{s}_without_amount": F.sum(f"{s}_missing") for s in ("sales", "costs")},
        "sales_months_without_costs": F.sum("sales_alone"),
        "costs_months_without_sales": F.sum("costs_alone"),
        "costs_in_no_bucket": F.sum("unmapped"),
        "costs_several_spellings": F.sum(F.when(F.col("store").isNotNull() & (F.col("first_name") < F.col("last_name")), 1)),
    }.items()])
    lines = [(s, f) for s, found in (("sales", SALES_FINDINGS), ("costs", COSTS_FINDINGS)) for f in found]
    return total.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(f).alias("finding"), F.col(f"{s}_{f}").alias("n")) for s, f in lines
    ])))


def _master(source: str, rows: DataFrame, key: str) -> DataFrame:
    """Ids of a master table, those with several rows, and rows without an id."""
    ids = rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    total = ids.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in {
        "rows": F.sum("n"),
        "repeated_ids": F.sum(F.when(F.col("id").isNotNull() & (F.col("n") > 1), 1)),
        "without_id": _count(F.col("id").isNull()),
    }.items()])
    return total.select(F.inline(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(f).alias("finding"), F.col(f).alias("n")) for f in ("rows", "repeated_ids", "without_id")
    ])))


def source_health(sales: DataFrame, costs: DataFrame, stores: DataFrame, locations: DataFrame, buckets: CostBuckets, store_ids=None) -> DataFrame:
    """What to know about the sources before trusting the figures: (source, finding, n).

    Facts: rows; rows without a month, a store or an amount; rows of stores that the master does
    not know; months of a store that only one side has, which the key figures leave out; cost
    rows in no bucket; stores with several spellings in the costs, which multiply their rows.
    Masters: rows, repeated ids, rows without an id. A finding without cases has 0.
    """
    facts = _facts(where_stores(sales, store_ids), where_stores(costs, store_ids), stores, buckets)
    masters = _master("salesorg", stores, "SALESORG_ID").unionByName(_master("location", locations, "ID_STORE"))
    return facts.unionByName(masters)
