"""Category mix: totals, shares, best and worst categories.

A category frame has one row per category of the rule table, which bounds every window here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shopgauge.config import ALL_PERIODS
from shopgauge.functions.expressions import mean, or_zero
from shopgauge.operators.period import in_period

CATEGORY = "BenchmarkCategory"
STORE = ("IdStore", "StoreName")


def category_totals(agg: DataFrame, period: str = ALL_PERIODS) -> DataFrame:
    """Revenue and quantity per category over all stores; by default over all months."""
    return (
        in_period(agg, period, "IdCalmonthStd")
        .groupBy(CATEGORY)
        .agg(or_zero(F.sum("TotalRevenueEur")).alias("revenue"), or_zero(F.sum("TotalQuantity")).alias("quantity"))
        .select(F.lit(period).alias("period"), F.col(CATEGORY).alias("category"), "revenue", "quantity")
    )


def category_by_store(agg: DataFrame, column: str, name: str, fn: str = "sum", period: str = ALL_PERIODS) -> DataFrame:
    """One measure per store and category; `fn` is `sum` (of nothing: 0), or `mean` for a mean of monthly means."""
    value = mean(F.col(column)) if fn == "mean" else or_zero(F.sum(column))
    return (
        in_period(agg, period, "IdCalmonthStd")
        .groupBy(*STORE, CATEGORY)
        .agg(value.alias(name))
        .select(
            F.col("IdStore").alias("store_id"),
            F.col("StoreName").alias("store_name"),
            F.col(CATEGORY).alias("category"),
            name,
        )
    )


def category_share(agg: DataFrame, period: str = ALL_PERIODS) -> DataFrame:
    """Revenue of each category and its share in the revenue of the store."""
    sums = category_by_store(agg, "TotalRevenueEur", "revenue", period=period)
    of_store = F.sum("revenue").over(W.partitionBy("store_id", "store_name"))
    share = F.when(of_store > 0, F.col("revenue").cast("double") / of_store.cast("double"))
    return sums.withColumn("share", share)


def rank_categories(totals: DataFrame) -> DataFrame:
    """True rank by revenue, best first, ties by name."""
    order = W.partitionBy("period").orderBy(F.col("revenue").desc(), "category")
    return totals.withColumn("rank", F.row_number().over(order))


def top_k(totals: DataFrame, k: int = 3) -> DataFrame:
    """The k best categories by revenue."""
    return rank_categories(totals).where(F.col("rank") <= k).select("period", "rank", "category", "revenue")


def bottom_k(totals: DataFrame, k: int = 3) -> DataFrame:
    """The k worst categories by revenue with their true rank; may overlap with the best."""
    counted = rank_categories(totals).withColumn("n", F.count("*").over(W.partitionBy("period")))
    return counted.where(F.col("rank") > F.col("n") - k).select("period", "rank", "category", "revenue")


def best_worst(totals: DataFrame) -> DataFrame:
    """Best category with its revenue, and the worst; ties go to the first name."""
    return totals.groupBy("period").agg(
        F.min_by("category", F.struct(-F.col("revenue"), F.col("category"))).alias("best_category"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("category", F.struct(F.col("revenue"), F.col("category"))).alias("worst_category"),
    )
