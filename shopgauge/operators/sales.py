"""Standardised sales lines and their monthly totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.config import CategoryRules
from shopgauge.functions.expressions import CATEGORY, classified, gross_profit, money_mean, month_key, month_start

MEASURES = ("TotalRevenueEur", "TotalGrossProfitEur")


def where_stores(df: DataFrame, ids=None, column: str = "ID_STORE") -> DataFrame:
    """Keep the given stores: a list of ids, a DataFrame with a column `id`, or None for all."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(list(ids)))


def sales_lines(sales: DataFrame, rules: CategoryRules, store_ids=None) -> DataFrame:
    """Sales lines with category and gross profit; the month is still a date, no store name.

    Lines that come with a category keep it.
    """
    lines = where_stores(sales, store_ids)
    if CATEGORY not in lines.columns:
        lines = classified(lines, "ProduktBeschreibung", rules)
    return lines.select(
        month_start(F.col("ID_CALMONTH")).alias("MonthStart"),
        F.col("ID_STORE").alias("IdStore"),
        F.col("ID_MATERIAL").alias("IdMaterial"),
        F.col("ProduktBeschreibung").alias("MaterialDescription"),
        CATEGORY,
        F.col("RevenueEUR").alias("RevenueEur"),
        gross_profit(F.col("RevenueEUR"), F.col("TransferPriceEUR")).alias("GrossProfitEur"),
        F.col("TransferPriceEUR").alias("TransferCostEur"),
        F.col("SalesPriceEUR").alias("SalesPriceEur"),
        F.col("SalesAmount").alias("Quantity"),
    )


def with_store_name(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Inner join of the store master on the id. An id with several names gives a row for each, as a join per line would."""
    master = stores.select(F.col("SALESORG_ID").alias("IdStore"), F.col("STORE_LOCATION").alias("StoreName"))
    return df.join(master, "IdStore")


def published(df: DataFrame) -> DataFrame:
    """Replace the month start by its key `YYYY-MM`, as the first column.

    Done last: a join or filter on the formatted key would be pushed down to every fact row.
    """
    rest = [c for c in df.columns if c != "MonthStart"]
    return df.select(month_key(F.col("MonthStart")).alias("IdCalmonthStd"), *rest)


def sales_std(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Standardised sales lines, one row per line."""
    named = with_store_name(lines, stores).select(
        "MonthStart",
        "IdStore",
        "StoreName",
        "IdMaterial",
        "MaterialDescription",
        "BenchmarkCategory",
        "RevenueEur",
        "GrossProfitEur",
        "TransferCostEur",
        "SalesPriceEur",
        "Quantity",
    )
    return published(named)


def category_sums(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals per month start, store and category.

    Lines are aggregated before the store master is joined, so the fact side is shuffled
    once, as partial sums, however large the master is and however hot a store.
    """
    totals = lines.groupBy("MonthStart", "IdStore", "BenchmarkCategory").agg(
        F.sum("RevenueEur").alias("TotalRevenueEur"),
        F.sum("GrossProfitEur").alias("TotalGrossProfitEur"),
        F.sum("TransferCostEur").alias("TotalTransferCostEur"),
        money_mean(F.col("SalesPriceEur")).alias("AvgSalesPriceEur"),
        F.sum("Quantity").alias("TotalQuantity"),
    )
    return with_store_name(totals, stores).select(
        "MonthStart",
        "IdStore",
        "StoreName",
        "BenchmarkCategory",
        "TotalRevenueEur",
        "TotalGrossProfitEur",
        "TotalTransferCostEur",
        "AvgSalesPriceEur",
        "TotalQuantity",
    )


def sales_agg(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals per month, store and category."""
    return published(category_sums(lines, stores))


def store_totals(lines: DataFrame, stores: DataFrame) -> DataFrame:
    """Revenue and gross profit per month start and store.

    Equals `category_sums` summed over the categories, but needs no category, so neither the
    rules nor the descriptions are evaluated when only store figures are asked for.
    """
    totals = lines.groupBy("MonthStart", "IdStore").agg(
        F.sum("RevenueEur").alias("TotalRevenueEur"),
        F.sum("GrossProfitEur").alias("TotalGrossProfitEur"),
    )
    return with_store_name(totals, stores).select("MonthStart", "IdStore", "StoreName", *MEASURES)


def sum_categories(sums: DataFrame) -> DataFrame:
    """`store_totals` from category sums that are already there."""
    return sums.groupBy("MonthStart", "IdStore", "StoreName").agg(*[F.sum(m).alias(m) for m in MEASURES])


def rows_per_store(sales: DataFrame, store_ids) -> DataFrame:
    """Source check: number of sales rows of each given store."""
    return where_stores(sales, store_ids).groupBy("ID_STORE").agg(F.count("*").alias("row_count"))
