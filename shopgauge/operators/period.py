"""Period filters and store figures over a period.

Frames of store figures ("kpis") have one row per period and store:
period, store_ord, store_id, store_name and the measures. All comparisons work within a
period, so they run for one period or for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shopgauge.config import ALL_PERIODS
from shopgauge.functions.expressions import mean, or_zero

STORE = ("store_ord", "store_id", "store_name")
MEASURES = ("revenue", "net_profit", "margin", "gross_profit", "goods", "personnel", "operating", "procurement",
            "full_costs")


def within_period():
    """Window over the stores of a period."""
    return W.partitionBy("period")


def in_period(df: DataFrame, period: str = ALL_PERIODS, column: str = "Monat") -> DataFrame:
    """Rows of one month (`YYYY-MM`), or all of them."""
    return df if period == ALL_PERIODS else df.where(F.col(column) == period)


def source_period(df: DataFrame, period: str = ALL_PERIODS, column: str = "ID_CALMONTH") -> DataFrame:
    """Facts of one month, as a date range that reaches the scan of the source."""
    if period == ALL_PERIODS:
        return df
    first = F.lit(f"{period}-01").cast("date")
    return df.where((F.col(column) >= first) & (F.col(column) < F.add_months(first, 1)))


def of_store(df: DataFrame, store: int | str, id_column: str = "IdStore", name_column: str = "Filialgruppe") -> DataFrame:
    """Rows of one store, by id or by a part of its name in any case."""
    if isinstance(store, int):
        return df.where(F.col(id_column) == store)
    return df.where(F.lower(F.col(name_column)).contains(store.lower()))


def _figures():
    # A sum of nothing is 0; a mean skips months without a margin.
    return [
        or_zero(F.sum("UmsatzEur")).alias("revenue"),
        or_zero(F.sum("NettogewinnEur")).alias("net_profit"),
        mean(F.col("NettogewinnMargeProzent")).alias("margin"),
        or_zero(F.sum("BruttogewinnEur")).alias("gross_profit"),
        or_zero(F.sum("PersonalkostenEur")).alias("personnel"),
        or_zero(F.sum("BetriebskostenEur")).alias("operating"),
        or_zero(F.sum("BeschaffungskostenEur")).alias("procurement"),
    ]


def _finish(sums: DataFrame, registry: DataFrame) -> DataFrame:
    stores = registry.select(
        F.col("id").alias("store_id"), F.col("ord").alias("store_ord"), F.col("name").alias("store_name")
    )
    goods = F.col("revenue") - F.col("gross_profit")
    return (
        sums.withColumnRenamed("IdStore", "store_id")
        .join(stores, "store_id")
        .withColumn("goods", goods)
        .withColumn("full_costs", goods + F.col("personnel") + F.col("operating") + F.col("procurement"))
        .select("period", *STORE, *MEASURES)
    )


def store_figures(export: DataFrame, registry: DataFrame, period: str) -> DataFrame:
    """Figures per registered store over an export that holds just the period."""
    sums = export.groupBy("IdStore").agg(*_figures())
    return _finish(sums.withColumn("period", F.lit(period)), registry)


def period_kpis(export: DataFrame, registry: DataFrame, period: str = ALL_PERIODS) -> DataFrame:
    """Figures per registered store over one month or over all months."""
    return store_figures(in_period(export, period), registry, period)


def period_kpis_all(export: DataFrame, registry: DataFrame) -> DataFrame:
    """Figures per registered store for every month and for all months, in one pass."""
    sums = export.groupingSets([["Monat", "IdStore"], ["IdStore"]], "Monat", "IdStore").agg(
        F.grouping("Monat").alias("over_all"), *_figures()
    )
    period = F.when(F.col("over_all") == 1, F.lit(ALL_PERIODS)).otherwise(F.col("Monat"))
    return _finish(sums.withColumn("period", period), registry)


def require_stores(kpis: DataFrame, minimum: int = 2) -> DataFrame:
    """Periods in which at least `minimum` stores are present; others give no rows.

    Counts from an aggregate would read the facts a second time, a window does not; its
    groups hold one row per registered store.
    """
    counted = kpis.withColumn("store_count", F.count("*").over(within_period()))
    return counted.where(F.col("store_count") >= minimum).drop("store_count")


def monthly_series(export: DataFrame, registry: DataFrame, column: str, name: str) -> DataFrame:
    """One measure per registered store and month."""
    sums = export.groupBy("IdStore", "Monat").agg(or_zero(F.sum(column)).alias(name))
    stores = registry.select(F.col("id").alias("IdStore"), F.col("name").alias("store_name"))
    return sums.join(stores, "IdStore").select(
        F.col("IdStore").alias("store_id"), "store_name", F.col("Monat").alias("period"), name
    )


def months(export: DataFrame, labels: DataFrame) -> DataFrame:
    """The periods to choose from: `all`, then every month present, each with its label."""
    present = export.select(F.col("Monat").alias("period")).distinct()
    everything = labels.where(F.col("period") == ALL_PERIODS).select("period")
    choices = everything.unionByName(present)
    labelled = with_month_label(choices, labels, "period")
    return labelled.orderBy(F.col("period") != ALL_PERIODS, "period")


def with_month_label(df: DataFrame, labels: DataFrame, column: str = "Monat") -> DataFrame:
    """Add the label of a month key; a key without one is its own label."""
    lookup = labels.select(F.col("period").alias(column), F.col("label").alias("known_label"))
    return (
        df.join(lookup, column, "left")
        .withColumn("month_label", F.coalesce(F.col("known_label"), F.col(column)))
        .drop("known_label")
    )


def active_stores(export: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered stores with data, in registry order."""
    present = export.select(F.col("IdStore").alias("id")).distinct()
    return registry.join(present, "id", "left_semi").select("ord", "id", "name", "short").orderBy("ord")


def detail(df: DataFrame, period: str = ALL_PERIODS, column: str = "Monat") -> DataFrame:
    """The full detail table of a view over a period."""
    return in_period(df, period, column)
