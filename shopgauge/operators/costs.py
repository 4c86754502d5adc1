"""Monthly cost totals, cost buckets and single cost positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shopgauge.config import ALL_PERIODS, COMMISSION, MARKETING, RENT, CostBuckets
from shopgauge.functions.expressions import in_bucket, month_start, or_zero
from shopgauge.operators.period import source_period
from shopgauge.operators.sales import published, where_stores

BUCKET_COLUMNS = ("PersonnelCostsEur", "OperatingCostsEur", "AdditionalProcurementCostsEur")
COST_COLUMNS = ("TotalCostsEur", *BUCKET_COLUMNS)
POSITIONS = {"MieteEur": RENT, "MarketingEur": MARKETING, "KommissionEur": COMMISSION}


def _bucket_sums(buckets: CostBuckets) -> list[Column]:
    parts = zip(BUCKET_COLUMNS, (buckets.personnel, buckets.operating, buckets.procurement))
    category, value = F.col("Kostenkategorie"), F.col("WertEUR")
    return [
        F.sum(F.when(in_bucket(category, bucket, buckets.case_sensitive), value).otherwise(F.lit(0))).alias(name)
        for name, bucket in parts
    ]


def _position_sums(positions: dict[str, str], case_sensitive: bool) -> list[Column]:
    category = F.col("Kostenkategorie") if case_sensitive else F.lower("Kostenkategorie")
    return [
        F.sum(F.when(category == (wanted if case_sensitive else wanted.lower()), F.col("WertEUR"))).alias(name)
        for name, wanted in positions.items()
    ]


def by_month_store(costs: DataFrame, store_ids=None) -> DataFrame:
    """Cost rows with the month start; rows that come with one keep it, so that its layout stays of use."""
    if "MonthStart" in costs.columns:
        return where_stores(costs, store_ids, "IdStore").select("MonthStart", "IdStore", "StoreName", "Kostenkategorie", "WertEUR")
    return where_stores(costs, store_ids).select(
        month_start(F.col("ID_CALMONTH")).alias("MonthStart"),
        F.col("ID_STORE").alias("IdStore"),
        "StoreName",
        "Kostenkategorie",
        "WertEUR",
    )


def cost_sums(costs: DataFrame, buckets: CostBuckets, store_ids=None) -> DataFrame:
    """Per month start, store and store name: total and the three buckets.

    Rows in no bucket count in the total only.
    """
    return by_month_store(costs, store_ids).groupBy("MonthStart", "IdStore", "StoreName").agg(
        F.sum("WertEUR").alias("TotalCostsEur"), *_bucket_sums(buckets)
    )


def costs_agg(costs: DataFrame, buckets: CostBuckets, store_ids=None) -> DataFrame:
    """Per month, store and store name: total and the three buckets."""
    return published(cost_sums(costs, buckets, store_ids))


def cost_sums_wide(costs: DataFrame, buckets: CostBuckets, store_ids=None, positions=POSITIONS) -> DataFrame:
    """`cost_sums` plus single positions, from one scan and one pass of conditional sums.

    Positions belong to the month and store whatever spelling the store name has, so they
    are added up over the name; a missing position is 0.
    """
    totals = by_month_store(costs, store_ids).groupBy("MonthStart", "IdStore", "StoreName").agg(
        F.sum("WertEUR").alias("TotalCostsEur"),
        *_bucket_sums(buckets),
        *_position_sums(positions, buckets.case_sensitive),
    )
    month_store = W.partitionBy("MonthStart", "IdStore")
    return totals.withColumns({name: or_zero(F.sum(name).over(month_store)) for name in positions})


def detail_sums(costs: DataFrame, store_ids=None) -> DataFrame:
    """Per month start, store, store name and cost category: sum."""
    sums = by_month_store(costs, store_ids).groupBy("MonthStart", "IdStore", "StoreName", "Kostenkategorie")
    return sums.agg(F.sum("WertEUR").alias("KostenEur"))


def as_costs(details: DataFrame) -> DataFrame:
    """Detail sums in the form of a cost source: their totals are those of the costs."""
    return details.select("MonthStart", "IdStore", "StoreName", "Kostenkategorie", F.col("KostenEur").alias("WertEUR"))


def costs_detail(costs: DataFrame, store_ids=None) -> DataFrame:
    """Per month, store, store name and cost category: sum."""
    return published(detail_sums(costs, store_ids))


def cost_lookup(
    keys: DataFrame,
    costs: DataFrame,
    positions=POSITIONS,
    case_sensitive: bool = False,
    store_ids=None,
    period: str = ALL_PERIODS,
) -> DataFrame:
    """Add single cost positions to rows keyed by month start and store, 0 where there are none.

    One conditional aggregate and one left join stand for a scalar subquery per position.
    Give the stores and the month that `keys` is about: they are filtered at the scan.
    """
    found = by_month_store(source_period(costs, period, "MonthStart" if "MonthStart" in costs.columns else "ID_CALMONTH"), store_ids).groupBy("MonthStart", "IdStore").agg(
        *_position_sums(positions, case_sensitive)
    )
    joined = keys.join(found, ["MonthStart", "IdStore"], "left")
    return joined.withColumns({name: or_zero(F.col(name)) for name in positions})
