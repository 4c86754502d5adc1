"""Key figures per month and store, store groups, and the export views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.functions.expressions import month_key, pct, round2
from shopgauge.operators.costs import POSITIONS
from shopgauge.operators.sales import MEASURES, published

BASE = ("TotalRevenueEur", "TotalGrossProfitEur", "TotalCostsEur", "PersonnelCostsEur", "OperatingCostsEur")
RATIOS = ("GrossProfitMarginPct", "OperatingCostRatioPct", "PersonnelCostRatioPct", "NetProfitMarginPct")
KEYS = ("MonthStart", "IdStore")
COST_SET = ("TotalCostsEur", "PersonnelCostsEur", "OperatingCostsEur")
EXPORT_PERCENT = {
    "BruttogewinnMargeProzent": "GrossProfitMarginPct",
    "BetriebskostenQuoteProzent": "OperatingCostRatioPct",
    "PersonalkostenAnteilProzent": "PersonnelCostRatioPct",
    "NettogewinnMargeProzent": "NetProfitMarginPct",
}


def with_ratios(df: DataFrame) -> DataFrame:
    """The four ratios from summed amounts; not computable (no revenue, no costs) is NULL."""
    revenue, costs = F.col("TotalRevenueEur"), F.col("TotalCostsEur")
    return df.withColumns({
        "GrossProfitMarginPct": pct(F.col("TotalGrossProfitEur"), revenue),
        "OperatingCostRatioPct": pct(F.col("OperatingCostsEur"), revenue),
        "PersonnelCostRatioPct": pct(F.col("PersonnelCostsEur"), costs),
        "NetProfitMarginPct": pct(F.col("NetProfitEur"), revenue),
    })


def _with_cost_groups(totals: DataFrame, costs: DataFrame) -> DataFrame:
    """Store totals for each distinct set of cost sums of the month and store, with net profit and ratios.

    An inner join: a month with only one side is left out. Both sides are aggregates, so
    neither facts table is shuffled for it. The cost rows of a month and store, one per name
    spelling, come along in `spellings`; a set that n spellings share counts the sales n times.
    """
    rest = [c for c in costs.columns if c not in (*KEYS, "StoreName")]
    gathered = costs.groupBy(*KEYS).agg(F.collect_list(F.struct(*rest)).alias("spellings")).select(
        *[F.col(k).alias(f"cost_{k}") for k in KEYS], F.when(F.col("MonthStart").isNotNull(), F.col("spellings")).alias("spellings")
    )
    # Null-safe, as an equality would have every fact row's month computed once more for a null check at the scan;
    # a missing month has no spellings and so no rows.
    same = F.col("MonthStart").eqNullSafe(F.col("cost_MonthStart")) & (F.col("IdStore") == F.col("cost_IdStore"))
    sets = F.transform("spellings", lambda s: F.struct(*[s[c].alias(c) for c in COST_SET]))
    joined = totals.join(gathered, same).withColumn("sets", sets).withColumn("set", F.explode(F.array_distinct("sets")))
    times = F.size(F.filter("sets", lambda s: s.eqNullSafe(F.col("set"))))
    figures = joined.select(
        *KEYS,
        "StoreName",
        *[(F.col(m) * times).cast("decimal(38,4)").alias(m) for m in MEASURES],
        *[f"set.{c}" for c in COST_SET],
        "spellings",
    )
    return with_ratios(figures.withColumn("NetProfitEur", F.col("TotalGrossProfitEur") - F.col("TotalCostsEur")))


def kpi_wide(totals: DataFrame, costs: DataFrame) -> DataFrame:
    """Key figures joined with the costs of their month and store again, for the columns that they lack.

    That is a row for each set of cost sums and each spelling. The cost rows are at hand from
    the first join, so the costs are neither read nor joined a second time.
    """
    rest = [c for c in costs.columns if c not in (*KEYS, *COST_SET, "StoreName")]
    each = _with_cost_groups(totals, costs).withColumn("spelling", F.explode("spellings"))
    return each.select(*KEYS, "StoreName", *BASE, "NetProfitEur", *RATIOS, *[f"spelling.{c}" for c in rest])


def kpi(totals: DataFrame, costs: DataFrame) -> DataFrame:
    """Key figures per month and store.

    Should a store have several name spellings in the costs, there is one row per distinct
    set of cost sums, and spellings with equal sums share a row.
    """
    figures = _with_cost_groups(totals, costs)
    return published(figures.select(*KEYS, "StoreName", *BASE, "NetProfitEur", *RATIOS))


def sales_with_costs(sums: DataFrame, costs: DataFrame) -> DataFrame:
    """Category totals with the cost rows of their month and store: a row for each spelling."""
    return published(sums.join(costs.drop("StoreName"), list(KEYS)))


def compare_groups(kpis: DataFrame, groups: DataFrame) -> DataFrame:
    """Store groups per month: amounts summed over the members, ratios computed anew."""
    members = groups.select(F.col("id").alias("IdStore"), F.col("group").alias("StoreGroup"))
    summed = kpis.join(members, "IdStore").groupBy("IdCalmonthStd", "StoreGroup").agg(
        *[F.sum(c).alias(c) for c in (*BASE, "NetProfitEur")]
    )
    return with_ratios(summed)


def store_comparison(kpis: DataFrame, single: tuple, members: tuple) -> DataFrame:
    """One store as it is, and a fixed set of stores combined, below each other.

    `single` is `(id, label)`, `members` is `((id, ...), label)`. The figures are read once
    for both: the single store keeps its rows apart by the columns that identify them, the
    members share one group per month.
    """
    (store, label), (ids, combined) = single, members
    alone, together = F.col("IdStore") == store, F.col("IdStore").isin(list(ids))
    identity = F.struct("StoreName", "TotalCostsEur", "PersonnelCostsEur", "OperatingCostsEur")
    arms = F.array_compact(F.array(
        F.when(alone, F.struct(F.lit(label).alias("StoreGroup"), identity.alias("row"))),
        F.when(together, F.struct(F.lit(combined).alias("StoreGroup"), F.lit(None).alias("row"))),
    ))
    amounts = (*BASE, "NetProfitEur")
    summed = (
        kpis.where(alone | together)
        .select("IdCalmonthStd", *amounts, F.inline(arms))
        .groupBy("IdCalmonthStd", "StoreGroup", "row")
        .agg(*[F.sum(c).alias(c) for c in amounts])
    )
    return with_ratios(summed).select("IdCalmonthStd", "StoreGroup", *amounts, *RATIOS)


def _money2(name: str, alias: str):
    return round2(F.col(name)).alias(alias)


def _percents():
    # Rounds half up; a decimal keeps later sums and means independent of the row order.
    return [F.col(source).cast("decimal(38,2)").alias(name) for name, source in EXPORT_PERCENT.items()]


def export_v1(comparison: DataFrame) -> DataFrame:
    """Report columns of the group comparison; here `GesamtkostenEur` is the sum of all cost rows."""
    return comparison.select(
        F.col("IdCalmonthStd").alias("Monat"),
        F.col("StoreGroup").alias("Filialgruppe"),
        _money2("TotalRevenueEur", "UmsatzEur"),
        _money2("TotalGrossProfitEur", "BruttogewinnEur"),
        _money2("TotalCostsEur", "GesamtkostenEur"),
        _money2("PersonnelCostsEur", "PersonalkostenEur"),
        _money2("OperatingCostsEur", "BetriebskostenEur"),
        _money2("NetProfitEur", "NettogewinnEur"),
        *_percents(),
    )


def export_v2(kpis: DataFrame) -> DataFrame:
    """Report columns per store; here `GesamtkostenEur` is goods + operating + personnel + procurement."""
    goods = F.col("TotalRevenueEur") - F.col("TotalGrossProfitEur")
    full_costs = (
        goods + F.col("OperatingCostsEur") + F.col("PersonnelCostsEur") + F.col("AdditionalProcurementCostsEur")
    )
    return kpis.select(
        month_key(F.col("MonthStart")).alias("Monat"),
        F.col("StoreName").alias("Filialgruppe"),
        "IdStore",
        _money2("TotalRevenueEur", "UmsatzEur"),
        _money2("TotalGrossProfitEur", "BruttogewinnEur"),
        round2(goods).alias("WareneinsatzEur"),
        round2(full_costs).alias("GesamtkostenEur"),
        _money2("PersonnelCostsEur", "PersonalkostenEur"),
        _money2("OperatingCostsEur", "BetriebskostenEur"),
        _money2("AdditionalProcurementCostsEur", "BeschaffungskostenEur"),
        _money2("NetProfitEur", "NettogewinnEur"),
        *_percents(),
    )


def waterfall_view(kpis: DataFrame) -> DataFrame:
    """Unrounded steps from revenue to net profit per month and store.

    Personnel may already include commission, which is also shown on its own: do not add up
    the bars; `profit_bridge` has steps that can be added.
    """
    return published(kpis.select(
        *KEYS,
        "StoreName",
        F.col("TotalRevenueEur").alias("UmsatzEur"),
        (F.col("TotalRevenueEur") - F.col("TotalGrossProfitEur")).alias("WareneinsatzEur"),
        F.col("TotalGrossProfitEur").alias("BruttogewinnEur"),
        F.col("PersonnelCostsEur").alias("PersonalkostenEur"),
        *POSITIONS,
        F.col("AdditionalProcurementCostsEur").alias("BeschaffungskostenEur"),
        F.col("NetProfitEur").alias("NettogewinnEur"),
    ))
