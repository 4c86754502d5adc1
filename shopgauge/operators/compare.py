"""Rankings, leaders, scores and bridges between the stores of a period.

Every function takes store figures as `period_kpis` gives them. A period holds one row per
registered store, so a window over a period is small, and periods are spread over tasks.
Ties go to the store that is registered first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgauge import config
from shopgauge.functions.expressions import banded, mean_over, pct
from shopgauge.functions.formats import fixed, fmt_eur, fmt_pct
from shopgauge.operators.location import with_size
from shopgauge.operators.period import within_period

SCORE_DIGITS = 6
#: Places of the decimals that are added up for means.
EXACT_DIGITS = 12


def rank_stores(kpis: DataFrame, measure: str = "net_profit") -> DataFrame:
    """Stores by a measure, best first; `lead` is the distance of the winner to the second."""
    order = within_period().orderBy(F.col(measure).desc(), "store_ord")
    second = F.lead(measure).over(order)
    gap = F.coalesce(F.col(measure) - second, F.lit(0))
    return kpis.select(
        "period",
        F.row_number().over(order).alias("rank"),
        "store_id",
        "store_name",
        measure,
        gap.alias("gap"),
    ).select(
        "period", "rank", "store_id", "store_name", measure, F.when(F.col("rank") == 1, F.col("gap")).alias("lead")
    )


def _first(column: str, measure: str, largest: bool = True) -> Column:
    """Value of `column` at the extreme of a measure, the first registered store on ties."""
    if largest:
        return F.max_by(column, F.struct(F.col(measure), -F.col("store_ord")))
    return F.min_by(column, F.struct(F.col(measure), F.col("store_ord")))


def leader(kpis: DataFrame, measure: str) -> DataFrame:
    """The store with the highest value of a measure."""
    return kpis.groupBy("period").agg(
        _first("store_id", measure).alias("store_id"),
        _first("store_name", measure).alias("store_name"),
        F.max(measure).alias(measure),
    )


def leader_vs_mean(kpis: DataFrame, measure: str = "revenue") -> DataFrame:
    """The leader and by how many percent it lies above the mean of all stores."""
    best = F.max(measure)
    average = F.sum(measure).cast("double") / F.count("*")
    above = F.when(average > 0, (best.cast("double") / average - 1) * 100).otherwise(F.lit(0.0))
    return kpis.groupBy("period").agg(
        _first("store_id", measure).alias("store_id"),
        _first("store_name", measure).alias("store_name"),
        best.alias(measure),
        above.alias("pct_above_mean"),
    )


def insights(kpis: DataFrame) -> DataFrame:
    """The leaders in words: one headline, notes on revenue and margin, a recommendation."""
    found = kpis.groupBy("period").agg(
        _first("store_name", "revenue").alias("revenue_leader"),
        _first("store_name", "margin").alias("margin_leader"),
        _first("store_name", "net_profit").alias("profit_leader"),
        F.max("revenue").cast("double").alias("best_revenue"),
        (F.sum("revenue").cast("double") / F.count("*")).alias("mean_revenue"),
        F.max("margin").alias("best_margin"),
    )
    revenue, margin, profit = F.col("revenue_leader"), F.col("margin_leader"), F.col("profit_leader")
    above = F.when(
        F.col("mean_revenue") > 0, (F.col("best_revenue") / F.col("mean_revenue") - 1) * 100
    ).otherwise(F.lit(0.0))
    headline = F.concat_ws(
        " | ",
        F.when(margin == profit, F.format_string(config.TEXT_MARGIN_AND_PROFIT, profit))
        .otherwise(F.format_string(config.TEXT_TOP_PROFIT, profit)),
        F.when(margin != profit, F.format_string(config.TEXT_TOP_MARGIN, margin)),
        F.when(revenue != profit, F.format_string(config.TEXT_TOP_REVENUE, revenue)),
    )
    return found.select(
        "period",
        "revenue_leader",
        "margin_leader",
        "profit_leader",
        headline.alias("headline"),
        F.format_string(config.TEXT_REVENUE_LEADER, revenue, fixed(above, 1)).alias("revenue_note"),
        F.when(
            F.col("best_margin").isNotNull(),
            F.format_string(config.TEXT_MARGIN_LEADER, margin, fixed(F.col("best_margin"), 1)),
        ).alias("margin_note"),
        F.format_string(config.TEXT_RECOMMENDATION, profit).alias("recommendation"),
    )


def scorecard(
    kpis: DataFrame,
    locations: DataFrame,
    bands=config.SCORE_BANDS,
    lowest: str = config.SCORE_LOWEST,
) -> DataFrame:
    """Profit and revenue per m² and margin, each relative to the mean of the stores (= 100).

    Values are rounded to decimals before they are added up, so means do not depend on the
    order of rows, and the bands are those of the rounded scores that are shown.
    """
    size, exact = F.col("size_m2"), f"decimal(38,{EXACT_DIGITS})"
    sized = with_size(kpis, locations)

    def per_m2(column):
        return F.when(size > 0, F.col(column).cast("double") / size.cast("double")).otherwise(F.lit(0.0))

    values = {"margin": F.col("margin"), "profit_per_m2": per_m2("net_profit"), "revenue_per_m2": per_m2("revenue")}
    result = sized.select(
        "period", "store_id", "store_name", size, *[v.cast(exact).alias(n) for n, v in values.items()]
    )
    for source, name in (("profit_per_m2", "profit"), ("revenue_per_m2", "revenue"), ("margin", "margin")):
        average = mean_over(F.col(source), within_period())
        result = result.withColumn(f"{name}_score", F.round(pct(F.col(source), average, 0.0), SCORE_DIGITS))
    for name in ("profit", "revenue", "margin"):
        score = F.col(f"{name}_score")
        result = result.withColumn(f"{name}_band", banded(score, bands, lowest, at_least=True))
    return result.withColumns({n: F.round(n, SCORE_DIGITS).cast("double") for n in values})


def radar(kpis: DataFrame, margin_factor: int = config.RADAR_MARGIN_FACTOR) -> DataFrame:
    """Revenue, net and gross profit in percent of the best store, and the margin times a factor."""

    def of_best(measure):
        return pct(F.col(measure), F.max(measure).over(within_period()), 0.0)

    axes = kpis.select(
        "period",
        "store_id",
        "store_name",
        of_best("revenue").alias("Umsatz"),
        of_best("net_profit").alias("Nettogewinn"),
        (F.col("margin") * margin_factor).alias("Marge"),
        of_best("gross_profit").alias("Bruttogewinn"),
    )
    return axes.unpivot(
        ["period", "store_id", "store_name"], ["Umsatz", "Nettogewinn", "Marge", "Bruttogewinn"], "axis", "value"
    )


def cost_extremes(kpis: DataFrame) -> DataFrame:
    """The stores with the lowest and the highest full costs, and the difference."""
    return kpis.groupBy("period").agg(
        _first("store_name", "full_costs", largest=False).alias("cheapest_store"),
        F.min("full_costs").alias("lowest_costs"),
        _first("store_name", "full_costs").alias("dearest_store"),
        F.max("full_costs").alias("highest_costs"),
        (F.max("full_costs") - F.min("full_costs")).alias("difference"),
    )


def cost_rank(kpis: DataFrame) -> DataFrame:
    """Stores by full costs, cheapest first; a medal for the first three, else `#n`."""
    rank = F.row_number().over(within_period().orderBy("full_costs", "store_ord"))
    medal = F.element_at(F.array(*map(F.lit, config.MEDALS)), F.col("rank"))
    label = F.when(F.col("rank") <= len(config.MEDALS), medal).otherwise(F.concat(F.lit("#"), F.col("rank")))
    return kpis.select("period", "store_id", "store_name", "full_costs", rank.alias("rank")).withColumn("medal", label)


def cost_efficiency(
    kpis: DataFrame, bands=config.EFFICIENCY_BANDS, worst: str = config.EFFICIENCY_WORST
) -> DataFrame:
    """Full costs in percent of revenue, with a band; 0 without revenue."""
    return kpis.select(
        "period",
        "store_id",
        "store_name",
        pct(F.col("full_costs"), F.col("revenue"), 0.0).alias("cost_ratio"),
    ).withColumn("band", banded(F.col("cost_ratio"), bands, worst, at_least=False))


def margin_compare(kpis: DataFrame) -> DataFrame:
    """Margin per store with its label."""
    return kpis.select("period", "store_id", "store_name", "margin", fmt_pct(F.col("margin")).alias("label"))


def cost_structure(kpis: DataFrame) -> DataFrame:
    """The four cost parts of each store, one row per part."""
    parts = kpis.select(
        "period",
        "store_id",
        "store_name",
        F.col("goods").alias("Wareneinsatz"),
        F.col("personnel").alias("Personalkosten"),
        F.col("operating").alias("Betriebskosten"),
        F.col("procurement").alias("Beschaffung"),
    )
    names = ["Wareneinsatz", "Personalkosten", "Betriebskosten", "Beschaffung"]
    return parts.unpivot(["period", "store_id", "store_name"], names, "part", "amount")


def profit_bridge(kpis: DataFrame) -> DataFrame:
    """Steps from revenue to net profit with the running total, one row per step.

    All steps of a store come from one row, so the running totals are plain sums. `residual`
    is what net profit lacks after the four deductions: costs that are in no bucket.
    """
    steps = [
        ("Umsatz", "absolute", F.col("revenue")),
        ("Wareneinsatz", "relative", -F.col("goods")),
        ("Personal", "relative", -F.col("personnel")),
        ("Betrieb", "relative", -F.col("operating")),
        ("Beschaffung", "relative", -F.col("procurement")),
    ]
    wide = "decimal(38,2)"
    rows, total = [], F.lit(0).cast(wide)
    for number, (label, kind, amount) in enumerate(steps, start=1):
        total = total + amount.cast(wide)
        rows.append((number, label, kind, amount, total))
    rows.append((len(steps) + 1, "Nettogewinn", "total", F.col("net_profit"), total))
    structs = [
        F.struct(
            F.lit(number).alias("step"),
            F.lit(label).alias("label"),
            F.lit(kind).alias("kind"),
            amount.cast(wide).alias("amount"),
            running.cast(wide).alias("running_total"),
        )
        for number, label, kind, amount, running in rows
    ]
    residual = F.col("net_profit").cast(wide) - total
    return (
        kpis.select("period", "store_id", "store_name", F.inline(F.array(*structs)), residual.alias("residual"))
        .withColumn("text", fmt_eur(F.col("amount")))
    )
