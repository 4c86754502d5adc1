"""The layers of one comparison, put together from its sources."""

from __future__ import annotations

from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.config import ALL_PERIODS, MEMBER_STORES, PRESET_V2, SINGLE_STORE, Preset
from shopgauge.functions.expressions import month_key
from shopgauge.operators import category, costs as cost_ops, kpi as kpi_ops, period as period_ops, sales as sales_ops
from shopgauge.plans.monthly import MonthlySums

#: What `stored` keeps: sums per month start.
STORED = ("category_sums", "detail_sums")


class Sources(Protocol):
    """The four source tables and the store registry, each a DataFrame."""

    sales: DataFrame
    costs: DataFrame
    stores: DataFrame
    locations: DataFrame
    registry: DataFrame


class Benchmark:
    """Lazy layers over the sources; each attribute is a DataFrame, nothing runs until it is used.

    With a `period` only the facts of that month are read, by a range filter at the scan.
    """

    def __init__(self, sources: Sources, preset: Preset = PRESET_V2, period: str = ALL_PERIODS):
        self.sources = sources
        self.preset = preset
        self.period = period

    @cached_property
    def _costs(self) -> DataFrame:
        costs = self.sources.costs
        return period_ops.source_period(costs, self.period, "MonthStart" if "MonthStart" in costs.columns else "ID_CALMONTH")

    @cached_property
    def lines(self) -> DataFrame:
        laid_out = getattr(self.sources, "lines", None)  # sources that keep classified lines
        if laid_out is not None:
            return sales_ops.where_stores(period_ops.source_period(laid_out, self.period, "MonthStart"), self.preset.store_ids, "IdStore")
        by_part = getattr(self.sources, "classified_sales", None)  # sources that know descriptions from a dimension
        sales = by_part(self.preset.rules) if by_part else self.sources.sales
        sales = period_ops.source_period(sales, self.period)
        return sales_ops.sales_lines(sales, self.preset.rules, self.preset.store_ids)

    @cached_property
    def sales_std(self) -> DataFrame:
        return sales_ops.sales_std(self.lines, self.sources.stores)

    @cached_property
    def category_sums(self) -> DataFrame:
        return sales_ops.category_sums(self.lines, self.sources.stores)

    @cached_property
    def sales_agg(self) -> DataFrame:
        return sales_ops.published(self.category_sums)

    @cached_property
    def store_totals(self) -> DataFrame:
        return sales_ops.store_totals(self.lines, self.sources.stores)

    @cached_property
    def cost_sums(self) -> DataFrame:
        return cost_ops.cost_sums(self._costs, self.preset.buckets, self.preset.store_ids)

    @cached_property
    def cost_sums_wide(self) -> DataFrame:
        return cost_ops.cost_sums_wide(self._costs, self.preset.buckets, self.preset.store_ids)

    @cached_property
    def costs_agg(self) -> DataFrame:
        return sales_ops.published(self.cost_sums)

    @cached_property
    def costs_detail(self) -> DataFrame:
        return cost_ops.costs_detail(self._costs, self.preset.store_ids)

    @cached_property
    def kpi(self) -> DataFrame:
        return kpi_ops.kpi(self.store_totals, self.cost_sums)

    def store_comparison(self, single=SINGLE_STORE, members=MEMBER_STORES) -> DataFrame:
        return kpi_ops.store_comparison(self.kpi, single, members)

    def export_v1(self, single=SINGLE_STORE, members=MEMBER_STORES) -> DataFrame:
        return kpi_ops.export_v1(self.store_comparison(single, members))

    @cached_property
    def export_v2(self) -> DataFrame:
        return kpi_ops.export_v2(kpi_ops.kpi_wide(self.store_totals, self.cost_sums))

    @cached_property
    def waterfall(self) -> DataFrame:
        return kpi_ops.waterfall_view(kpi_ops.kpi_wide(self.store_totals, self.cost_sums_wide))

    @cached_property
    def period_kpis(self) -> DataFrame:
        """Store figures over the period of this benchmark."""
        return period_ops.store_figures(self.export_v2, self.sources.registry, self.period)

    @cached_property
    def period_kpis_all(self) -> DataFrame:
        """Store figures for each month and for all of them."""
        return period_ops.period_kpis_all(self.export_v2, self.sources.registry)

    @cached_property
    def category_totals(self) -> DataFrame:
        return category.category_totals(self.sales_agg, self.period)

    @cached_property
    def detail_sums(self) -> DataFrame:
        return cost_ops.detail_sums(self._costs, self.preset.store_ids)

    @cached_property
    def available(self) -> DataFrame:
        """Months and stores (Monat, IdStore) that have both sales and costs, and so an export row."""
        return self.export_v2.select("Monat", "IdStore")

    def stored(self, folder: str) -> Benchmark:
        """Bring the monthly sums in a shared folder up to date and go on from there.

        The facts are then scanned once for any number of figures, instead of once per
        figure. The sums have a row per month, store and category, whatever the facts hold,
        and, being files in folders by month, they outlive lost executors. Stored again, only
        months whose sums have changed are written, and months without rows vanish. A benchmark
        of one period reads, writes or removes that month only.
        """
        MonthlySums(self._spark, folder).refresh({name: getattr(self, name) for name in STORED}, self.period)
        return self.opened(folder)

    @property
    def _spark(self) -> SparkSession:
        return self.sources.sales.sparkSession

    def opened(self, folder: str) -> Benchmark:
        """Go on from sums that `stored` has written, without writing or reading the facts again."""
        copy = Benchmark(self.sources, self.preset, self.period)
        kept = MonthlySums(self._spark, folder)
        for name in STORED:
            setattr(copy, name, kept.table(name, getattr(self, name).schema, self.period))
        costs = cost_ops.as_costs(copy.detail_sums)
        copy.store_totals = sales_ops.sum_categories(copy.category_sums)
        copy.cost_sums = cost_ops.cost_sums(costs, self.preset.buckets)
        copy.cost_sums_wide = cost_ops.cost_sums_wide(costs, self.preset.buckets)
        copy.costs_detail = sales_ops.published(copy.detail_sums)
        both = copy.category_sums.select(*kpi_ops.KEYS).distinct().join(copy.detail_sums.select(*kpi_ops.KEYS).distinct(), list(kpi_ops.KEYS))
        copy.available = both.select(month_key(F.col("MonthStart")).alias("Monat"), "IdStore")
        return copy
