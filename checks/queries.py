"""Every operator as a query on the given tables, keyed by its name."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.scratch import shared_folder
from shopgauge import config
from shopgauge.config import Preset
from shopgauge.functions import expressions as ex
from shopgauge.functions import formats as fm
from shopgauge.operators import category, compare, health, kpi, location, lookup, period, reports, ruletable, sales
from shopgauge.operators import costs as cost_ops
from shopgauge.plans import viewsql
from shopgauge.plans.benchmark import Benchmark
from shopgauge.plans.catalog import register_views
from shopgauge.schemas import as_doubles
from shopgauge.sources import layout, registry, sink, starschema, tables
from shopgauge.sources.starschema import StarSchema

Query = Callable[[SparkSession, str], DataFrame]

PRESET = Preset(starschema.RULES, config.BUCKETS_V2)
PRESET_OLD = Preset(starschema.RULES, config.BUCKETS_V1)
MONTH = "1997-03"
#: Labels for a year of the data; other months have none.
LABELS = tuple((f"1997-{i:02d}", f"Monat {i} von 1997") for i in range(1, 13))
QUERIES: dict[str, Query] = {}


def bench(spark: SparkSession, sf_dir: str, preset: Preset = PRESET) -> Benchmark:
    return Benchmark(StarSchema(spark, sf_dir), preset)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_")] = lambda spark, sf_dir: as_doubles(fn(spark, sf_dir))
    return fn


# ---- sources and sinks ------------------------------------------------------------------


@query
def src_table(spark, sf_dir):
    return tables.read_table(spark, "orders", {"format": "parquet", "path": sf_dir})


@query
def src_sales(spark, sf_dir):
    return starschema.sales(spark, sf_dir)


@query
def src_costs(spark, sf_dir):
    return starschema.costs(spark, sf_dir)


@query
def src_salesorg(spark, sf_dir):
    return starschema.stores(spark, sf_dir)


@query
def src_location(spark, sf_dir):
    return starschema.locations(spark, sf_dir)


@query
def src_registry(spark, sf_dir):
    return starschema.store_registry(spark, sf_dir)


@query
def views_register(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    counts = []
    for generation, preset in (("v1", PRESET_OLD), ("v2", PRESET)):
        for view in register_views(src, generation, preset, f"{generation}_"):
            counts.append(spark.table(view).agg(F.count("*").alias("n")).select(F.lit(view).alias("view"), "n"))
    return reduce(DataFrame.unionByName, counts)


#: The sources as SQL text for lasting views.
LASTING_SOURCES = {
    "sales": """
        SELECT l_shipdate AS ID_CALMONTH, s_nationkey AS ID_STORE, l_partkey AS ID_MATERIAL, p_name AS ProduktBeschreibung,
               CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(19,4)) AS RevenueEUR,
               CAST(round(p_retailprice * l_quantity, 4) AS DECIMAL(19,4)) AS TransferPriceEUR,
               CAST(round(p_retailprice, 4) AS DECIMAL(19,4)) AS SalesPriceEUR, CAST(l_quantity AS INT) AS SalesAmount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "costs": """
        SELECT o_orderdate AS ID_CALMONTH, c_nationkey AS ID_STORE, n_name AS StoreName,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Monthly Salary' WHEN '2-HIGH' THEN 'Monthly Social Costs'
                    WHEN '3-MEDIUM' THEN 'Monthly Rent' ELSE 'Commission' END AS Kostenkategorie,
               CAST(round(o_totalprice * 0.2, 4) AS DECIMAL(19,4)) AS WertEUR
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "salesorg": "SELECT n_nationkey AS SALESORG_ID, n_name AS STORE_LOCATION FROM nation",
}


class Faulty(StarSchema):
    """Missing months, stores and amounts, stores unknown or twice in the masters, one side only, two spellings."""

    @cached_property
    def sales(self):
        store, material = F.col("ID_STORE"), F.col("ID_MATERIAL")
        lines = super().sales.where(~((store == 7) & (F.col("ID_CALMONTH") >= F.lit("1996-01-01"))))
        return lines.withColumns({
            "ID_CALMONTH": F.when(material % 50 != 1, F.col("ID_CALMONTH")),
            "ID_STORE": F.when(material % 90 == 3, store + 100).when(material % 70 != 2, store),
            "RevenueEUR": F.when(material % 40 != 4, F.col("RevenueEUR")),
        })

    @cached_property
    def costs(self):
        other = (F.col("ID_STORE") % 4 == 0) & (F.dayofmonth("ID_CALMONTH") % 2 == 0)
        return super().costs.withColumn("StoreName", F.when(other, F.concat("StoreName", F.lit(" (2)"))).otherwise(F.col("StoreName")))

    @cached_property
    def stores(self):
        known = super().stores.where("SALESORG_ID <> 20")
        return known.unionByName(known.where("SALESORG_ID % 6 = 0")).unionByName(known.where("SALESORG_ID = 1").withColumn("SALESORG_ID", F.lit(None).cast("int")))

    @cached_property
    def locations(self):
        return super().locations.unionByName(super().locations.where("ID_STORE % 3 = 1"))


@query
def views_lasting(spark, sf_dir):
    """The rows of all thirteen lasting views, as another session sees them."""
    mark = uuid.uuid4().hex[:12]
    for source, select in LASTING_SOURCES.items():
        files = re.sub(r"\b(lineitem|supplier|part|orders|customer|nation)\b", rf"parquet.`{sf_dir}/\1.parquet` AS \1", select)
        spark.sql(f"CREATE OR REPLACE VIEW {source}_{mark} AS {files}")
    names = viewsql.SourceNames(*(f"{source}_{mark}" for source in LASTING_SOURCES))
    other, counts = spark.newSession(), []
    for generation, preset in (("v1", PRESET_OLD), ("v2", PRESET)):
        for view in viewsql.create_views(spark, names, generation, preset, f"{generation}_{mark}_"):
            shown = F.lit(view.replace(f"{mark}_", "")).alias("view")
            counts.append(other.table(view).agg(F.count("*").alias("n")).select(shown, "n"))
    return reduce(DataFrame.unionByName, counts)


@query
def export_laid_out(spark, sf_dir):
    """The export from facts bucketed by month and store."""
    facts = layout.lay_out(bench(spark, sf_dir), shared_folder(spark), f"facts_{uuid.uuid4().hex[:12]}_")
    return Benchmark(facts, PRESET).export_v2


@query
def source_health(spark, sf_dir):
    src = Faulty(spark, sf_dir)
    return health.source_health(src.sales, src.costs, src.stores, src.locations, config.BUCKETS_V2)


@query
def detail_scan(spark, sf_dir):
    return period.detail(bench(spark, sf_dir).export_v2, MONTH)


@query
def detail_scan_category(spark, sf_dir):
    return period.detail(bench(spark, sf_dir).sales_agg, MONTH, "IdCalmonthStd")


@query
def sink_csv(spark, sf_dir):
    export = as_doubles(bench(spark, sf_dir).export_v2)
    target = sink.write_csv(export, shared_folder(spark))
    return spark.read.schema(export.schema).option("header", True).csv(target)


@query
def rows_per_store(spark, sf_dir):
    return sales.rows_per_store(StarSchema(spark, sf_dir).sales, config.STORE_IDS)


# ---- projections, filters, predicates ---------------------------------------------------


@query
def sales_std(spark, sf_dir):
    return bench(spark, sf_dir).sales_std


@query
def month_key(spark, sf_dir):
    orders = starschema.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", ex.month_key(F.col("o_orderdate")).alias("month"))


#: Added to part names in turn, so that every class, both orders of conflicting rules and mixed case occur.
MODELS = ("", "JMS E-BIKE", "e-trekking", "hardtail mtb", "Mountain King", "TRAVEL CITY", "Trekking Kid", "Kinderrad",
          "gRaCe MX", "Cube Trekking Pedelec", "PUKY Z2", "Copperhead 3", "vulture 8", "Rixe Comp", "Town Lite", "Corona")


def _classified(spark, sf_dir, rules, models=MODELS):
    parts = starschema.table(spark, sf_dir, "part")
    turn = (F.col("p_partkey") % len(models)).cast("int")
    named = parts.select("p_partkey", F.concat_ws(" ", "p_name", F.get(F.array(*map(F.lit, models)), turn)).alias("p_name"))
    return ex.classified(named, "p_name", rules, "category").select("p_partkey", "p_name", "category")


@query
def category_v1(spark, sf_dir):
    return _classified(spark, sf_dir, config.RULES_V1)


@query
def category_v2(spark, sf_dir):
    return _classified(spark, sf_dir, config.RULES_V2)


@query
def category_from_table(spark, sf_dir):
    parts = starschema.table(spark, sf_dir, "part")
    turn = (F.col("p_partkey") % len(MODELS)).cast("int")
    named = parts.select("p_partkey", F.concat_ws(" ", "p_name", F.get(F.array(*map(F.lit, MODELS)), turn)).alias("p_name"))
    rules = ruletable.rule_table(spark, config.RULES_V2)
    return ruletable.classified_by_table(named, "p_name", rules, config.RULES_V2.fallback, "category")


@query
def category_rules(spark, sf_dir):
    return _classified(spark, sf_dir, starschema.RULES, ("small",))


@query
def gross_profit(spark, sf_dir):
    profit = ex.gross_profit(F.col("RevenueEUR"), F.col("TransferPriceEUR"))
    return starschema.sales(spark, sf_dir).select("ID_STORE", "ID_MATERIAL", profit.alias("GrossProfitEur"))


@query
def store_whitelist(spark, sf_dir):
    return sales.where_stores(starschema.sales(spark, sf_dir), config.STORE_IDS)


@query
def period_filter(spark, sf_dir):
    return period.in_period(bench(spark, sf_dir).export_v2, MONTH)


@query
def period_at_the_source(spark, sf_dir):
    return Benchmark(StarSchema(spark, sf_dir), PRESET, MONTH).export_v2


@query
def store_filter(spark, sf_dir):
    return period.of_store(bench(spark, sf_dir).export_v2, "nation_1")


@query
def store_filter_by_id(spark, sf_dir):
    return period.of_store(bench(spark, sf_dir).export_v2, 3)


@query
def export_v1(spark, sf_dir):
    return bench(spark, sf_dir, PRESET_OLD).export_v1()


@query
def rent(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    return location.monthly_rent(src.locations, src.stores)


@query
def min_stores_gate(spark, sf_dir):
    return period.require_stores(bench(spark, sf_dir).period_kpis_all, 10)


# ---- joins ------------------------------------------------------------------------------


@query
def join_salesorg(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    named = sales.with_store_name(src.sales.withColumnRenamed("ID_STORE", "IdStore"), src.stores)
    return named.select("IdStore", "StoreName", "ID_MATERIAL", "RevenueEUR")


@query
def join_sales_costs(spark, sf_dir):
    b = bench(spark, sf_dir)
    return kpi.sales_with_costs(b.category_sums, b.cost_sums)


@query
def join_kpi_costs(spark, sf_dir):
    b = bench(spark, sf_dir)
    joined = kpi.kpi_wide(b.store_totals, b.cost_sums)
    columns = ["MonthStart", "IdStore", "StoreName", "NetProfitEur", "AdditionalProcurementCostsEur"]
    return sales.published(joined.select(columns))


@query
def cost_lookup(spark, sf_dir):
    b = bench(spark, sf_dir)
    keys = b.store_totals.select(*kpi.KEYS, "StoreName")
    return sales.published(cost_ops.cost_lookup(keys, b.sources.costs))


@query
def join_location(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    return location.monthly_rent(src.locations, src.stores).select("ID_STORE", "StoreName", "LOC_SIZE_M2")


@query
def join_store_size(spark, sf_dir):
    b = bench(spark, sf_dir)
    return location.with_size(b.period_kpis, b.sources.locations).select("store_id", "store_name", "size_m2")


@query
def join_store_size_repeated(spark, sf_dir):
    b = bench(spark, sf_dir)
    more = b.sources.locations.where("ID_STORE % 3 = 1").withColumn("LOC_SIZE_M2", F.expr("CAST(50 + ID_STORE * 30 AS DECIMAL(12,2))"))
    areas = b.sources.locations.unionByName(more)
    return location.with_size(b.period_kpis, areas).select("store_id", "store_name", "size_m2")


@query
def join_store_size_by_name(spark, sf_dir):
    """Area rows that name their store: one more for every third store, and one whose name holds two registered names."""
    b = bench(spark, sf_dir)
    nations = starschema.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    own = nations.selectExpr("n AS ord", "'Filiale ' || name AS StoreName", "CASE WHEN n <> 24 THEN n % 7 * 100 END AS size")
    more = nations.where("n % 3 = 1").selectExpr("n + 100 AS ord", "lower(name) || ' (Umbau)' AS StoreName", "n * 30 + 50 AS size")
    both = nations.where("n = 5").selectExpr("n + 200 AS ord", "name || '/Nation_14' AS StoreName", "777 AS size")
    areas = own.unionByName(more).unionByName(both).withColumn("LOC_SIZE_M2", F.col("size").cast("decimal(12,2)"))
    sized = location.with_size_by_name(b.period_kpis, areas, b.sources.registry, ["ord"])
    return sized.select("store_id", "store_name", "size_m2")


# ---- aggregations -----------------------------------------------------------------------


@query
def sales_agg(spark, sf_dir):
    return bench(spark, sf_dir).sales_agg


@query
def costs_agg_v1(spark, sf_dir):
    return cost_ops.costs_agg(starschema.costs(spark, sf_dir), config.BUCKETS_V1)


@query
def costs_agg_v2(spark, sf_dir):
    return cost_ops.costs_agg(starschema.costs(spark, sf_dir), config.BUCKETS_V2)


@query
def costs_detail(spark, sf_dir):
    return bench(spark, sf_dir).costs_detail


@query
def kpi_(spark, sf_dir):
    return bench(spark, sf_dir).kpi


@query
def kpi_v1(spark, sf_dir):
    return bench(spark, sf_dir, PRESET_OLD).kpi


@query
def kpi_from_categories(spark, sf_dir):
    b = bench(spark, sf_dir)
    return kpi.kpi(sales.sum_categories(b.category_sums), b.cost_sums)


@query
def group_compare(spark, sf_dir):
    groups = StarSchema(spark, sf_dir).groups
    return kpi.compare_groups(bench(spark, sf_dir, PRESET_OLD).kpi, groups)


@query
def export_v2(spark, sf_dir):
    return bench(spark, sf_dir).export_v2


@query
def waterfall_view(spark, sf_dir):
    return bench(spark, sf_dir).waterfall


class Spelled(StarSchema):
    """Costs under two spellings of a store: even stores book under one or the other, odd ones every amount under both."""

    @cached_property
    def costs(self):
        other = F.concat("StoreName", F.lit(" (2)"))
        even = F.array(F.when(F.dayofmonth("ID_CALMONTH") % 2 == 0, F.col("StoreName")).otherwise(other))
        names = F.when(F.col("ID_STORE") % 2 == 0, even).otherwise(F.array("StoreName", other))
        return super().costs.withColumn("StoreName", F.explode(names))


@query
def kpi_spellings(spark, sf_dir):
    return Benchmark(Spelled(spark, sf_dir), PRESET).kpi


@query
def export_spellings(spark, sf_dir):
    return Benchmark(Spelled(spark, sf_dir), PRESET).export_v2


@query
def waterfall_spellings(spark, sf_dir):
    return Benchmark(Spelled(spark, sf_dir), PRESET).waterfall


class Missing(StarSchema):
    """Store 2 has no revenue, and amounts of gadgets are missing."""

    def _cut(self, lines):
        gadget = F.col("ProduktBeschreibung").like("%widget%") | F.col("ProduktBeschreibung").like("%gizmo%")
        revenue = F.when(F.col("ID_STORE") == 2, 0).when(~gadget, F.col("RevenueEUR")).cast("decimal(19,4)")
        return lines.withColumn("RevenueEUR", revenue)

    @cached_property
    def sales(self):
        return self._cut(super().sales)

    def classified_sales(self, rules):
        return self._cut(super().classified_sales(rules))


@query
def category_totals_missing(spark, sf_dir):
    return Benchmark(Missing(spark, sf_dir), PRESET).category_totals


@query
def best_worst_missing(spark, sf_dir):
    return category.best_worst(Benchmark(Missing(spark, sf_dir), PRESET).category_totals)


@query
def insights_missing(spark, sf_dir):
    figures = Benchmark(Missing(spark, sf_dir), PRESET).period_kpis_all
    return compare.insights(figures.where("store_id = 2"))


@query
def stored_figures(spark, sf_dir):
    return bench(spark, sf_dir).stored(shared_folder(spark)).export_v2


class Later(StarSchema):
    """A later state of the sources: no costs from 1997 on, no sales in one month, twice the revenue in another."""

    def _later(self, lines):
        month = F.date_format("ID_CALMONTH", "yyyy-MM")
        revenue = F.when(month == "1995-06", F.col("RevenueEUR") * 2).otherwise(F.col("RevenueEUR"))
        return lines.where(month != "1994-03").withColumn("RevenueEUR", revenue.cast("decimal(19,4)"))

    @cached_property
    def sales(self):
        return self._later(super().sales)

    def classified_sales(self, rules):
        return self._later(super().classified_sales(rules))

    @cached_property
    def costs(self):
        return super().costs.where(F.col("ID_CALMONTH") < F.lit("1997-01-01"))


@query
def stored_refreshed(spark, sf_dir):
    folder = shared_folder(spark)
    bench(spark, sf_dir).stored(folder)
    return Benchmark(Later(spark, sf_dir), PRESET).stored(folder).export_v2


@query
def period_kpis(spark, sf_dir):
    return bench(spark, sf_dir).period_kpis


@query
def period_kpis_month(spark, sf_dir):
    return Benchmark(StarSchema(spark, sf_dir), PRESET, MONTH).period_kpis


@query
def period_kpis_all(spark, sf_dir):
    return bench(spark, sf_dir).period_kpis_all


@query
def series_revenue(spark, sf_dir):
    b = bench(spark, sf_dir)
    return period.monthly_series(b.export_v2, b.sources.registry, "UmsatzEur", "revenue")


@query
def series_net_profit(spark, sf_dir):
    b = bench(spark, sf_dir)
    return period.monthly_series(b.export_v2, b.sources.registry, "NettogewinnEur", "net_profit")


@query
def category_totals(spark, sf_dir):
    return bench(spark, sf_dir).category_totals


@query
def category_by_store_revenue(spark, sf_dir):
    return category.category_by_store(bench(spark, sf_dir).sales_agg, "TotalRevenueEur", "revenue")


@query
def category_by_store_quantity(spark, sf_dir):
    return category.category_by_store(bench(spark, sf_dir).sales_agg, "TotalQuantity", "quantity")


@query
def category_by_store_avg_price(spark, sf_dir):
    return category.category_by_store(bench(spark, sf_dir).sales_agg, "AvgSalesPriceEur", "avg_price", "mean")


@query
def category_by_store_gross_profit(spark, sf_dir):
    return category.category_by_store(bench(spark, sf_dir).sales_agg, "TotalGrossProfitEur", "gross_profit")


@query
def cost_structure(spark, sf_dir):
    return compare.cost_structure(bench(spark, sf_dir).period_kpis_all)


@query
def avg_cost_ratios(spark, sf_dir):
    return reports.avg_ratios(bench(spark, sf_dir).export_v2)


# ---- rankings and relative scores -------------------------------------------------------


@query
def profit_ranking(spark, sf_dir):
    return compare.rank_stores(bench(spark, sf_dir).period_kpis_all)


@query
def revenue_leader(spark, sf_dir):
    return compare.leader_vs_mean(bench(spark, sf_dir).period_kpis_all)


@query
def margin_leader(spark, sf_dir):
    return compare.leader(bench(spark, sf_dir).period_kpis_all, "margin")


@query
def insights(spark, sf_dir):
    return compare.insights(bench(spark, sf_dir).period_kpis_all)


@query
def scorecard(spark, sf_dir):
    b = bench(spark, sf_dir)
    return compare.scorecard(b.period_kpis_all, b.sources.locations)


@query
def radar(spark, sf_dir):
    return compare.radar(bench(spark, sf_dir).period_kpis_all)


@query
def cost_extremes(spark, sf_dir):
    return compare.cost_extremes(bench(spark, sf_dir).period_kpis_all)


@query
def cost_rank(spark, sf_dir):
    return compare.cost_rank(bench(spark, sf_dir).period_kpis_all)


@query
def cost_efficiency(spark, sf_dir):
    return compare.cost_efficiency(bench(spark, sf_dir).period_kpis_all)


@query
def category_share(spark, sf_dir):
    return category.category_share(bench(spark, sf_dir).sales_agg)


@query
def margin_compare(spark, sf_dir):
    return compare.margin_compare(bench(spark, sf_dir).period_kpis_all)


@query
def profit_bridge(spark, sf_dir):
    return compare.profit_bridge(bench(spark, sf_dir).period_kpis_all)


# ---- sorts, limits, top-k, set operations -----------------------------------------------


@query
def top3_categories(spark, sf_dir):
    return category.top_k(bench(spark, sf_dir).category_totals, 3)


@query
def bottom3_categories(spark, sf_dir):
    return category.bottom_k(bench(spark, sf_dir).category_totals, 3)


@query
def best_worst_category(spark, sf_dir):
    return category.best_worst(bench(spark, sf_dir).category_totals)


@query
def profitability_report(spark, sf_dir):
    return reports.profitability_report(bench(spark, sf_dir).export_v2)


@query
def trend_report(spark, sf_dir):
    return reports.trend_report(bench(spark, sf_dir).export_v2)


@query
def months_available(spark, sf_dir):
    return period.months(bench(spark, sf_dir).export_v2, registry.month_labels(spark))


@query
def stores_available(spark, sf_dir):
    b = bench(spark, sf_dir)
    return period.active_stores(b.export_v2, b.sources.registry)


@query
def months_from_sums(spark, sf_dir):
    return period.months(bench(spark, sf_dir).stored(shared_folder(spark)).available, registry.month_labels(spark))


@query
def stores_from_sums(spark, sf_dir):
    b = bench(spark, sf_dir).stored(shared_folder(spark))
    return period.active_stores(b.available, b.sources.registry)


@query
def store_comparison(spark, sf_dir):
    return bench(spark, sf_dir, PRESET_OLD).store_comparison()


# ---- scalar functions and lookups -------------------------------------------------------


@query
def like_match(spark, sf_dir):
    name = F.col("p_name")
    return starschema.table(spark, sf_dir, "part").select(
        "p_partkey",
        ex.like_match(name, "%RING%").alias("any_case"),
        ex.like_match(name, "%ring%", case_sensitive=True).alias("same_case"),
        ex.like_match(name, "hot%").alias("prefix"),
    )


@query
def safe_ratio(spark, sf_dir):
    balance, price = F.col("c_acctbal"), F.col("o_totalprice")
    customers = starschema.table(spark, sf_dir, "customer")
    orders = starschema.table(spark, sf_dir, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", ex.pct(price, balance).alias("ratio"), ex.pct(price, balance, 0.0).alias("ratio_or_zero")
    )


@query
def round2(spark, sf_dir):
    return starschema.sales(spark, sf_dir).select(
        "ID_STORE", "ID_MATERIAL", ex.round2(F.col("RevenueEUR")).alias("revenue")
    )


@query
def isnull_zero(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    areas = src.registry.join(src.locations.withColumnRenamed("ID_STORE", "id"), "id", "left")
    return areas.select("id", ex.or_zero(F.col("LOC_SIZE_M2")).alias("size_m2"))


@query
def format_currency(spark, sf_dir):
    return bench(spark, sf_dir).export_v2.select(
        "Monat",
        "IdStore",
        fm.fmt_eur(F.col("UmsatzEur")).alias("revenue"),
        fm.fmt_eur(F.col("NettogewinnEur")).alias("net_profit"),
        fm.fmt_eur(F.col("NettogewinnMargeProzent")).alias("small"),
    )


def _margin(spark, sf_dir, **columns):
    return bench(spark, sf_dir).export_v2.select("Monat", "IdStore", *[c.alias(n) for n, c in columns.items()])


MARGIN = "NettogewinnMargeProzent"


@query
def format_percent(spark, sf_dir):
    return _margin(spark, sf_dir, margin=fm.fmt_pct(F.col(MARGIN)))


# The margin, but missing and exactly 0 in every seventh store each.
def _change():
    return F.expr(f"CASE IdStore % 7 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE {MARGIN} END").cast("decimal(38,2)")


@query
def signed_change(spark, sf_dir):
    return _margin(spark, sf_dir, text=fm.signed_pct(_change()), kind=fm.change_class(_change()))


@query
def trend_band(spark, sf_dir):
    return _margin(spark, sf_dir, band=fm.trend_band(_change()), arrow=fm.trend_arrow(_change()))


@query
def store_by_name(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    return lookup.match_name(src.costs, src.registry, "StoreName", "store", src.stores.select("STORE_LOCATION")).select(
        "ID_CALMONTH", "WertEUR", "StoreName", "store_name", "store_short"
    )


@query
def store_by_name_from_facts(spark, sf_dir):
    """Costs under names that only the costs know: with more around the registered name, or just a part of it."""
    name, store = F.col("StoreName"), F.col("ID_STORE")
    longer = F.concat(F.lit("Filiale "), F.lower(name), F.lit(" Süd"))
    named = F.when(store % 2 == 0, longer).when(store % 5 == 0, F.substring(name, 1, 6)).when(store != 13, name)
    src = StarSchema(spark, sf_dir)
    costs = src.costs.select(ex.month_start(F.col("ID_CALMONTH")).alias("MonthStart"), named.alias("StoreName"), "WertEUR")
    found = lookup.match_sums(costs, src.registry, "StoreName", "store", ["MonthStart"], {"KostenEur": F.sum("WertEUR")})
    return sales.published(found)


@query
def store_by_id(spark, sf_dir):
    src = StarSchema(spark, sf_dir)
    return lookup.with_store(src.sales, src.registry, "ID_STORE").select(
        "ID_STORE", "ID_MATERIAL", "registry_name", "registry_short"
    )


@query
def category_lookup(spark, sf_dir):
    categories = registry.category_registry(spark, starschema.CATEGORIES)
    agg = bench(spark, sf_dir).sales_agg.select("IdCalmonthStd", "IdStore", "BenchmarkCategory", "TotalQuantity")
    names = registry.category_names(spark, starschema.RULES)
    return lookup.match_name(agg, categories, "BenchmarkCategory", "category", names)


@query
def month_label(spark, sf_dir):
    export = bench(spark, sf_dir).export_v2.select("Monat", "IdStore", "UmsatzEur")
    return period.with_month_label(export, registry.month_labels(spark, LABELS))


@query
def find_column(spark, sf_dir):
    export = bench(spark, sf_dir).export_v2
    return export.groupBy("IdStore").agg(
        lookup.safe_sum(export, "umsatz").alias("revenue"),
        lookup.safe_mean(export, "nettogewinnmarge").alias("margin"),
        lookup.safe_sum(export, "rabatt").cast("double").alias("absent"),
    )
