"""The same queries as plain SQL over the given tables, written without the library.

Each statement is a chain of common table expressions. The SQL keeps the row-by-row form of
the definitions (store names joined to every line, costs joined again, one subquery per cost
position), so it checks the rewritten plans of the library.
"""

from __future__ import annotations

import re

MONTH = "1997-03"

# Named building blocks: name -> (blocks it needs, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: tuple[str, ...], body: str) -> None:
    BLOCKS[name] = (needs, body)


block("sales", (), """
    SELECT l_shipdate AS ID_CALMONTH, s_nationkey AS ID_STORE, l_partkey AS ID_MATERIAL,
           p_name AS ProduktBeschreibung,
           CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(19,4)) AS RevenueEUR,
           CAST(round(p_retailprice * l_quantity, 4) AS DECIMAL(19,4)) AS TransferPriceEUR,
           CAST(p_retailprice AS DECIMAL(19,4)) AS SalesPriceEUR,
           CAST(l_quantity AS INTEGER) AS SalesAmount
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""")

block("costs", (), """
    SELECT o_orderdate AS ID_CALMONTH, c_nationkey AS ID_STORE, n_name AS StoreName,
           CASE o_orderpriority
               WHEN '1-URGENT' THEN 'Monthly Salary'
               WHEN '2-HIGH' THEN 'Monthly Social Costs'
               WHEN '3-MEDIUM' THEN 'Monthly Rent'
               WHEN '4-NOT SPECIFIED' THEN
                   CASE WHEN o_orderstatus = 'F' THEN 'Marketing Campaign'
                        WHEN o_orderstatus = 'O' THEN 'Additional Procurement Costs'
                        ELSE 'Additional Procurement Costs for ' || o_orderstatus END
               ELSE CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'Insurance' ELSE 'Commission' END
           END AS Kostenkategorie,
           CAST(round(o_totalprice * 0.2, 4) AS DECIMAL(19,4)) AS WertEUR
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

# The sources of the lasting views: fewer cost categories, so that a store may lack some of them
block("costs_lasting", ("costs",), """
    SELECT * REPLACE (CASE WHEN Kostenkategorie IN ('Monthly Salary', 'Monthly Social Costs', 'Monthly Rent') THEN Kostenkategorie
                           ELSE 'Commission' END AS Kostenkategorie) FROM costs""")

block("salesorg", (), "SELECT n_nationkey AS SALESORG_ID, n_name AS STORE_LOCATION FROM nation")

block("location", (), """
    SELECT n_nationkey AS ID_STORE,
           CAST(CASE WHEN n_nationkey <> 24 THEN 100 * (n_nationkey % 7) END AS DECIMAL(12,2)) AS LOC_SIZE_M2,
           CAST(10 + n_regionkey AS DECIMAL(12,2)) AS LOC_RENT_EUR_M2,
           CAST(2.50 AS DECIMAL(12,2)) AS LOC_NEBENKOSTEN_EUR
    FROM nation""")

block("registry", (), """
    SELECT n_nationkey AS ord, n_nationkey AS id, n_name AS name,
           'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS short FROM nation""")

RULES = """
    CASE WHEN {c} ILIKE '%widget%' OR {c} ILIKE '%gizmo%' THEN 'Gadgets'
         WHEN {c} ILIKE '%small%' THEN 'Small Parts'
         WHEN {c} ILIKE '%rod%' OR {c} ILIKE '%ring%' THEN 'Rods and Rings'
         WHEN {c} ILIKE '%hot%' THEN 'Hot Parts'
         WHEN {c} ILIKE '%plate%' OR {c} ILIKE '%anvil%' THEN 'Plates'
         ELSE 'Fasteners' END"""

RULES_V1 = """
    CASE WHEN {c} ILIKE '%E-Bike%' OR {c} ILIKE '%E-Trekking%' THEN 'E-Bike'
         WHEN {c} ILIKE '%MTB%' OR {c} ILIKE '%Mountain%' THEN 'MTB'
         WHEN {c} ILIKE '%City%' OR {c} ILIKE '%Trekking%' THEN 'City/Trekking'
         WHEN {c} ILIKE '%Kid%' OR {c} ILIKE '%Kinder%' THEN 'Kinder'
         ELSE 'Sonstige' END"""

RULES_V2 = """
    CASE WHEN {c} ILIKE '%Grace%' OR {c} ILIKE '%JMS e-Bike%' OR {c} ILIKE '%S-Pedelec%' OR {c} ILIKE '%Pedelec%' THEN 'E-Trekking'
         WHEN {c} ILIKE '%Puky%' OR {c} ILIKE '%Cubie%' OR {c} ILIKE '%Mini Racer%' OR {c} ILIKE '%Leo%' THEN 'Kid Bikes'
         WHEN {c} ILIKE '%Copperhead%' OR {c} ILIKE '%Aim Disc%' OR {c} ILIKE '%Reaction%' OR {c} ILIKE '%Genius%' THEN 'Mountain Bikes'
         WHEN {c} ILIKE '%Diesel%' OR {c} ILIKE '%Night Falcon%' OR {c} ILIKE '%Vulture%' OR {c} ILIKE '%Cervelo%' THEN 'Race Bikes'
         WHEN {c} ILIKE '%Rixe%' OR {c} ILIKE '%Avenza%' OR {c} ILIKE '%KATHMANDU%' OR {c} ILIKE '%Trekking%' THEN 'Trekking Bikes'
         WHEN {c} ILIKE '%Corona%' OR {c} ILIKE '%PEGASUS%' OR {c} ILIKE '%Town Lite%' OR {c} ILIKE '%Travel City%' THEN 'City Bikes'
         ELSE 'City Bikes' END"""

MODELS = """ ['', 'JMS E-BIKE', 'e-trekking', 'hardtail mtb', 'Mountain King', 'TRAVEL CITY', 'Trekking Kid', 'Kinderrad',
    'gRaCe MX', 'Cube Trekking Pedelec', 'PUKY Z2', 'Copperhead 3', 'vulture 8', 'Rixe Comp', 'Town Lite', 'Corona']"""

block("std", ("sales", "salesorg"), f"""
    SELECT strftime(ID_CALMONTH, '%Y-%m') AS IdCalmonthStd, ID_STORE AS IdStore, STORE_LOCATION AS StoreName,
           ID_MATERIAL AS IdMaterial, ProduktBeschreibung AS MaterialDescription,
           {RULES.format(c='ProduktBeschreibung')} AS BenchmarkCategory,
           RevenueEUR AS RevenueEur, RevenueEUR - TransferPriceEUR AS GrossProfitEur,
           TransferPriceEUR AS TransferCostEur, SalesPriceEUR AS SalesPriceEur, SalesAmount AS Quantity
    FROM sales JOIN salesorg ON ID_STORE = SALESORG_ID""")

block("agg", ("std",), """
    SELECT IdCalmonthStd, IdStore, StoreName, BenchmarkCategory, sum(RevenueEur) AS TotalRevenueEur,
           sum(GrossProfitEur) AS TotalGrossProfitEur, sum(TransferCostEur) AS TotalTransferCostEur,
           CAST((2 * CAST(sum(SalesPriceEur) * 10000 AS HUGEINT) + count(SalesPriceEur)) // (2 * count(SalesPriceEur))
                / 10000 AS DECIMAL(19,4)) AS AvgSalesPriceEur,
           CAST(sum(Quantity) AS BIGINT) AS TotalQuantity
    FROM std GROUP BY ALL""")


def costs_body(personnel: str, operating: str, procurement: str, costs: str = "costs") -> str:
    return f"""
    SELECT strftime(ID_CALMONTH, '%Y-%m') AS IdCalmonthStd, ID_STORE AS IdStore, StoreName,
           sum(WertEUR) AS TotalCostsEur,
           sum(CASE WHEN {personnel} THEN WertEUR ELSE 0 END) AS PersonnelCostsEur,
           sum(CASE WHEN {operating} THEN WertEUR ELSE 0 END) AS OperatingCostsEur,
           sum(CASE WHEN {procurement} THEN WertEUR ELSE 0 END) AS AdditionalProcurementCostsEur
    FROM {costs} GROUP BY 1, 2, 3"""


block("costs_v1", ("costs",), costs_body(
    "lower(Kostenkategorie) IN ('monthly salary', 'monthly social costs')",
    "lower(Kostenkategorie) IN ('monthly rent', 'marketing campaign', 'commission')",
    "lower(Kostenkategorie) = 'additional procurement costs'"))
V2 = (
    "lower(Kostenkategorie) IN ('monthly salary', 'monthly social costs', 'commission')",
    "lower(Kostenkategorie) IN ('monthly rent', 'marketing campaign')",
    "Kostenkategorie ILIKE 'Additional Procurement Costs%'")
block("costs_v2", ("costs",), costs_body(*V2))

# Two spellings: even stores book under one or the other, odd ones every amount under both
block("costs_sp", ("costs",), """
    SELECT ID_CALMONTH, ID_STORE, unnest(CASE
               WHEN ID_STORE % 2 = 1 THEN [StoreName, StoreName || ' (2)']
               WHEN day(ID_CALMONTH) % 2 = 0 THEN [StoreName] ELSE [StoreName || ' (2)'] END) AS StoreName,
           Kostenkategorie, WertEUR
    FROM costs""")
block("costs_v2_sp", ("costs_sp",), costs_body(*V2, "costs_sp"))

block("detail", ("costs",), """
    SELECT strftime(ID_CALMONTH, '%Y-%m') AS IdCalmonthStd, ID_STORE AS IdStore, StoreName, Kostenkategorie,
           sum(WertEUR) AS KostenEur
    FROM costs GROUP BY 1, 2, 3, 4""")

RATIOS = """
           CASE WHEN {r} > 0 THEN CAST({g} AS DOUBLE) / CAST({r} AS DOUBLE) * 100 END AS GrossProfitMarginPct,
           CASE WHEN {r} > 0 THEN CAST({o} AS DOUBLE) / CAST({r} AS DOUBLE) * 100 END AS OperatingCostRatioPct,
           CASE WHEN {c} > 0 THEN CAST({p} AS DOUBLE) / CAST({c} AS DOUBLE) * 100 END AS PersonnelCostRatioPct,
           CASE WHEN {r} > 0 THEN CAST({n} AS DOUBLE) / CAST({r} AS DOUBLE) * 100 END AS NetProfitMarginPct"""


def kpi_body(costs: str) -> str:
    ratios = RATIOS.format(r="sum(TotalRevenueEur)", g="sum(TotalGrossProfitEur)", o="OperatingCostsEur",
                           c="TotalCostsEur", p="PersonnelCostsEur", n="(sum(TotalGrossProfitEur) - TotalCostsEur)")
    return f"""
    SELECT a.IdCalmonthStd, a.IdStore, a.StoreName, sum(TotalRevenueEur) AS TotalRevenueEur,
           sum(TotalGrossProfitEur) AS TotalGrossProfitEur, TotalCostsEur, PersonnelCostsEur, OperatingCostsEur,
           sum(TotalGrossProfitEur) - TotalCostsEur AS NetProfitEur, {ratios}
    FROM agg a JOIN {costs} c ON a.IdCalmonthStd = c.IdCalmonthStd AND a.IdStore = c.IdStore
    GROUP BY a.IdCalmonthStd, a.IdStore, a.StoreName, TotalCostsEur, PersonnelCostsEur, OperatingCostsEur"""


block("kpi_v1", ("agg", "costs_v1"), kpi_body("costs_v1"))
block("kpi", ("agg", "costs_v2"), kpi_body("costs_v2"))
block("kpi_sp", ("agg", "costs_v2_sp"), kpi_body("costs_v2_sp"))

SUMS = """sum(TotalRevenueEur) AS TotalRevenueEur, sum(TotalGrossProfitEur) AS TotalGrossProfitEur,
           sum(TotalCostsEur) AS TotalCostsEur, sum(PersonnelCostsEur) AS PersonnelCostsEur,
           sum(OperatingCostsEur) AS OperatingCostsEur, sum(NetProfitEur) AS NetProfitEur"""
GROUP_RATIOS = RATIOS.format(r="sum(TotalRevenueEur)", g="sum(TotalGrossProfitEur)", o="sum(OperatingCostsEur)",
                             c="sum(TotalCostsEur)", p="sum(PersonnelCostsEur)", n="sum(NetProfitEur)")

block("groups", ("kpi_v1",), f"""
    SELECT IdCalmonthStd, r_name AS StoreGroup, {SUMS}, {GROUP_RATIOS}
    FROM kpi_v1 JOIN nation ON IdStore = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")

block("comparison", ("kpi_v1",), f"""
    SELECT IdCalmonthStd, 'Rosenheim' AS StoreGroup, TotalRevenueEur, TotalGrossProfitEur, TotalCostsEur,
           PersonnelCostsEur, OperatingCostsEur, NetProfitEur, GrossProfitMarginPct, OperatingCostRatioPct,
           PersonnelCostRatioPct, NetProfitMarginPct
    FROM kpi_v1 WHERE IdStore = 14
    UNION ALL
    SELECT IdCalmonthStd, 'Freiburg/Karlsruhe' AS StoreGroup, {SUMS}, {GROUP_RATIOS}
    FROM kpi_v1 WHERE IdStore IN (3, 5) GROUP BY IdCalmonthStd""")

PERCENTS = """round(GrossProfitMarginPct, 2) AS BruttogewinnMargeProzent,
           round(OperatingCostRatioPct, 2) AS BetriebskostenQuoteProzent,
           round(PersonnelCostRatioPct, 2) AS PersonalkostenAnteilProzent,
           round(NetProfitMarginPct, 2) AS NettogewinnMargeProzent"""

block("export_v1", ("comparison",), f"""
    SELECT IdCalmonthStd AS Monat, StoreGroup AS Filialgruppe, round(TotalRevenueEur, 2) AS UmsatzEur,
           round(TotalGrossProfitEur, 2) AS BruttogewinnEur, round(TotalCostsEur, 2) AS GesamtkostenEur,
           round(PersonnelCostsEur, 2) AS PersonalkostenEur, round(OperatingCostsEur, 2) AS BetriebskostenEur,
           round(NetProfitEur, 2) AS NettogewinnEur, {PERCENTS}
    FROM comparison""")

def export_body(kpi: str, costs: str) -> str:
    return f"""
    SELECT k.IdCalmonthStd AS Monat, k.StoreName AS Filialgruppe, k.IdStore,
           round(TotalRevenueEur, 2) AS UmsatzEur, round(TotalGrossProfitEur, 2) AS BruttogewinnEur,
           round(TotalRevenueEur - TotalGrossProfitEur, 2) AS WareneinsatzEur,
           round(TotalRevenueEur - TotalGrossProfitEur + k.OperatingCostsEur + k.PersonnelCostsEur
                 + AdditionalProcurementCostsEur, 2) AS GesamtkostenEur,
           round(k.PersonnelCostsEur, 2) AS PersonalkostenEur, round(k.OperatingCostsEur, 2) AS BetriebskostenEur,
           round(AdditionalProcurementCostsEur, 2) AS BeschaffungskostenEur,
           round(NetProfitEur, 2) AS NettogewinnEur, {PERCENTS}
    FROM {kpi} k JOIN {costs} c ON k.IdCalmonthStd = c.IdCalmonthStd AND k.IdStore = c.IdStore"""


block("export", ("kpi", "costs_v2"), export_body("kpi", "costs_v2"))
block("export_sp", ("kpi_sp", "costs_v2_sp"), export_body("kpi_sp", "costs_v2_sp"))


def position(category: str, month: str, store: str, costs: str) -> str:
    return f"""coalesce((SELECT sum(WertEUR) FROM {costs} x WHERE x.ID_STORE = {store}
               AND strftime(x.ID_CALMONTH, '%Y-%m') = {month} AND x.Kostenkategorie = '{category}'), 0)"""


def positions(month: str, store: str, costs: str = "costs") -> str:
    return f"""{position('Monthly Rent', month, store, costs)} AS MieteEur,
           {position('Marketing Campaign', month, store, costs)} AS MarketingEur,
           {position('Commission', month, store, costs)} AS KommissionEur"""


def waterfall_body(kpi: str, sums: str, costs: str) -> str:
    return f"""
    SELECT k.IdCalmonthStd, k.IdStore, k.StoreName, TotalRevenueEur AS UmsatzEur,
           TotalRevenueEur - TotalGrossProfitEur AS WareneinsatzEur, TotalGrossProfitEur AS BruttogewinnEur,
           k.PersonnelCostsEur AS PersonalkostenEur, {positions('k.IdCalmonthStd', 'k.IdStore', costs)},
           AdditionalProcurementCostsEur AS BeschaffungskostenEur, NetProfitEur AS NettogewinnEur
    FROM {kpi} k JOIN {sums} c ON k.IdCalmonthStd = c.IdCalmonthStd AND k.IdStore = c.IdStore"""


block("waterfall", ("kpi", "costs_v2"), waterfall_body("kpi", "costs_v2", "costs"))
block("waterfall_sp", ("kpi_sp", "costs_v2_sp"), waterfall_body("kpi_sp", "costs_v2_sp", "costs_sp"))


def figures(period: str, where: str = "") -> str:
    mean = "CAST(sum(CAST(NettogewinnMargeProzent AS DECIMAL(18,2))) AS DOUBLE) / count(NettogewinnMargeProzent)"
    return f"""
    SELECT {period} AS period, ord AS store_ord, id AS store_id, name AS store_name,
           coalesce(sum(UmsatzEur), 0) AS revenue, coalesce(sum(NettogewinnEur), 0) AS net_profit, {mean} AS margin,
           coalesce(sum(BruttogewinnEur), 0) AS gross_profit,
           coalesce(sum(UmsatzEur), 0) - coalesce(sum(BruttogewinnEur), 0) AS goods,
           coalesce(sum(PersonalkostenEur), 0) AS personnel, coalesce(sum(BetriebskostenEur), 0) AS operating,
           coalesce(sum(BeschaffungskostenEur), 0) AS procurement,
           coalesce(sum(UmsatzEur), 0) - coalesce(sum(BruttogewinnEur), 0) + coalesce(sum(PersonalkostenEur), 0)
               + coalesce(sum(BetriebskostenEur), 0) + coalesce(sum(BeschaffungskostenEur), 0) AS full_costs
    FROM export JOIN registry ON IdStore = id {where} GROUP BY 1, 2, 3, 4"""


block("total_kpis", ("export", "registry"), figures("'all'"))
block("month_kpis", ("export", "registry"), figures(f"'{MONTH}'", f"WHERE Monat = '{MONTH}'"))
block("kpis", ("export", "registry"), figures("'all'") + " UNION ALL " + figures("Monat"))

block("totals", ("agg",), """
    SELECT 'all' AS period, BenchmarkCategory AS category, sum(TotalRevenueEur) AS revenue,
           CAST(sum(TotalQuantity) AS BIGINT) AS quantity
    FROM agg GROUP BY 2""")

block("by_store", ("agg",), """
    SELECT IdStore AS store_id, StoreName AS store_name, BenchmarkCategory AS category,
           sum(TotalRevenueEur) AS revenue, CAST(sum(TotalQuantity) AS BIGINT) AS quantity,
           CAST(sum(AvgSalesPriceEur) AS DOUBLE) / count(AvgSalesPriceEur) AS avg_price, sum(TotalGrossProfitEur) AS gross_profit
    FROM agg GROUP BY 1, 2, 3""")

block("ranked", ("totals",), """
    SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, category) AS INTEGER) AS rank, count(*) OVER () AS n
    FROM totals""")

block("sized", ("kpis", "location"), """
    SELECT k.*, coalesce(LOC_SIZE_M2, 1) AS size_m2,
           CASE WHEN coalesce(LOC_SIZE_M2, 1) > 0
                THEN CAST(net_profit AS DOUBLE) / CAST(coalesce(LOC_SIZE_M2, 1) AS DOUBLE) ELSE 0 END AS profit_per_m2,
           CASE WHEN coalesce(LOC_SIZE_M2, 1) > 0
                THEN CAST(revenue AS DOUBLE) / CAST(coalesce(LOC_SIZE_M2, 1) AS DOUBLE) ELSE 0 END AS revenue_per_m2
    FROM kpis k LEFT JOIN location ON store_id = ID_STORE""")

block("scores", ("sized",), """
    WITH exact AS (SELECT * REPLACE (CAST(profit_per_m2 AS DECIMAL(38,12)) AS profit_per_m2,
                                     CAST(revenue_per_m2 AS DECIMAL(38,12)) AS revenue_per_m2,
                                     CAST(margin AS DECIMAL(38,12)) AS margin) FROM sized)
    SELECT s.*,
           round(CASE WHEN p > 0 THEN CAST(profit_per_m2 AS DOUBLE) / p * 100 ELSE 0 END, 6) AS profit_score,
           round(CASE WHEN r > 0 THEN CAST(revenue_per_m2 AS DOUBLE) / r * 100 ELSE 0 END, 6) AS revenue_score,
           round(CASE WHEN m > 0 THEN CAST(margin AS DOUBLE) / m * 100 ELSE 0 END, 6) AS margin_score
    FROM exact s JOIN (SELECT period, CAST(sum(profit_per_m2) AS DOUBLE) / count(profit_per_m2) AS p,
                              CAST(sum(revenue_per_m2) AS DOUBLE) / count(revenue_per_m2) AS r,
                              CAST(sum(margin) AS DOUBLE) / count(margin) AS m
                       FROM exact GROUP BY period) USING (period)""")

block("maxima", ("kpis",), """
    SELECT period, max(revenue) AS mr, max(net_profit) AS mn, max(gross_profit) AS mg FROM kpis GROUP BY period""")

block("leaders", ("kpis",), """
    SELECT period, max(revenue) AS best_revenue, CAST(sum(revenue) AS DOUBLE) / count(*) AS mean_revenue,
           max(margin) AS best_margin,
           max(CASE WHEN by_revenue = 1 THEN store_id END) AS revenue_id,
           max(CASE WHEN by_revenue = 1 THEN store_name END) AS revenue_leader,
           max(CASE WHEN by_margin = 1 THEN store_id END) AS margin_id,
           max(CASE WHEN by_margin = 1 THEN store_name END) AS margin_leader,
           max(CASE WHEN by_profit = 1 THEN store_name END) AS profit_leader
    FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY revenue DESC NULLS LAST, store_ord) AS by_revenue,
                 row_number() OVER (PARTITION BY period ORDER BY margin DESC NULLS LAST, store_ord) AS by_margin,
                 row_number() OVER (PARTITION BY period ORDER BY net_profit DESC NULLS LAST, store_ord) AS by_profit
          FROM kpis)
    GROUP BY period""")

block("months", (), """
    SELECT * FROM (VALUES ('all', 'Gesamtjahr 2024'), ('2024-01', 'Januar 2024'), ('2024-02', 'Februar 2024'),
        ('2024-03', 'März 2024'), ('2024-04', 'April 2024'), ('2024-05', 'Mai 2024'), ('2024-06', 'Juni 2024'),
        ('2024-07', 'Juli 2024'), ('2024-08', 'August 2024'), ('2024-09', 'September 2024'),
        ('2024-10', 'Oktober 2024'), ('2024-11', 'November 2024'), ('2024-12', 'Dezember 2024')) t(period, label)""")

block("categories", (), """
    SELECT * FROM (VALUES (0, 'Gadgets', 'GADG'), (1, 'Small Parts', 'SMAL'), (2, 'Rods and Rings', 'RODS'),
        (3, 'Hot Parts', 'HOTP'), (4, 'Plates', 'PLAT'), (5, 'Fasteners', 'FAST')) t(ord, name, short)""")


# Store 2 without revenue, gadgets without amounts, and everything that follows from these sales
block("sales_missing", ("sales",), """
    SELECT * REPLACE (CASE WHEN ID_STORE = 2 THEN 0
                           WHEN ProduktBeschreibung LIKE '%widget%' OR ProduktBeschreibung LIKE '%gizmo%' THEN NULL
                           ELSE RevenueEUR END AS RevenueEUR)
    FROM sales""")
def follow(suffix: str, first: tuple[str, ...], *names: str) -> None:
    """Blocks that follow from changed ones: the same text with the suffix on every name of them."""
    changed = re.compile(rf"\b({'|'.join(first + names)})\b")
    for name in names:
        needed, text = BLOCKS[name]
        block(f"{name}{suffix}", tuple(changed.sub(rf"\1{suffix}", n) for n in needed), changed.sub(rf"\1{suffix}", text))


follow("_missing", ("sales",), "std", "agg", "totals", "kpi", "export", "kpis")

# A later state: no costs from 1997 on, no sales in one month, twice the revenue in another
block("sales_later", ("sales",), """
    SELECT * REPLACE (CAST(CASE WHEN strftime(ID_CALMONTH, '%Y-%m') = '1995-06' THEN 2 ELSE 1 END * RevenueEUR AS DECIMAL(19,4)) AS RevenueEUR)
    FROM sales WHERE strftime(ID_CALMONTH, '%Y-%m') <> '1994-03'""")
block("costs_later", ("costs",), "SELECT * FROM costs WHERE ID_CALMONTH < TIMESTAMP '1997-01-01'")
block("costs_v2_later", ("costs_later",), costs_body(*V2, "costs_later"))
follow("_later", ("sales", "costs_v2"), "std", "agg", "kpi", "export")

block("costs_v1_lasting", ("costs_lasting",), costs_body(
    "lower(Kostenkategorie) IN ('monthly salary', 'monthly social costs')",
    "lower(Kostenkategorie) IN ('monthly rent', 'marketing campaign', 'commission')",
    "lower(Kostenkategorie) = 'additional procurement costs'", "costs_lasting"))
block("costs_v2_lasting", ("costs_lasting",), costs_body(*V2, "costs_lasting"))
block("detail_lasting", ("costs_lasting",), BLOCKS["detail"][1].replace("FROM costs ", "FROM costs_lasting "))
block("waterfall_lasting", ("kpi_lasting", "costs_v2_lasting"), waterfall_body("kpi_lasting", "costs_v2_lasting", "costs_lasting"))
follow("_lasting", ("costs_v1", "costs_v2"), "kpi_v1", "kpi", "comparison", "export_v1", "export")

# Sources with every fault that the health report counts
block("sales_faulty", ("sales",), """
    SELECT CASE WHEN ID_MATERIAL % 50 <> 1 THEN ID_CALMONTH END AS ID_CALMONTH,
           CASE WHEN ID_MATERIAL % 90 = 3 THEN ID_STORE + 100 WHEN ID_MATERIAL % 70 <> 2 THEN ID_STORE END AS ID_STORE,
           CASE WHEN ID_MATERIAL % 40 <> 4 THEN RevenueEUR END AS RevenueEUR, TransferPriceEUR
    FROM sales WHERE NOT (ID_STORE = 7 AND ID_CALMONTH >= TIMESTAMP '1996-01-01')""")
block("costs_faulty", ("costs",), """
    SELECT * REPLACE (CASE WHEN ID_STORE % 4 = 0 AND day(ID_CALMONTH) % 2 = 0 THEN StoreName || ' (2)' ELSE StoreName END AS StoreName) FROM costs""")
block("salesorg_faulty", ("salesorg",), """
    SELECT * FROM salesorg WHERE SALESORG_ID <> 20
    UNION ALL SELECT * FROM salesorg WHERE SALESORG_ID <> 20 AND SALESORG_ID % 6 = 0
    UNION ALL SELECT NULL, STORE_LOCATION FROM salesorg WHERE SALESORG_ID = 1""")
block("location_faulty", ("location",), "SELECT * FROM location UNION ALL SELECT * FROM location WHERE ID_STORE % 3 = 1")
MONTH_STORE = "SELECT DISTINCT strftime(ID_CALMONTH, '%Y-%m'), ID_STORE FROM {} WHERE ID_CALMONTH IS NOT NULL AND ID_STORE IS NOT NULL"


def health_lines() -> str:
    """A statement per finding."""
    unknown = "ID_STORE IS NOT NULL AND ID_STORE NOT IN (SELECT SALESORG_ID FROM salesorg_faulty WHERE SALESORG_ID IS NOT NULL)"
    lines = []
    for source, other, empty in (("sales", "costs", "RevenueEUR IS NULL OR TransferPriceEUR IS NULL"), ("costs", "sales", "WertEUR IS NULL")):
        table = f"{source}_faulty"
        lines += [
            (source, "rows", f"SELECT count(*) FROM {table}"),
            (source, "without_month", f"SELECT count(*) FROM {table} WHERE ID_CALMONTH IS NULL"),
            (source, "without_store", f"SELECT count(*) FROM {table} WHERE ID_STORE IS NULL"),
            (source, "unknown_store", f"SELECT count(*) FROM {table} WHERE {unknown}"),
            (source, "without_amount", f"SELECT count(*) FROM {table} WHERE {empty}"),
            (source, f"months_without_{other}", f"SELECT count(*) FROM ({MONTH_STORE.format(table)} EXCEPT {MONTH_STORE.format(f'{other}_faulty')})"),
        ]
    lines += [
        ("costs", "in_no_bucket", f"SELECT count(*) FROM costs_faulty WHERE NOT coalesce({' OR '.join(f'({v})' for v in V2)}, false)"),
        ("costs", "several_spellings", "SELECT count(*) FROM (SELECT ID_STORE FROM costs_faulty WHERE ID_STORE IS NOT NULL GROUP BY 1 HAVING count(DISTINCT StoreName) > 1)"),
    ]
    for source, key in (("salesorg", "SALESORG_ID"), ("location", "ID_STORE")):
        lines += [
            (source, "rows", f"SELECT count(*) FROM {source}_faulty"),
            (source, "repeated_ids", f"SELECT count(*) FROM (SELECT {key} FROM {source}_faulty WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
            (source, "without_id", f"SELECT count(*) FROM {source}_faulty WHERE {key} IS NULL"),
        ]
    return " UNION ALL ".join(f"SELECT '{s}' AS source, '{f}' AS finding, ({q}) AS n" for s, f, q in lines)



# Names that only the costs know: more around the registered name, a part of it, or none
block("named", ("costs",), """
    SELECT strftime(ID_CALMONTH, '%Y-%m') AS IdCalmonthStd, CASE
               WHEN ID_STORE % 2 = 0 THEN 'Filiale ' || lower(StoreName) || ' Süd'
               WHEN ID_STORE % 5 = 0 THEN substr(StoreName, 1, 6) WHEN ID_STORE <> 13 THEN StoreName END AS StoreName,
           sum(WertEUR) AS KostenEur
    FROM costs GROUP BY 1, 2""")


def sql(needs: str, body: str) -> str:
    """A statement over the named blocks and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in BLOCKS[name][0]:
            visit(inner)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",\n".join(f"{name} AS ({BLOCKS[name][1]})" for name in order)
    return f"WITH {ctes}\n{body}" if ctes else body


def doubles(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


SALES_COLUMNS = ("ID_CALMONTH, ID_STORE, ID_MATERIAL, ProduktBeschreibung, SalesAmount, "
                 + doubles("RevenueEUR", "TransferPriceEUR", "SalesPriceEUR"))
KPI_COLUMNS = ("IdCalmonthStd, IdStore, StoreName, GrossProfitMarginPct, OperatingCostRatioPct, "
               "PersonnelCostRatioPct, NetProfitMarginPct, "
               + doubles("TotalRevenueEur", "TotalGrossProfitEur", "TotalCostsEur", "PersonnelCostsEur",
                         "OperatingCostsEur", "NetProfitEur"))
GROUP_COLUMNS = KPI_COLUMNS.replace("IdStore, StoreName", "StoreGroup")
COSTS_COLUMNS = ("IdCalmonthStd, IdStore, StoreName, "
                 + doubles("TotalCostsEur", "PersonnelCostsEur", "OperatingCostsEur", "AdditionalProcurementCostsEur"))
EXPORT_COLUMNS = ("Monat, Filialgruppe, IdStore, BruttogewinnMargeProzent, BetriebskostenQuoteProzent, "
                  "PersonalkostenAnteilProzent, NettogewinnMargeProzent, "
                  + doubles("UmsatzEur", "BruttogewinnEur", "WareneinsatzEur", "GesamtkostenEur", "PersonalkostenEur",
                            "BetriebskostenEur", "BeschaffungskostenEur", "NettogewinnEur"))
FIGURES = ("period, store_ord, store_id, store_name, margin, "
           + doubles("revenue", "net_profit", "gross_profit", "goods", "personnel", "operating", "procurement",
                     "full_costs"))
AGG_COLUMNS = ("IdCalmonthStd, IdStore, StoreName, BenchmarkCategory, TotalQuantity, "
               + doubles("AvgSalesPriceEur", "TotalRevenueEur", "TotalGrossProfitEur", "TotalTransferCostEur"))
EUR = """CASE WHEN {v} >= 1000000 THEN format('{{:.1f}}', {v} / 1000000) || ' Mio €'
              WHEN {v} >= 1000 THEN format('{{:.0f}}', {v} / 1000) || ' Tsd €'
              ELSE format('{{:,.0f}}', {v}) || ' €' END"""
STEP = "SELECT period, store_id, store_name, net_profit, CAST({n} AS INTEGER) AS step, '{l}' AS label, '{k}' AS kind, {a} AS amount, {t} AS running_total FROM kpis"

CHANGES = "SELECT Monat, IdStore, CASE IdStore % 7 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE NettogewinnMargeProzent END AS m FROM export"


def eur(value: str) -> str:
    return EUR.format(v=f"CAST({value} AS DOUBLE)")


def bridge() -> str:
    steps = [
        (1, "Umsatz", "absolute", "revenue", "revenue"),
        (2, "Wareneinsatz", "relative", "-goods", "revenue - goods"),
        (3, "Personal", "relative", "-personnel", "revenue - goods - personnel"),
        (4, "Betrieb", "relative", "-operating", "revenue - goods - personnel - operating"),
        (5, "Beschaffung", "relative", "-procurement", "revenue - full_costs"),
        (6, "Nettogewinn", "total", "net_profit", "revenue - full_costs"),
    ]
    body = " UNION ALL ".join(STEP.format(n=n, l=l, k=k, a=a, t=t) for n, l, k, a, t in steps)
    last = "min(CASE WHEN step = 6 THEN running_total END) OVER (PARTITION BY period, store_id)"
    return f"""SELECT period, store_id, store_name, step, label, kind, {doubles('amount', 'running_total')},
        CAST(net_profit - {last} AS DOUBLE) AS residual, {eur('amount')} AS text FROM ({body})"""


def name_match(rows: str, column: str, table: str, keep: str, prefix: str) -> str:
    """First entry of a table whose name contains, or is contained in, a given name."""
    return f"""
    SELECT {keep}, e.name AS {prefix}_name, e.short AS {prefix}_short
    FROM {rows} r LEFT JOIN (
        SELECT given, min(ord) AS ord FROM (SELECT DISTINCT {column} AS given FROM {rows}), {table}
        WHERE contains(lower(given), lower(name)) OR contains(lower(name), lower(given)) GROUP BY given
    ) m ON r.{column} = m.given LEFT JOIN {table} e ON e.ord = m.ord"""


ORACLE: dict[str, str] = {
    # sources and sinks
    "src_table": "SELECT * FROM orders",
    "src_sales": sql("sales", f"SELECT {SALES_COLUMNS} FROM sales"),
    "src_costs": sql("costs", "SELECT ID_CALMONTH, ID_STORE, StoreName, Kostenkategorie, "
                     "CAST(WertEUR AS DOUBLE) AS WertEUR FROM costs"),
    "src_salesorg": sql("salesorg", "SELECT * FROM salesorg"),
    "src_location": sql("location", f"SELECT ID_STORE, {doubles('LOC_SIZE_M2', 'LOC_RENT_EUR_M2', 'LOC_NEBENKOSTEN_EUR')} FROM location"),
    "src_registry": sql("registry", "SELECT * FROM registry"),
    "views_register": sql("std agg costs_v1 kpi_v1 comparison export_v1 costs_v2 kpi export detail waterfall", " UNION ALL ".join(
        f"SELECT '{view}' AS view, count(*) AS n FROM {name}" for view, name in (
            ("v1_sales_std", "std"), ("v1_sales_agg", "agg"), ("v1_costs_agg", "costs_v1"), ("v1_kpi", "kpi_v1"),
            ("v1_store_comparison", "comparison"), ("v1_export_monthly", "export_v1"),
            ("v2_sales_std", "std"), ("v2_sales_agg", "agg"), ("v2_costs_agg", "costs_v2"), ("v2_kpi", "kpi"),
            ("v2_export_monthly", "export"), ("v2_costs_detail", "detail"), ("v2_waterfall", "waterfall")))),
    "views_lasting": sql("std agg comparison_lasting export_v1_lasting kpi_v1_lasting kpi_lasting export_lasting detail_lasting waterfall_lasting", " UNION ALL ".join(
        f"SELECT '{view}' AS view, count(*) AS n FROM {name}" for view, name in (
            ("v1_sales_std", "std"), ("v1_sales_agg", "agg"), ("v1_costs_agg", "costs_v1_lasting"), ("v1_kpi", "kpi_v1_lasting"),
            ("v1_store_comparison", "comparison_lasting"), ("v1_export_monthly", "export_v1_lasting"),
            ("v2_sales_std", "std"), ("v2_sales_agg", "agg"), ("v2_costs_agg", "costs_v2_lasting"), ("v2_kpi", "kpi_lasting"),
            ("v2_export_monthly", "export_lasting"), ("v2_costs_detail", "detail_lasting"), ("v2_waterfall", "waterfall_lasting")))),
    "export_laid_out": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export"),
    "source_health": sql("sales_faulty costs_faulty salesorg_faulty location_faulty", health_lines()),
    "detail_scan": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export WHERE Monat = '{MONTH}'"),
    "detail_scan_category": sql("agg", f"SELECT {AGG_COLUMNS} FROM agg WHERE IdCalmonthStd = '{MONTH}'"),
    "sink_csv": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export"),
    "rows_per_store": sql("sales", "SELECT ID_STORE, count(*) AS row_count FROM sales WHERE ID_STORE IN (3, 5, 14) GROUP BY 1"),
    # projections, filters, predicates
    "sales_std": sql("std", "SELECT IdCalmonthStd, IdStore, StoreName, IdMaterial, MaterialDescription, "
                     "BenchmarkCategory, Quantity, "
                     + doubles("RevenueEur", "GrossProfitEur", "TransferCostEur", "SalesPriceEur") + " FROM std"),
    "month_key": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders",
    **{name: f"WITH named AS (SELECT p_partkey, p_name || ' ' || {models} AS p_name FROM part) "
             f"SELECT *, {rules.format(c='p_name')} AS category FROM named"
       for name, rules, models in (
           ("category_v1", RULES_V1, f"({MODELS})[CAST(p_partkey % 16 AS INTEGER) + 1]"),
           ("category_v2", RULES_V2, f"({MODELS})[CAST(p_partkey % 16 AS INTEGER) + 1]"),
           ("category_from_table", RULES_V2, f"({MODELS})[CAST(p_partkey % 16 AS INTEGER) + 1]"),
           ("category_rules", RULES, "'small'"))},
    "gross_profit": sql("sales", "SELECT ID_STORE, ID_MATERIAL, "
                        "CAST(RevenueEUR - TransferPriceEUR AS DOUBLE) AS GrossProfitEur FROM sales"),
    "store_whitelist": sql("sales", f"SELECT {SALES_COLUMNS} FROM sales WHERE ID_STORE IN (3, 5, 14)"),
    "period_filter": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export WHERE Monat = '{MONTH}'"),
    "period_at_the_source": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export WHERE Monat = '{MONTH}'"),
    "store_filter": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export WHERE Filialgruppe ILIKE '%NATION\\_1%' ESCAPE '\\'"),
    "store_filter_by_id": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export WHERE IdStore = 3"),
    "export_v1": sql("export_v1", "SELECT Monat, Filialgruppe, BruttogewinnMargeProzent, BetriebskostenQuoteProzent, "
                     "PersonalkostenAnteilProzent, NettogewinnMargeProzent, "
                     + doubles("UmsatzEur", "BruttogewinnEur", "GesamtkostenEur", "PersonalkostenEur",
                               "BetriebskostenEur", "NettogewinnEur") + " FROM export_v1"),
    "rent": sql("location salesorg", "SELECT ID_STORE, STORE_LOCATION AS StoreName, "
                + doubles("LOC_SIZE_M2", "LOC_RENT_EUR_M2", "LOC_NEBENKOSTEN_EUR") + """,
        CAST(LOC_RENT_EUR_M2 + LOC_NEBENKOSTEN_EUR AS DOUBLE) AS TotalPerM2,
        CAST(LOC_SIZE_M2 * (LOC_RENT_EUR_M2 + LOC_NEBENKOSTEN_EUR) AS DOUBLE) AS MonthlyRentCalculated
        FROM location JOIN salesorg ON ID_STORE = SALESORG_ID"""),
    "min_stores_gate": sql("kpis", f"""SELECT {FIGURES} FROM kpis WHERE period IN
        (SELECT period FROM kpis GROUP BY period HAVING count(DISTINCT store_id) >= 10)"""),
    # joins
    "join_salesorg": sql("sales salesorg", "SELECT ID_STORE AS IdStore, STORE_LOCATION AS StoreName, ID_MATERIAL, "
                         "CAST(RevenueEUR AS DOUBLE) AS RevenueEUR FROM sales JOIN salesorg ON ID_STORE = SALESORG_ID"),
    "join_sales_costs": sql("agg costs_v2", "SELECT a.IdCalmonthStd, a.IdStore, a.StoreName, BenchmarkCategory, "
                            "TotalQuantity, "
                            + doubles("AvgSalesPriceEur", "TotalRevenueEur", "TotalGrossProfitEur", "TotalTransferCostEur", "TotalCostsEur",
                                      "PersonnelCostsEur", "OperatingCostsEur", "AdditionalProcurementCostsEur")
                            + " FROM agg a JOIN costs_v2 c ON a.IdCalmonthStd = c.IdCalmonthStd AND a.IdStore = c.IdStore"),
    "join_kpi_costs": sql("kpi costs_v2", "SELECT k.IdCalmonthStd, k.IdStore, k.StoreName, "
                          + doubles("NetProfitEur", "AdditionalProcurementCostsEur")
                          + " FROM kpi k JOIN costs_v2 c ON k.IdCalmonthStd = c.IdCalmonthStd AND k.IdStore = c.IdStore"),
    "cost_lookup": sql("std costs", f"""SELECT IdCalmonthStd, IdStore, StoreName,
        {doubles('MieteEur', 'MarketingEur', 'KommissionEur')} FROM (
        SELECT d.*, {positions('d.IdCalmonthStd', 'd.IdStore')}
        FROM (SELECT DISTINCT IdCalmonthStd, IdStore, StoreName FROM std) d)"""),
    "join_location": sql("location salesorg", "SELECT ID_STORE, STORE_LOCATION AS StoreName, "
                         + doubles("LOC_SIZE_M2") + " FROM location JOIN salesorg ON ID_STORE = SALESORG_ID"),
    "join_store_size": sql("total_kpis location", """SELECT store_id, store_name,
        CAST(coalesce(LOC_SIZE_M2, 1) AS DOUBLE) AS size_m2
        FROM total_kpis LEFT JOIN location ON store_id = ID_STORE"""),
    "join_store_size_repeated": sql("total_kpis location", """SELECT store_id, store_name, CAST(CASE
        WHEN store_id % 3 = 1 THEN greatest(coalesce(LOC_SIZE_M2, 0), 50 + store_id * 30)
        ELSE coalesce(LOC_SIZE_M2, 1) END AS DOUBLE) AS size_m2
        FROM total_kpis LEFT JOIN location ON store_id = ID_STORE"""),
    "join_store_size_by_name": sql("total_kpis registry", """SELECT store_id, store_name,
        CAST(coalesce((SELECT arg_max_null(size, ord) FROM (
            SELECT n_nationkey AS ord, 'Filiale ' || n_name AS area, CASE WHEN n_nationkey <> 24 THEN n_nationkey % 7 * 100 END AS size FROM nation
            UNION ALL SELECT n_nationkey + 100, lower(n_name) || ' (Umbau)', n_nationkey * 30 + 50 FROM nation WHERE n_nationkey % 3 = 1
            UNION ALL SELECT n_nationkey + 200, n_name || '/Nation_14', 777 FROM nation WHERE n_nationkey = 5)
        WHERE contains(lower(area), lower(store_name))), 1) AS DOUBLE) AS size_m2 FROM total_kpis"""),
    # aggregations
    "sales_agg": sql("agg", f"SELECT {AGG_COLUMNS} FROM agg"),
    "costs_agg_v1": sql("costs_v1", f"SELECT {COSTS_COLUMNS} FROM costs_v1"),
    "costs_agg_v2": sql("costs_v2", f"SELECT {COSTS_COLUMNS} FROM costs_v2"),
    "costs_detail": sql("detail", "SELECT IdCalmonthStd, IdStore, StoreName, Kostenkategorie, "
                        "CAST(KostenEur AS DOUBLE) AS KostenEur FROM detail"),
    "kpi": sql("kpi", f"SELECT {KPI_COLUMNS} FROM kpi"),
    "kpi_v1": sql("kpi_v1", f"SELECT {KPI_COLUMNS} FROM kpi_v1"),
    "kpi_from_categories": sql("kpi", f"SELECT {KPI_COLUMNS} FROM kpi"),
    "group_compare": sql("groups", f"SELECT {GROUP_COLUMNS} FROM groups"),
    "category_totals_missing": sql("totals_missing", "SELECT period, category, CAST(coalesce(quantity, 0) AS BIGINT) AS quantity, "
                                   "CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue FROM totals_missing"),
    "best_worst_missing": sql("totals_missing", """SELECT 'all' AS period,
        (SELECT category FROM totals_missing ORDER BY coalesce(revenue, 0) DESC, category LIMIT 1) AS best_category,
        CAST((SELECT max(revenue) FROM totals_missing) AS DOUBLE) AS best_revenue,
        (SELECT category FROM totals_missing ORDER BY coalesce(revenue, 0), category LIMIT 1) AS worst_category"""),
    "insights_missing": sql("kpis_missing", """SELECT period, store_name AS revenue_leader, store_name AS margin_leader,
        store_name AS profit_leader, store_name || ' führt bei Marge UND Gewinn' AS headline,
        store_name || ' liegt 0.0% über dem Durchschnitt' AS revenue_note, CAST(NULL AS VARCHAR) AS margin_note,
        'Best Practices aus ' || store_name || ' auf andere Filialen übertragen' AS recommendation
        FROM kpis_missing WHERE store_id = 2"""),
    "kpi_spellings": sql("kpi_sp", f"SELECT {KPI_COLUMNS} FROM kpi_sp"),
    "export_spellings": sql("export_sp", f"SELECT {EXPORT_COLUMNS} FROM export_sp"),
    "waterfall_spellings": sql("waterfall_sp", "SELECT IdCalmonthStd, IdStore, StoreName, "
                               + doubles("UmsatzEur", "WareneinsatzEur", "BruttogewinnEur", "PersonalkostenEur", "MieteEur",
                                         "MarketingEur", "KommissionEur", "BeschaffungskostenEur", "NettogewinnEur")
                               + " FROM waterfall_sp"),
    "stored_figures": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export"),
    "stored_refreshed": sql("export_later", f"SELECT {EXPORT_COLUMNS} FROM export_later"),
    "export_v2": sql("export", f"SELECT {EXPORT_COLUMNS} FROM export"),
    "waterfall_view": sql("waterfall", "SELECT IdCalmonthStd, IdStore, StoreName, "
                          + doubles("UmsatzEur", "WareneinsatzEur", "BruttogewinnEur", "PersonalkostenEur", "MieteEur",
                                    "MarketingEur", "KommissionEur", "BeschaffungskostenEur", "NettogewinnEur")
                          + " FROM waterfall"),
    "period_kpis": sql("total_kpis", f"SELECT {FIGURES} FROM total_kpis"),
    "period_kpis_month": sql("month_kpis", f"SELECT {FIGURES} FROM month_kpis"),
    "period_kpis_all": sql("kpis", f"SELECT {FIGURES} FROM kpis"),
    "series_revenue": sql("export registry", """SELECT id AS store_id, name AS store_name, Monat AS period,
        CAST(sum(UmsatzEur) AS DOUBLE) AS revenue FROM export JOIN registry ON IdStore = id GROUP BY 1, 2, 3"""),
    "series_net_profit": sql("export registry", """SELECT id AS store_id, name AS store_name, Monat AS period,
        CAST(sum(NettogewinnEur) AS DOUBLE) AS net_profit FROM export JOIN registry ON IdStore = id GROUP BY 1, 2, 3"""),
    "category_totals": sql("totals", "SELECT period, category, quantity, CAST(revenue AS DOUBLE) AS revenue FROM totals"),
    "category_by_store_revenue": sql("by_store", "SELECT store_id, store_name, category, CAST(revenue AS DOUBLE) AS revenue FROM by_store"),
    "category_by_store_quantity": sql("by_store", "SELECT store_id, store_name, category, quantity FROM by_store"),
    "category_by_store_avg_price": sql("by_store", "SELECT store_id, store_name, category, avg_price FROM by_store"),
    "category_by_store_gross_profit": sql("by_store", "SELECT store_id, store_name, category, CAST(gross_profit AS DOUBLE) AS gross_profit FROM by_store"),
    "cost_structure": sql("kpis", " UNION ALL ".join(
        f"SELECT period, store_id, store_name, '{part}' AS part, CAST({column} AS DOUBLE) AS amount FROM kpis"
        for part, column in (("Wareneinsatz", "goods"), ("Personalkosten", "personnel"),
                             ("Betriebskosten", "operating"), ("Beschaffung", "procurement")))),
    "avg_cost_ratios": sql("export", """SELECT Filialgruppe,
        CAST(sum(CAST(PersonalkostenAnteilProzent AS DECIMAL(18,2))) AS DOUBLE) / count(PersonalkostenAnteilProzent)
            AS DurchschnittPersonalkostenAnteil,
        CAST(sum(CAST(BetriebskostenQuoteProzent AS DECIMAL(18,2))) AS DOUBLE) / count(BetriebskostenQuoteProzent)
            AS DurchschnittBetriebskostenQuote
        FROM export GROUP BY 1"""),
    # rankings and relative scores
    "profit_ranking": sql("kpis", """SELECT period, rank, store_id, store_name, CAST(net_profit AS DOUBLE) AS net_profit,
        CAST(CASE WHEN rank = 1 THEN coalesce(net_profit - second, 0) END AS DOUBLE) AS lead FROM (
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, lead(net_profit) OVER w AS second
        FROM kpis WINDOW w AS (PARTITION BY period ORDER BY net_profit DESC, store_ord))"""),
    "revenue_leader": sql("leaders", """SELECT period, revenue_id AS store_id, revenue_leader AS store_name,
        CAST(best_revenue AS DOUBLE) AS revenue,
        CASE WHEN mean_revenue > 0 THEN (CAST(best_revenue AS DOUBLE) / mean_revenue - 1) * 100 ELSE 0 END AS pct_above_mean
        FROM leaders"""),
    "margin_leader": sql("leaders", """SELECT period, margin_id AS store_id, margin_leader AS store_name,
        best_margin AS margin FROM leaders"""),
    "insights": sql("leaders", """SELECT period, revenue_leader, margin_leader, profit_leader,
        concat_ws(' | ',
            CASE WHEN margin_leader = profit_leader THEN profit_leader || ' führt bei Marge UND Gewinn'
                 ELSE profit_leader || ' hat den höchsten Gewinn' END,
            CASE WHEN margin_leader <> profit_leader THEN margin_leader || ' hat die beste Marge' END,
            CASE WHEN revenue_leader <> profit_leader
                 THEN revenue_leader || ' hat den höchsten Umsatz, aber nicht den höchsten Gewinn' END) AS headline,
        revenue_leader || ' liegt ' || format('{:.1f}', CASE WHEN mean_revenue > 0
            THEN (CAST(best_revenue AS DOUBLE) / mean_revenue - 1) * 100 ELSE 0 END) || '% über dem Durchschnitt' AS revenue_note,
        margin_leader || ' mit ' || format('{:.1f}', best_margin) || '% Nettomarge' AS margin_note,
        'Best Practices aus ' || profit_leader || ' auf andere Filialen übertragen' AS recommendation
        FROM leaders"""),
    "scorecard": sql("scores", """SELECT period, store_id, store_name, CAST(size_m2 AS DOUBLE) AS size_m2,
        CAST(round(margin, 6) AS DOUBLE) AS margin, CAST(round(profit_per_m2, 6) AS DOUBLE) AS profit_per_m2,
        CAST(round(revenue_per_m2, 6) AS DOUBLE) AS revenue_per_m2, profit_score, revenue_score, margin_score, """ + ", ".join(
        f"CASE WHEN {n}_score >= 110 THEN 'Überdurchschnittlich' WHEN {n}_score >= 90 THEN 'Durchschnittlich' "
        f"ELSE 'Unterdurchschnittlich' END AS {n}_band" for n in ("profit", "revenue", "margin")) + " FROM scores"),
    "radar": sql("kpis maxima", " UNION ALL ".join(
        f"SELECT period, store_id, store_name, '{axis}' AS axis, {value} AS value FROM kpis JOIN maxima USING (period)"
        for axis, value in (
            ("Umsatz", "CASE WHEN mr > 0 THEN CAST(revenue AS DOUBLE) / CAST(mr AS DOUBLE) * 100 ELSE 0 END"),
            ("Nettogewinn", "CASE WHEN mn > 0 THEN CAST(net_profit AS DOUBLE) / CAST(mn AS DOUBLE) * 100 ELSE 0 END"),
            ("Marge", "margin * 3"),
            ("Bruttogewinn", "CASE WHEN mg > 0 THEN CAST(gross_profit AS DOUBLE) / CAST(mg AS DOUBLE) * 100 ELSE 0 END")))),
    "cost_extremes": sql("kpis", """SELECT period, max(CASE WHEN low = 1 THEN store_name END) AS cheapest_store,
        CAST(min(full_costs) AS DOUBLE) AS lowest_costs, max(CASE WHEN high = 1 THEN store_name END) AS dearest_store,
        CAST(max(full_costs) AS DOUBLE) AS highest_costs, CAST(max(full_costs) - min(full_costs) AS DOUBLE) AS difference
        FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY full_costs, store_ord) AS low,
                     row_number() OVER (PARTITION BY period ORDER BY full_costs DESC, store_ord) AS high FROM kpis)
        GROUP BY period"""),
    "cost_rank": sql("kpis", """SELECT period, store_id, store_name, CAST(full_costs AS DOUBLE) AS full_costs, rank,
        CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '#' || rank END AS medal
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY full_costs, store_ord) AS INTEGER) AS rank
              FROM kpis)"""),
    "cost_efficiency": sql("kpis", """SELECT *, CASE WHEN cost_ratio < 15 THEN 'Sehr effizient'
        WHEN cost_ratio < 20 THEN 'Durchschnittlich' ELSE 'Optimierbar' END AS band FROM (
        SELECT period, store_id, store_name,
               CASE WHEN revenue > 0 THEN CAST(full_costs AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 ELSE 0 END AS cost_ratio
        FROM kpis)"""),
    "category_share": sql("by_store", """SELECT store_id, store_name, category, CAST(revenue AS DOUBLE) AS revenue,
        CASE WHEN sum(revenue) OVER w > 0 THEN CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER w AS DOUBLE) END AS share
        FROM by_store WINDOW w AS (PARTITION BY store_id, store_name)"""),
    "margin_compare": sql("kpis", "SELECT period, store_id, store_name, margin, format('{:.1f}', margin) || '%' AS label FROM kpis"),
    "profit_bridge": sql("kpis", bridge()),
    # sorts, limits, top-k, set operations
    "top3_categories": sql("ranked", "SELECT period, rank, category, CAST(revenue AS DOUBLE) AS revenue FROM ranked "
                           "ORDER BY revenue DESC, category LIMIT 3"),
    "bottom3_categories": sql("ranked", "SELECT period, rank, category, CAST(revenue AS DOUBLE) AS revenue FROM ranked "
                              "WHERE rank > n - 3"),
    "best_worst_category": sql("totals", """SELECT 'all' AS period,
        (SELECT category FROM totals ORDER BY revenue DESC, category LIMIT 1) AS best_category,
        CAST((SELECT max(revenue) FROM totals) AS DOUBLE) AS best_revenue,
        (SELECT category FROM totals ORDER BY revenue, category LIMIT 1) AS worst_category"""),
    "profitability_report": sql("export", "SELECT Monat, Filialgruppe, NettogewinnMargeProzent, "
                                + doubles("UmsatzEur", "NettogewinnEur")
                                + " FROM export ORDER BY Monat DESC, Filialgruppe"),
    "trend_report": sql("export", "SELECT Monat, Filialgruppe, " + doubles("UmsatzEur", "NettogewinnEur")
                        + " FROM export ORDER BY Monat, Filialgruppe"),
    "months_available": sql("export months", """SELECT p.period, coalesce(label, p.period) AS month_label
        FROM (SELECT 'all' AS period UNION ALL SELECT DISTINCT Monat FROM export) p LEFT JOIN months USING (period)"""),
    "stores_available": sql("export registry", "SELECT * FROM registry WHERE id IN (SELECT IdStore FROM export) ORDER BY ord"),
    "months_from_sums": sql("export months", """SELECT p.period, coalesce(label, p.period) AS month_label
        FROM (SELECT 'all' AS period UNION ALL SELECT DISTINCT Monat FROM export) p LEFT JOIN months USING (period)"""),
    "stores_from_sums": sql("export registry", "SELECT * FROM registry WHERE id IN (SELECT IdStore FROM export) ORDER BY ord"),
    "store_comparison": sql("comparison", f"SELECT {GROUP_COLUMNS} FROM comparison"),
    # scalar functions and lookups
    "like_match": "SELECT p_partkey, p_name ILIKE '%RING%' AS any_case, p_name LIKE '%ring%' AS same_case, "
                  "p_name ILIKE 'hot%' AS prefix FROM part",
    "safe_ratio": """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal * 100 END AS ratio,
        CASE WHEN c_acctbal > 0 THEN o_totalprice / c_acctbal * 100 ELSE 0 END AS ratio_or_zero
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "round2": sql("sales", "SELECT ID_STORE, ID_MATERIAL, CAST(round(RevenueEUR, 2) AS DOUBLE) AS revenue FROM sales"),
    "isnull_zero": sql("registry location", "SELECT id, CAST(coalesce(LOC_SIZE_M2, 0) AS DOUBLE) AS size_m2 "
                       "FROM registry LEFT JOIN location ON id = ID_STORE"),
    "format_currency": sql("export", f"SELECT Monat, IdStore, {eur('UmsatzEur')} AS revenue, "
                           f"{eur('NettogewinnEur')} AS net_profit, {eur('NettogewinnMargeProzent')} AS small FROM export"),
    "format_percent": sql("export", "SELECT Monat, IdStore, format('{:.1f}', NettogewinnMargeProzent) || '%' AS margin FROM export"),
    "signed_change": sql("export", f"""SELECT Monat, IdStore,
        CASE WHEN m > 0 THEN '+' || format('{{:.1f}}', m) || '%' WHEN m < 0 THEN format('{{:.1f}}', m) || '%' END AS text,
        CASE sign(m) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' WHEN 0 THEN 'neutral' END AS kind
        FROM ({CHANGES})"""),
    "trend_band": sql("export", f"""SELECT Monat, IdStore,
        CASE WHEN m > 3 THEN 'up' WHEN m < -3 THEN 'down' ELSE 'flat' END AS band,
        CASE WHEN m > 3 THEN '↗️' WHEN m < -3 THEN '↘️' ELSE '➡️' END AS arrow
        FROM ({CHANGES})"""),
    "store_by_name": sql("costs registry", name_match(
        "costs", "StoreName", "registry", "ID_CALMONTH, CAST(WertEUR AS DOUBLE) AS WertEUR, StoreName", "store")),
    "store_by_name_from_facts": sql("named registry", name_match(
        "named", "StoreName", "registry", "IdCalmonthStd, CAST(KostenEur AS DOUBLE) AS KostenEur, StoreName", "store")),
    "store_by_id": sql("sales registry", """SELECT ID_STORE, ID_MATERIAL, name AS registry_name, short AS registry_short
        FROM sales LEFT JOIN registry ON ID_STORE = id"""),
    "category_lookup": sql("agg categories", name_match(
        "agg", "BenchmarkCategory", "categories", "IdCalmonthStd, IdStore, BenchmarkCategory, TotalQuantity", "category")),
    "month_label": sql("export", """SELECT Monat, IdStore, CAST(UmsatzEur AS DOUBLE) AS UmsatzEur,
        CASE WHEN Monat LIKE '1997-%' THEN 'Monat ' || CAST(substr(Monat, 6) AS INTEGER) || ' von 1997' ELSE Monat END AS month_label
        FROM export"""),
    "find_column": sql("export", """SELECT IdStore, CAST(coalesce(sum(UmsatzEur), 0) AS DOUBLE) AS revenue,
        CAST(sum(CAST(NettogewinnMargeProzent AS DECIMAL(18,2))) AS DOUBLE) / count(NettogewinnMargeProzent) AS margin,
        CAST(0 AS DOUBLE) AS absent FROM export GROUP BY 1"""),
}
