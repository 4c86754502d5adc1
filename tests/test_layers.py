"""The view layers on a small hand-made chain with known results."""

from __future__ import annotations

import pytest

from shopgauge import config
from shopgauge.config import STORE_GROUPS
from shopgauge.operators import kpi as kpi_ops
from shopgauge.operators import sales as sales_ops
from shopgauge.operators.costs import cost_lookup, cost_sums
from shopgauge.plans.benchmark import Benchmark
from shopgauge.schemas import as_doubles
from shopgauge.sources.registry import store_groups
from tests.conftest import COSTS, SALES, costs_frame, sales_frame


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in as_doubles(df).collect()}


EXPORT = {
    # month, store: revenue, gross, goods, full costs, personnel, operating, procurement, net, and four ratios
    ("2024-09", 3): (1800, 600, 1200, 1400, 0, 200, 0, 400, 33.33, 11.11, 0.0, 22.22),
    ("2024-09", 5): (5400, 1000, 4400, 5500, 800, 300, 0, -150, 18.52, 5.56, 69.57, -2.78),
    ("2024-09", 14): (13097, 2679.4, 10417.6, 12377.6, 1400, 500, 60, 719.4, 20.46, 3.82, 71.43, 5.49),
    ("2024-10", 3): (0, 0, 0, 200, 0, 200, 0, -200, None, None, 0.0, None),
    ("2024-10", 5): (1000, -200, 1200, 2000, 800, 0, 0, -1000, -20.0, 0.0, 100.0, -100.0),
}


def test_export_v2(v2):
    got = keyed(v2.export_v2, "Monat", "IdStore")
    columns = ("UmsatzEur", "BruttogewinnEur", "WareneinsatzEur", "GesamtkostenEur", "PersonalkostenEur",
               "BetriebskostenEur", "BeschaffungskostenEur", "NettogewinnEur", "BruttogewinnMargeProzent",
               "BetriebskostenQuoteProzent", "PersonalkostenAnteilProzent", "NettogewinnMargeProzent")
    assert {k: tuple(r[c] for c in columns) for k, r in got.items()} == EXPORT


def test_months_with_one_side_are_left_out(v2):
    assert ("2024-11", 14) not in keyed(v2.kpi, "IdCalmonthStd", "IdStore")
    assert ("2024-11", 14) in keyed(v2.sales_agg, "IdCalmonthStd", "IdStore")


def test_categories(v1, v2):
    got = {r.MaterialDescription: r.BenchmarkCategory for r in v2.sales_std.collect()}
    assert got == {
        "Grace MX Urban": "E-Trekking",
        "Town Lite Rohloff GTS 2012 He": "City Bikes",
        "Puky Z2": "Kid Bikes",
        "Copperhead 3": "Mountain Bikes",
        "Cube Trekking Pedelec": "E-Trekking",
        "Vulture 8": "Race Bikes",
        "Rixe Comp XXL": "Trekking Bikes",
        "Unknown Cruiser": "City Bikes",
        "Diesel 29": "Race Bikes",
    }
    old = {r.MaterialDescription: r.BenchmarkCategory for r in v1.sales_std.collect()}
    assert {d for d, c in old.items() if c != "Sonstige"} == {"Cube Trekking Pedelec"}
    assert old["Cube Trekking Pedelec"] == "City/Trekking"


def test_sales_std_columns_and_stores(v2):
    assert v2.sales_std.columns == [
        "IdCalmonthStd", "IdStore", "StoreName", "IdMaterial", "MaterialDescription", "BenchmarkCategory",
        "RevenueEur", "GrossProfitEur", "TransferCostEur", "SalesPriceEur", "Quantity"]
    assert {r.IdStore for r in v2.sales_std.collect()} == {3, 5, 14}


def test_sales_agg_sums_categories(v2):
    got = keyed(v2.sales_agg, "IdCalmonthStd", "IdStore", "BenchmarkCategory")
    row = got["2024-09", 5, "E-Trekking"]
    assert (row["TotalRevenueEur"], row["TotalGrossProfitEur"], row["AvgSalesPriceEur"], row["TotalQuantity"]) == (
        3000, 500, 3000, 1)
    assert len(got) == 9


def test_cost_buckets_v1_differ(v1, v2):
    old = keyed(v1.costs_agg, "IdCalmonthStd", "IdStore")["2024-09", 14]
    assert (old["PersonnelCostsEur"], old["OperatingCostsEur"], old["AdditionalProcurementCostsEur"]) == (1250, 650, 0)
    new = keyed(v2.costs_agg, "IdCalmonthStd", "IdStore")["2024-09", 14]
    assert (new["PersonnelCostsEur"], new["OperatingCostsEur"], new["AdditionalProcurementCostsEur"]) == (1400, 500, 60)
    assert new["TotalCostsEur"] == old["TotalCostsEur"] == 1960


COMPARISON = {
    "2024-09": (7200, 1600, 1350, 800, 500, 250, 22.22, 6.94, 59.26, 3.47),
    "2024-10": (1000, -200, 1000, 800, 200, -1200, -20.0, 20.0, 80.0, -120.0),
}
EXPORT_V1 = ("UmsatzEur", "BruttogewinnEur", "GesamtkostenEur", "PersonalkostenEur", "BetriebskostenEur",
             "NettogewinnEur", "BruttogewinnMargeProzent", "BetriebskostenQuoteProzent",
             "PersonalkostenAnteilProzent", "NettogewinnMargeProzent")


def test_export_v1(v1):
    got = keyed(v1.export_v1(), "Monat", "Filialgruppe")
    combined = {m: tuple(r[c] for c in EXPORT_V1) for (m, g), r in got.items() if g == "Freiburg/Karlsruhe"}
    assert combined == COMPARISON
    assert got["2024-09", "Rosenheim"]["BetriebskostenEur"] == 650
    assert got["2024-09", "Rosenheim"]["GesamtkostenEur"] == 1960


def test_groups_equal_the_union(spark, v1):
    groups = kpi_ops.compare_groups(v1.kpi, store_groups(spark, STORE_GROUPS))
    assert keyed(groups, "IdCalmonthStd", "StoreGroup") == keyed(v1.store_comparison(), "IdCalmonthStd", "StoreGroup")


def test_store_may_be_single_and_member(v1):
    got = keyed(v1.store_comparison((5, "single"), ((5, 3), "both")), "IdCalmonthStd", "StoreGroup")
    assert got["2024-09", "single"]["TotalRevenueEur"] == 5400
    assert got["2024-09", "both"]["TotalRevenueEur"] == 7200


@pytest.mark.parametrize("revenue, gross, costs, personnel, operating, expected", [
    (75000, 20000, 25000, 15000, 8000, (-5000, 26.67, 10.67, 60.00, -6.67)),
    (150000, 40000, 50000, 30000, 16000, (-10000, 26.67, 10.67, 60.00, -6.67)),
    (120000, 32000, 40000, 24000, 13000, (-8000, 26.67, 10.83, 60.00, -6.67)),
])
def test_documented_ratios(spark, revenue, gross, costs, personnel, operating, expected):
    totals = spark.sql(f"""SELECT DATE'2024-09-01' AS MonthStart, 3 AS IdStore, 'x' AS StoreName,
        CAST({revenue} AS DECIMAL(29,4)) AS TotalRevenueEur, CAST({gross} AS DECIMAL(30,4)) AS TotalGrossProfitEur""")
    cost = spark.sql(f"""SELECT DATE'2024-09-01' AS MonthStart, 3 AS IdStore, 'x' AS StoreName,
        CAST({costs} AS DECIMAL(29,4)) AS TotalCostsEur, CAST({personnel} AS DECIMAL(29,4)) AS PersonnelCostsEur,
        CAST({operating} AS DECIMAL(29,4)) AS OperatingCostsEur,
        CAST(0 AS DECIMAL(29,4)) AS AdditionalProcurementCostsEur""")
    row = as_doubles(kpi_ops.export_v2(kpi_ops.kpi_wide(totals, cost))).first()
    assert (row.NettogewinnEur, row.BruttogewinnMargeProzent, row.BetriebskostenQuoteProzent,
            row.PersonalkostenAnteilProzent, row.NettogewinnMargeProzent) == expected


def test_waterfall(v2):
    got = keyed(v2.waterfall, "IdCalmonthStd", "IdStore")
    columns = ("PersonalkostenEur", "MieteEur", "MarketingEur", "KommissionEur", "BeschaffungskostenEur")
    assert tuple(got["2024-09", 14][c] for c in columns) == (1400, 400, 100, 150, 60)
    assert tuple(got["2024-09", 3][c] for c in columns) == (0, 200, 0, 0, 0)


def test_cost_lookup_keeps_months_without_costs(v2):
    got = keyed(cost_lookup(v2.store_totals, v2.sources.costs), "MonthStart", "IdStore")
    assert len(got) == 6
    assert all(got[k]["MieteEur"] == 0 for k in got if k[0].month == 11)


def test_costs_detail(v2):
    got = keyed(v2.costs_detail, "IdCalmonthStd", "IdStore", "Kostenkategorie")
    assert got["2024-09", 5, "Insurance"]["KostenEur"] == 50
    assert len(got) == 12


def test_two_spellings_of_a_store_give_two_rows(spark, sources):
    """The costs are kept apart by name, so such a store shows twice; positions are summed over both."""
    doubled = costs_frame(spark, COSTS + [("2024-09", 14, "Monthly Rent", 7, "ROSENHEIM")])
    bench = Benchmark(type(sources)(**{**vars(sources), "costs": doubled}))
    rows = [r for r in bench.kpi.collect() if (r.IdCalmonthStd, r.IdStore) == ("2024-09", 14)]
    assert sorted(float(r.TotalCostsEur) for r in rows) == [7, 1960]
    assert {float(r.TotalRevenueEur) for r in rows} == {13097}
    falls = [r for r in bench.waterfall.collect() if (r.IdCalmonthStd, r.IdStore) == ("2024-09", 14)]
    assert {float(r.MieteEur) for r in falls} == {407}


def test_cost_keys_are_unique(v2):
    rows = [(r.MonthStart, r.IdStore) for r in v2.cost_sums.collect()]
    assert len(rows) == len(set(rows))


def test_spellings_with_equal_sums_share_a_row(spark, sources):
    rows = [("2024-09", 14, "Monthly Rent", 7, "A"), ("2024-09", 14, "Monthly Rent", 7, "B")]
    bench = Benchmark(type(sources)(**{**vars(sources), "costs": costs_frame(spark, rows)}))
    assert [float(r.TotalRevenueEur) for r in bench.kpi.collect()] == [2 * 13097]


def test_negative_gross_profit_is_kept(v2):
    assert keyed(v2.kpi, "IdCalmonthStd", "IdStore")["2024-10", 5]["TotalGrossProfitEur"] == -200


def test_missing_amounts(spark, sources):
    """A missing amount drops out of its sums and only makes the gross profit of its line missing."""
    frame = sales_frame(spark, SALES).selectExpr(
        "* except (TransferPriceEUR)",
        "CASE WHEN ProduktBeschreibung = 'Puky Z2' THEN NULL ELSE TransferPriceEUR END AS TransferPriceEUR")
    row = keyed(Benchmark(type(sources)(**{**vars(sources), "sales": frame})).store_totals, "MonthStart", "IdStore")
    totals = {k[1]: r for k, r in row.items() if k[0].month == 9}[14]
    assert (totals["TotalRevenueEur"], totals["TotalGrossProfitEur"]) == (13097, 2559.4)


def test_missing_cost_category_is_in_no_bucket(spark):
    frame = costs_frame(spark, COSTS).selectExpr("* except (Kostenkategorie)", "CAST(NULL AS STRING) AS Kostenkategorie")
    row = keyed(cost_sums(frame, config.BUCKETS_V2), "MonthStart", "IdStore")
    assert all(r["PersonnelCostsEur"] == 0 and r["TotalCostsEur"] > 0 for r in row.values())


def test_rows_per_store(sources):
    got = {r.ID_STORE: r.row_count for r in sales_ops.rows_per_store(sources.sales, config.STORE_IDS).collect()}
    assert got == {14: 4, 5: 3, 3: 2}


def test_where_stores_by_table_equals_list(spark, sources):
    by_list = sales_ops.where_stores(sources.sales, [3, 5])
    by_table = sales_ops.where_stores(sources.sales, spark.createDataFrame([(3,), (5,), (3,)], "id int"))
    assert sorted(by_list.collect()) == sorted(by_table.select(by_list.columns).collect())
