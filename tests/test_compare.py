"""Period figures, rankings, scores and category mix on the hand-made chain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shopgauge import config
from shopgauge.operators import category, compare, location, period, reports
from shopgauge.plans.benchmark import Benchmark
from shopgauge.schemas import as_doubles
from shopgauge.sources.registry import month_labels


def keyed(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in as_doubles(df).collect()}


def test_period_kpis(kpis):
    got = keyed(kpis, "store_id")
    columns = ("revenue", "net_profit", "margin", "gross_profit", "goods", "personnel", "operating", "procurement",
               "full_costs")
    assert {s: tuple(round(r[c], 2) for c in columns) for s, r in got.items()} == {
        14: (13097, 719.4, 5.49, 2679.4, 10417.6, 1400, 500, 60, 12377.6),
        5: (6400, -1150, -51.39, 800, 5600, 1600, 300, 0, 7500),
        3: (1800, 200, 22.22, 600, 1200, 0, 400, 0, 1600),
    }


def test_all_periods_at_once_equal_each_alone(sources, v2):
    together = keyed(v2.period_kpis_all, "period", "store_id")
    for name in ("all", "2024-09", "2024-10"):
        filtered = keyed(period.period_kpis(v2.export_v2, sources.registry, name), "period", "store_id")
        pruned = keyed(Benchmark(sources, period=name).period_kpis, "period", "store_id")
        assert filtered == pruned == {k: r for k, r in together.items() if k[0] == name}
    assert {k[0] for k in together} == {"all", "2024-09", "2024-10"}


def test_margin_without_any_month_is_null(sources):
    got = keyed(Benchmark(sources, period="2024-10").period_kpis, "store_id")
    assert got[3]["margin"] is None and got[3]["revenue"] == 0


def test_ranking(kpis):
    rows = sorted(as_doubles(compare.rank_stores(kpis)).collect(), key=lambda r: r["rank"])
    assert [(r.store_id, r.lead and round(r.lead, 2)) for r in rows] == [(14, 519.4), (3, None), (5, None)]


def test_ranking_of_one_store_has_no_lead(kpis):
    row = compare.rank_stores(kpis.where("store_id = 5")).first()
    assert (row["rank"], row.lead) == (1, 0)


def test_ties_go_to_the_first_registered_store(kpis):
    tied = kpis.withColumn("net_profit", F.lit(1).cast("decimal(38,2)")).withColumn("full_costs", F.lit(2))
    assert [r.store_id for r in compare.rank_stores(tied).orderBy("rank").collect()] == [14, 5, 3]
    assert compare.leader(tied, "net_profit").first().store_id == 14
    extremes = compare.cost_extremes(tied).first()
    assert extremes.cheapest_store == extremes.dearest_store == "Rosenheim"


def test_leader_and_mean(kpis):
    row = compare.leader_vs_mean(kpis).first()
    assert (row.store_name, round(row.pct_above_mean, 1)) == ("Rosenheim", 84.5)
    nothing = kpis.withColumn("revenue", F.lit(0).cast("decimal(38,2)"))
    assert compare.leader_vs_mean(nothing).first().pct_above_mean == 0


def test_insights(kpis):
    row = compare.insights(kpis).first()
    assert row.headline == "Rosenheim hat den höchsten Gewinn | Karlsruhe hat die beste Marge"
    assert row.revenue_note == "Rosenheim liegt 84.5% über dem Durchschnitt"
    assert row.margin_note == "Karlsruhe mit 22.2% Nettomarge"
    assert row.recommendation == "Best Practices aus Rosenheim auf andere Filialen übertragen"


def test_insights_other_branches(kpis):
    best_margin = kpis.withColumn("margin", F.when(F.col("store_id") == 14, 99.0).otherwise(F.col("margin")))
    assert compare.insights(best_margin).first().headline == "Rosenheim führt bei Marge UND Gewinn"
    seller = kpis.withColumn("revenue", F.when(F.col("store_id") == 5, 99999).otherwise(F.col("revenue")))
    assert compare.insights(seller).first().headline.endswith(
        "Freiburg im Breisgau hat den höchsten Umsatz, aber nicht den höchsten Gewinn")


def test_scorecard(kpis, sources):
    got = keyed(compare.scorecard(kpis, sources.locations), "store_id")
    per_m2 = {14: 13097 / 1000, 5: 6400 / 1240, 3: 1800 / 800}
    average = sum(per_m2.values()) / 3
    for store, value in per_m2.items():
        assert got[store]["revenue_per_m2"] == pytest.approx(value, abs=1e-6)
        assert got[store]["revenue_score"] == pytest.approx(value / average * 100, abs=1e-5)
    # The mean margin is negative here, so every margin score is 0.
    assert {(r["margin_score"], r["margin_band"]) for r in got.values()} == {(0, "Unterdurchschnittlich")}
    profit = {14: 719.4 / 1000, 5: -1150 / 1240, 3: 200 / 800}
    assert got[3]["profit_score"] == pytest.approx(profit[3] / (sum(profit.values()) / 3) * 100, abs=1e-3)
    assert got[14]["revenue_band"] == "Überdurchschnittlich"
    assert got[3]["revenue_band"] == "Unterdurchschnittlich"


def test_store_without_area_counts_as_one(kpis, sources):
    sized = keyed(location.with_size(kpis, sources.locations.where("ID_STORE <> 3")), "store_id")
    assert {s: r["size_m2"] for s, r in sized.items()} == {14: 1000, 5: 1240, 3: 1}


def test_area_of_zero_gives_zero(kpis, sources):
    flat = sources.locations.withColumn("LOC_SIZE_M2", F.lit(0).cast("decimal(12,2)"))
    assert {r["revenue_per_m2"] for r in keyed(compare.scorecard(kpis, flat), "store_id").values()} == {0}


def test_rent(sources):
    got = keyed(location.monthly_rent(sources.locations, sources.stores, config.STORE_IDS), "ID_STORE")
    assert {s: r["MonthlyRentCalculated"] for s, r in got.items()} == {14: 15000, 5: 22940, 3: 10000}


def test_radar(kpis):
    got = keyed(compare.radar(kpis), "store_id", "axis")
    assert got[14, "Umsatz"]["value"] == 100
    assert got[5, "Bruttogewinn"]["value"] == pytest.approx(800 / 2679.4 * 100)
    assert got[3, "Marge"]["value"] == pytest.approx(66.66)
    losses = kpis.withColumn("net_profit", F.lit(-1).cast("decimal(38,2)"))
    assert keyed(compare.radar(losses), "store_id", "axis")[14, "Nettogewinn"]["value"] == 0


def test_costs(kpis):
    extremes = as_doubles(compare.cost_extremes(kpis)).first()
    assert (extremes.cheapest_store, extremes.dearest_store) == ("Karlsruhe", "Rosenheim")
    assert extremes.difference == pytest.approx(10777.6)
    assert {r.store_id: r.medal for r in compare.cost_rank(kpis).collect()} == {3: "🥇", 5: "🥈", 14: "🥉"}
    efficiency = keyed(compare.cost_efficiency(kpis), "store_id")
    assert {r["band"] for r in efficiency.values()} == {"Optimierbar"}
    assert efficiency[14]["cost_ratio"] == pytest.approx(12377.6 / 13097 * 100)


def test_medals_end_after_three(spark):
    frame = spark.createDataFrame([("all", i, i, f"s{i}", float(i)) for i in range(5)],
                                  "period string, store_ord int, store_id int, store_name string, full_costs double")
    assert [r.medal for r in compare.cost_rank(frame).orderBy("rank").collect()] == ["🥇", "🥈", "🥉", "#4", "#5"]


def test_efficiency_bands(spark):
    frame = spark.createDataFrame([("all", i, "s", c, 100.0) for i, c in enumerate((14.9, 15.0, 19.9, 20.0))]
                                  + [("all", 9, "s", 5.0, 0.0)],
                                  "period string, store_id int, store_name string, full_costs double, revenue double")
    got = keyed(compare.cost_efficiency(frame), "store_id")
    assert [got[i]["band"] for i in (0, 1, 2, 3)] == [
        "Sehr effizient", "Durchschnittlich", "Durchschnittlich", "Optimierbar"]
    assert (got[9]["cost_ratio"], got[9]["band"]) == (0, "Sehr effizient")


def test_margin_labels(kpis):
    assert {r.store_id: r.label for r in compare.margin_compare(kpis).collect()} == {14: "5.5%", 5: "-51.4%", 3: "22.2%"}


def test_cost_structure(kpis):
    got = keyed(compare.cost_structure(kpis), "store_id", "part")
    assert {p: got[5, p]["amount"] for _, p in got if _ == 5} == {
        "Wareneinsatz": 5600, "Personalkosten": 1600, "Betriebskosten": 300, "Beschaffung": 0}


def test_profit_bridge(sources):
    bridge = compare.profit_bridge(Benchmark(sources, period="2024-09").period_kpis)
    got = keyed(bridge, "store_id", "step")
    assert [got[5, n]["running_total"] for n in range(1, 7)] == [5400, 1000, 200, -100, -100, -100]
    assert (got[5, 6]["amount"], got[5, 6]["residual"], got[5, 6]["kind"]) == (-150, -50, "total")
    assert (got[5, 1]["text"], got[5, 2]["text"]) == ("5 Tsd €", "-4,400 €")


def test_gate(kpis):
    assert period.require_stores(kpis, 3).count() == 3
    assert period.require_stores(kpis, 4).count() == 0


def test_series(v2, sources):
    got = keyed(period.monthly_series(v2.export_v2, sources.registry, "NettogewinnEur", "net"), "store_id", "period")
    assert {k: r["net"] for k, r in got.items()} == {
        (14, "2024-09"): 719.4, (5, "2024-09"): -150, (5, "2024-10"): -1000, (3, "2024-09"): 400, (3, "2024-10"): -200}


def test_choices(spark, v2, sources):
    months = [(r.period, r.month_label) for r in period.months(v2.export_v2, month_labels(spark)).collect()]
    assert months == [("all", "Gesamtjahr 2024"), ("2024-09", "September 2024"), ("2024-10", "Oktober 2024")]
    assert [r.id for r in period.active_stores(v2.export_v2, sources.registry).collect()] == [14, 5, 3]


def test_unknown_month_is_its_own_label(spark):
    frame = spark.createDataFrame([("2031-01",)], "Monat string")
    assert period.with_month_label(frame, month_labels(spark)).first().month_label == "2031-01"


def test_filters(v2):
    assert {r.IdStore for r in period.of_store(v2.export_v2, "FREIBURG").collect()} == {5}
    assert {r.Filialgruppe for r in period.of_store(v2.export_v2, 3).collect()} == {"Karlsruhe"}
    assert period.of_store(v2.export_v2, "r.*e").count() == 0
    assert {r.Monat for r in period.in_period(v2.export_v2, "2024-10").collect()} == {"2024-10"}


def test_categories(v2):
    totals = v2.category_totals
    got = {r.category: (float(r.revenue), r.quantity) for r in totals.collect()}
    assert got == {"E-Trekking": (8000, 3), "City Bikes": (7797, 3), "Kid Bikes": (300, 2),
                   "Mountain Bikes": (2400, 2), "Race Bikes": (1900, 2), "Trekking Bikes": (1800, 2)}
    assert [r.category for r in category.top_k(totals).orderBy("rank").collect()] == [
        "E-Trekking", "City Bikes", "Mountain Bikes"]
    assert [(r["rank"], r.category) for r in category.bottom_k(totals).orderBy("rank").collect()] == [
        (4, "Race Bikes"), (5, "Trekking Bikes"), (6, "Kid Bikes")]
    row = category.best_worst(totals).first()
    assert (row.best_category, float(row.best_revenue), row.worst_category) == ("E-Trekking", 8000, "Kid Bikes")


def test_top_and_bottom_overlap_with_few_categories(v2):
    few = v2.category_totals.where("category IN ('Kid Bikes', 'Race Bikes')")
    assert category.top_k(few).count() == category.bottom_k(few).count() == 2


def test_category_ties_go_by_name(v2):
    tied = v2.category_totals.withColumn("revenue", F.lit(1))
    row = category.best_worst(tied).first()
    assert row.best_category == row.worst_category == "City Bikes"


def test_category_by_store(v2):
    price = keyed(category.category_by_store(v2.sales_agg, "AvgSalesPriceEur", "price", "mean"), "store_id", "category")
    assert price[5, "E-Trekking"]["price"] == 3000
    share = keyed(category.category_share(v2.sales_agg), "store_id", "category")
    assert share[14, "Kid Bikes"]["share"] == pytest.approx(300 / 13997)
    assert keyed(category.category_by_store(v2.sales_agg, "TotalQuantity", "n", period="2024-10"),
                 "store_id", "category").keys() == {(5, "Race Bikes"), (3, "City Bikes")}


def test_report_order(v2):
    keys = [(r.Monat, r.Filialgruppe) for r in v2.export_v2.collect()]
    got = [(r.Monat, r.Filialgruppe) for r in reports.profitability_report(v2.export_v2).collect()]
    assert got == sorted(sorted(keys, key=lambda k: k[1]), key=lambda k: k[0], reverse=True)
    assert [(r.Monat, r.Filialgruppe) for r in reports.trend_report(v2.export_v2).collect()] == sorted(keys)


def test_repeated_areas_count_once(spark, kpis, sources):
    more = sources.locations.where("ID_STORE = 5").selectExpr("ID_STORE", "CAST(2000 AS DECIMAL(12,2)) LOC_SIZE_M2", "LOC_RENT_EUR_M2", "LOC_NEBENKOSTEN_EUR")
    got = keyed(location.with_size(kpis, more.unionByName(sources.locations)), "store_id")
    assert {k: v["size_m2"] for k, v in got.items()} == {14: 1000, 5: 2000, 3: 800}
    none = keyed(location.with_size(kpis, sources.locations.where("ID_STORE = 5")), "store_id")
    assert {k: v["size_m2"] for k, v in none.items()} == {14: 1, 5: 1240, 3: 1}


def test_scores_do_not_depend_on_the_order(kpis, sources):
    rows = [sorted(map(str, compare.scorecard(kpis.repartition(n, "store_id"), sources.locations).collect())) for n in (1, 3)]
    assert rows[0] == rows[1]


def test_categories_without_amounts(spark):
    totals = spark.createDataFrame([("m", 1, "s", "A", None, 1), ("m", 1, "s", "B", 5.0, 1), ("m", 1, "s", "C", 9.0, 1)],
                                   "IdCalmonthStd string, IdStore int, StoreName string, BenchmarkCategory string, TotalRevenueEur double, TotalQuantity int")
    best = category.best_worst(category.category_totals(totals)).first()
    assert (best.best_category, best.best_revenue, best.worst_category) == ("C", 9.0, "A")


def test_a_missing_month_has_no_key_figures(spark, sources):
    from types import SimpleNamespace

    def unknown(df):
        return df.unionByName(df.limit(1).withColumn("ID_CALMONTH", F.lit(None).cast("date")))

    more = Benchmark(SimpleNamespace(**{**vars(sources), "sales": unknown(sources.sales), "costs": unknown(sources.costs)}))
    assert more.export_v2.count() == Benchmark(sources).export_v2.count() and more.sales_agg.where("IdCalmonthStd IS NULL").count() == 1


def test_several_spellings(spark, sources):
    from types import SimpleNamespace

    from tests.conftest import costs_frame

    def rows(first, second):
        costs = costs_frame(spark, [("2024-09", 14, "Monthly Rent", first, "Rosenheim"), ("2024-09", 14, "Monthly Rent", second, "ROS")])
        b = Benchmark(SimpleNamespace(**{**vars(sources), "costs": costs}))
        return sorted(float(r.TotalRevenueEur) for r in b.kpi.collect()), sorted(float(r.UmsatzEur) for r in b.export_v2.collect())

    assert rows(10, 5) == ([13097.0] * 2, [13097.0] * 4)
    assert rows(10, 10) == ([26194.0], [26194.0] * 2)


def test_reports(v2):
    first = reports.profitability_report(v2.export_v2).first()
    assert (first.Monat, first.Filialgruppe) == ("2024-10", "Freiburg im Breisgau")
    first = reports.trend_report(v2.export_v2).first()
    assert (first.Monat, first.Filialgruppe) == ("2024-09", "Freiburg im Breisgau")
    ratios = keyed(reports.avg_ratios(v2.export_v2), "Filialgruppe")
    assert ratios["Freiburg im Breisgau"]["DurchschnittPersonalkostenAnteil"] == pytest.approx((69.57 + 100) / 2)
    assert ratios["Karlsruhe"]["DurchschnittBetriebskostenQuote"] == pytest.approx(11.11)


def test_reports_on_groups(v1):
    ratios = keyed(reports.avg_ratios(v1.export_v1()), "Filialgruppe")
    assert ratios["Freiburg/Karlsruhe"]["DurchschnittPersonalkostenAnteil"] == pytest.approx((59.26 + 80) / 2)
    first = reports.profitability_report(v1.export_v1()).first()
    assert (first.Monat, first.Filialgruppe) == ("2024-10", "Freiburg/Karlsruhe")
