"""Relations that hold between the layers, on the given tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES, bench

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def b(spark):
    return bench(spark, SF_DIR)


def test_categories_add_up_to_the_store(b):
    per_store = {(r.MonthStart, r.IdStore): (r.TotalRevenueEur, r.TotalGrossProfitEur) for r in b.store_totals.collect()}
    summed = b.sales_agg.groupBy("IdCalmonthStd", "IdStore").agg(F.sum("TotalRevenueEur"), F.sum("TotalGrossProfitEur"))
    assert {(r[0], r[1]): (r[2], r[3]) for r in summed.collect()} == {
        (m.strftime("%Y-%m"), s): v for (m, s), v in per_store.items()}


def test_std_and_agg_agree(b):
    direct = b.sales_std.groupBy("IdCalmonthStd", "IdStore", "StoreName", "BenchmarkCategory").agg(
        F.sum("RevenueEur"), F.sum("GrossProfitEur"), F.sum("TransferCostEur"), F.sum("Quantity"))
    agg = b.sales_agg.select("IdCalmonthStd", "IdStore", "StoreName", "BenchmarkCategory", "TotalRevenueEur",
                             "TotalGrossProfitEur", "TotalTransferCostEur", "TotalQuantity")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, agg.collect()))


def test_both_kpi_paths_agree(spark):
    a, c = (sorted(map(str, QUERIES[n](spark, SF_DIR).collect())) for n in ("kpi", "kpi_from_categories"))
    assert a == c


def test_goods_and_gross_profit_make_revenue(b):
    off = b.waterfall.where("WareneinsatzEur + BruttogewinnEur <> UmsatzEur")
    assert off.count() == 0


def test_detail_adds_up_to_total_costs(b):
    detail = b.costs_detail.groupBy("IdCalmonthStd", "IdStore").agg(F.sum("KostenEur"))
    totals = b.costs_agg.select("IdCalmonthStd", "IdStore", "TotalCostsEur")
    assert sorted(map(tuple, detail.collect())) == sorted(map(tuple, totals.collect()))


def test_shares_make_one(spark):
    sums = QUERIES["category_share"](spark, SF_DIR).groupBy("store_id").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in sums.collect())


def test_bridge_ends_at_net_profit_less_residual(spark):
    last = QUERIES["profit_bridge"](spark, SF_DIR).where("step = 6")
    assert last.where("abs(running_total + residual - amount) > 0.01").count() == 0


def test_each_period_has_one_winner(spark):
    ranking = QUERIES["profit_ranking"](spark, SF_DIR)
    assert ranking.where("rank = 1").groupBy("period").count().where("count <> 1").count() == 0
    assert ranking.where("rank = 1 AND lead < 0").count() == 0


def test_stored_sums_give_the_same_figures(spark, b, tmp_path):
    stored = b.stored(str(tmp_path))
    for name in ("sales_agg", "costs_agg", "costs_detail", "kpi", "export_v2", "waterfall", "period_kpis_all"):
        assert sorted(map(str, getattr(stored, name).collect())) == sorted(map(str, getattr(b, name).collect())), name


def test_stored_sums_leave_the_facts_alone(b, tmp_path):
    from tests.test_plans import plan

    text = plan(b.stored(str(tmp_path)).export_v2)
    assert "lineitem" not in text and "orders" not in text
