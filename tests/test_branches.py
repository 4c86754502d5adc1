"""Every branch that a query is there for has rows in the given tables."""

from __future__ import annotations

import pytest

from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def values(spark, name, column):
    return {r[0] for r in QUERIES[name](spark, SF_DIR).select(column).distinct().collect()}


@pytest.mark.parametrize("name, expected", [
    ("category_v1", {"E-Bike", "MTB", "City/Trekking", "Kinder", "Sonstige"}),
    ("category_v2", {"E-Trekking", "Kid Bikes", "Mountain Bikes", "Race Bikes", "Trekking Bikes", "City Bikes"}),
])
def test_all_classes(spark, name, expected):
    assert values(spark, name, "category") == expected


def test_exact_procurement(spark):
    sums = QUERIES["costs_agg_v1"](spark, SF_DIR).where("AdditionalProcurementCostsEur > 0")
    assert not sums.isEmpty()


def test_labels_are_found_and_missing(spark):
    rows = QUERIES["month_label"](spark, SF_DIR)
    assert not rows.where("month_label like '% von 1997'").isEmpty() and not rows.where("month_label = Monat").isEmpty()


def test_changes(spark):
    assert values(spark, "signed_change", "kind") == {"positive", "negative", "neutral", None}
    assert values(spark, "trend_band", "band") == {"up", "down", "flat"}


def test_matches(spark):
    assert values(spark, "like_match", "same_case") == {True, False}


def test_filters_remove_rows(spark):
    assert values(spark, "detail_scan", "Monat") == values(spark, "period_filter", "Monat") == {"1997-03"}
    assert values(spark, "rows_per_store", "ID_STORE") == {3, 5, 14}


def test_spellings_and_missing_amounts(spark):
    assert QUERIES["export_spellings"](spark, SF_DIR).count() > QUERIES["kpi_spellings"](spark, SF_DIR).count()
    assert values(spark, "insights_missing", "margin_note") == {None}
    assert not QUERIES["category_totals_missing"](spark, SF_DIR).where("revenue = 0 AND quantity > 0").isEmpty()


def test_all_views_have_rows(spark):
    views = QUERIES["views_register"](spark, SF_DIR)
    assert views.count() == 13 and views.where("n = 0").isEmpty()


def test_stored_sums_are_opened_and_refreshed(spark, tmp_path):
    from checks.queries import PRESET
    from shopgauge.plans.benchmark import Benchmark
    from shopgauge.sources.starschema import StarSchema

    folder = f"file://{tmp_path}/sums"
    everything = Benchmark(StarSchema(spark, SF_DIR), PRESET)
    expected = sorted(map(str, everything.export_v2.collect()))
    everything.stored(folder)
    opened = everything.opened(folder)
    assert sorted(map(str, opened.export_v2.collect())) == expected
    text = opened.waterfall._sc._jvm.PythonSQLUtils.explainString(opened.waterfall._jdf.queryExecution(), "formatted")
    assert "orders.parquet" not in text and text.count("detail_sums") == 1
    Benchmark(StarSchema(spark, SF_DIR), PRESET, "1997-03").stored(folder)
    assert sorted(map(str, everything.opened(folder).export_v2.collect())) == expected
