"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from shopgauge.operators import kpi as kpi_ops
from shopgauge.schemas import as_doubles

SF_DIR = "/root/testdata/sf0.001"
#: Counts the rows of thirteen views, one after the other.
SEVERAL_VIEWS = {"views_register", "views_lasting"}
#: Filter a published view by its month key.
BY_KEY = ["detail_scan", "detail_scan_category", "period_filter"]


def plan(df, mode="formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, SF_DIR)) for name, query in QUERIES.items() if name != "sink_csv"}


def test_no_pairwise_joins_and_no_python(plans):
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
    assert {n: b for n, p in plans.items() for b in banned if b in p} == {}


def scans(text):
    return Counter(re.findall(r"Location: .*?/(\w+)\.parquet", text))


def test_facts_are_read_once(plans):
    twice = {n for n, p in plans.items() if max(scans(p)["lineitem"], scans(p)["orders"]) > 1}
    assert twice == SEVERAL_VIEWS


def test_only_needed_columns_are_read(plans):
    export = plans["export_v2"]
    assert "l_tax" not in export and "l_orderkey" not in export
    # Store figures need no description, so the rules are not evaluated at all.
    assert "p_name" not in export
    assert "p_name" in plans["sales_agg"]


def test_a_month_is_pruned_at_the_scan(plans):
    for name in ("period_at_the_source", "period_kpis_month"):
        for column in ("l_shipdate", "o_orderdate"):
            assert f"GreaterThanOrEqual({column},1997-03-01T00:00)" in plans[name]
            assert f"LessThan({column},1997-04-01T00:00)" in plans[name]


def test_stores_are_pruned_at_the_scan(plans):
    assert "In(s_nationkey, [14,3,5])" in plans["store_whitelist"]
    assert "EqualTo(c_nationkey,3)" in plans["store_filter_by_id"]


def test_facts_are_not_filtered_by_formatted_months(plans):
    assert [n for n, p in plans.items() if re.search(r"Condition : .*date_format\(", p)] == BY_KEY


def test_facts_are_not_checked_for_computed_months(plans):
    for name in ("export_v2", "kpi", "waterfall_view", "period_kpis_all", "scorecard"):
        assert re.search(r"Condition : .*trunc\(", plans[name]) is None


def test_texts_are_lowered_once_and_the_last_class_is_dropped(plans):
    text = plans["category_v2"]
    assert text.count("lower(p_name") == 1
    assert "corona" not in text and "vulture" in text


def test_names_are_matched_without_shuffling_the_facts(plans):
    text = plans["store_by_name"]
    assert scans(text)["orders"] == 1 and "hashpartitioning(store_key" not in text


def test_fact_shuffles_carry_partial_sums(plans):
    """With small dimensions the one shuffle of the sales side comes after a partial aggregate."""
    assert plans["sales_agg"].count("hashpartitioning") == 1
    assert "partial_sum" in plans["sales_agg"]


def test_windows_follow_a_period_or_a_store(plans):
    for name in ("profit_ranking", "scorecard", "radar", "cost_rank", "min_stores_gate"):
        assert "hashpartitioning(period" in plans[name]
    assert "hashpartitioning(store_id" in plans["category_share"] or "hashpartitioning(IdStore" in plans["category_share"]


def test_big_dimensions_are_not_broadcast(spark):
    """Beyond the size limit every dimension join falls back to a shuffle, with the same rows."""
    names = ("export_v2", "sales_agg", "category_lookup", "store_by_name", "scorecard")
    before = {n: sorted(map(str, QUERIES[n](spark, SF_DIR).collect())) for n in names}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for name in names:
            df = QUERIES[name](spark, SF_DIR)
            assert "Broadcast" not in plan(df)
            assert sorted(map(str, df.collect())) == before[name]
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_results_do_not_depend_on_partitioning(spark, v2, sources):
    from shopgauge.plans.benchmark import Benchmark

    expected = sorted(as_doubles(v2.export_v2).collect(), key=str)
    shuffled = type(sources)(**{
        **vars(sources),
        "sales": sources.sales.repartition(7, "ID_MATERIAL").sortWithinPartitions(F.rand(1)),
        "costs": sources.costs.repartition(3, "WertEUR"),
    })
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert sorted(as_doubles(Benchmark(shuffled).export_v2).collect(), key=str) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_store_comparison_reads_the_figures_once(v1):
    text = plan(v1.store_comparison(), "simple")
    assert text.count("Union") == 0
    assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") == plan(
        kpi_ops.kpi(v1.store_totals, v1.cost_sums), "simple").count("Join [")


def test_a_hot_supplier_is_split(spark, tmp_path):
    """With every dimension too big to broadcast, a key with half of the lines is spread over tasks."""
    from pathlib import Path

    from shopgauge.operators.sales import category_sums, sales_lines
    from shopgauge.sources import starschema

    for name in ("supplier", "part", "nation"):
        Path(tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.01/{name}.parquet")
    lines = starschema.table(spark, "/root/testdata/sf0.01", "lineitem")
    hot = lines.withColumn("l_suppkey", F.expr("CASE WHEN l_linenumber <= 4 THEN 1 ELSE l_suppkey END"))
    hot.repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))

    def sums():
        tables = starschema.StarSchema(spark, str(tmp_path))
        return category_sums(sales_lines(tables.sales, starschema.RULES), tables.stores)

    expected = sorted(map(str, sums().collect()))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        split = sums()
        assert sorted(map(str, split.collect())) == expected
        assert "skew=true" in plan(split, "simple")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
