"""Lasting views and laid-out facts against the DataFrames of the layers."""

from __future__ import annotations

import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shopgauge.config import PRESET_V1, PRESET_V2, CategoryRules, CostBucket, CostBuckets
from shopgauge.plans import viewsql
from shopgauge.plans.benchmark import Benchmark
from shopgauge.plans.catalog import list_views, view_frames
from shopgauge.sources import layout
from shopgauge.sources.layout import KEYS, buckets_for, lay_out
from tests.conftest import costs_frame
from tests.test_plans import plan

ODD = PRESET_V2.__class__(
    CategoryRules((("It's", ("%o'x%", "100\\%%")), ("Rest_", ("_ixe%",))), "none"),
    CostBuckets(CostBucket(equals=("Monthly Salary",), prefixes=("O'",)), CostBucket(prefixes=("monthly r",)), CostBucket(equals=("insurance",))),
)


@pytest.fixture(scope="module")
def messy(spark, sources):
    """The fixture with two spellings, a missing month, quotes in texts and a store with two names."""
    more = costs_frame(spark, [("2024-09", 14, "Monthly Rent", 400, "ROSENHEIM"), ("2024-09", 14, "O'Neill fee", 7, "ROSENHEIM"), ("2024-09", 14, "Commission", 150, "Rosenheim 3")])
    undated = more.limit(1).withColumn("ID_CALMONTH", F.lit(None).cast("date"))
    sales = sources.sales.unionByName(sources.sales.limit(2).withColumn("ProduktBeschreibung", F.lit("Pino o'x 100%")))
    stores = sources.stores.unionByName(sources.stores.where("SALESORG_ID = 5").withColumn("STORE_LOCATION", F.lit("Freiburg")))
    return type(sources)(**{**vars(sources), "sales": sales, "costs": sources.costs.unionByName(more).unionByName(undated), "stores": stores})


@pytest.fixture(scope="module")
def names(spark, messy, tmp_path_factory):
    mark = uuid.uuid4().hex[:8]
    for name in ("sales", "costs", "stores"):
        path = str(tmp_path_factory.mktemp(name))
        getattr(messy, name).write.mode("overwrite").option("path", path).saveAsTable(f"given_{name}_{mark}")
    yield viewsql.SourceNames(*(f"given_{name}_{mark}" for name in ("sales", "costs", "stores")))
    for name in ("sales", "costs", "stores"):
        spark.sql(f"DROP TABLE given_{name}_{mark}")


@pytest.mark.parametrize("generation, preset", [("v1", PRESET_V1), ("v2", PRESET_V2), ("v2", ODD), ("v1", replace(ODD, store_ids=(14, 5)))])
def test_views_of_another_session(spark, messy, names, generation, preset):
    prefix = f"lasting_{uuid.uuid4().hex[:8]}_"
    created = viewsql.create_views(spark, names, generation, preset, prefix)
    other = spark.newSession()
    frames = view_frames(messy, generation, preset)
    assert sorted(created) == sorted(prefix + short for short in frames)
    assert [r.view_name for r in list_views(other, prefix).collect()] == sorted(created)
    for short, frame in frames.items():
        view = other.table(prefix + short)
        assert view.columns == frame.columns, short
        assert [f.dataType for f in view.schema] == [f.dataType for f in frame.schema], short
        assert sorted(map(str, view.collect())) == sorted(map(str, frame.collect())), short
    assert viewsql.create_views(spark, names, generation, preset, prefix) == created  # replaced
    for view in reversed(created):
        spark.sql(f"DROP VIEW {view}")


def test_each_view_reads_a_fact_table_once(spark, names):
    texts = viewsql.view_texts(names, "v2")
    for short, select in texts.items():
        text = plan(spark.sql(select), "simple")
        assert text.count("given_sales") <= 1 and text.count("given_costs") <= 1, short


def test_unknown_generation(names):
    with pytest.raises(ValueError):
        viewsql.view_texts(names, "v3")


# ---- facts laid out by month and store --------------------------------------------------


@pytest.fixture(scope="module")
def laid_out(spark, messy, tmp_path_factory):
    facts = lay_out(Benchmark(messy, PRESET_V2), str(tmp_path_factory.mktemp("facts")), f"facts_{uuid.uuid4().hex[:8]}_", buckets=5)
    yield facts
    facts.drop()


def test_laid_out_facts_give_the_same_figures(messy, laid_out):
    one, other = Benchmark(laid_out, PRESET_V2), Benchmark(messy, PRESET_V2)
    for name in ("sales_std", "sales_agg", "costs_agg", "costs_detail", "kpi", "export_v2", "waterfall", "period_kpis_all"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(other, name).collect())), name
    month = Benchmark(laid_out, PRESET_V2, "2024-09").export_v2.collect()
    assert sorted(map(str, month)) == sorted(map(str, Benchmark(messy, PRESET_V2, "2024-09").export_v2.collect()))


def test_sums_of_laid_out_facts_need_no_exchange(spark, laid_out):
    bench = Benchmark(laid_out, PRESET_V2)
    for name in ("category_sums", "store_totals", "cost_sums", "cost_sums_wide", "detail_sums"):
        text = plan(getattr(bench, name), "simple")
        assert "hashpartitioning" not in text and "Bucketed: true" in text, name
    sold, spent = laid_out.lines.groupBy(*KEYS).agg(F.sum("RevenueEur")), laid_out.costs.groupBy(*KEYS).agg(F.sum("WertEUR"))
    joined = plan(sold.join(spent.hint("merge"), list(KEYS)), "simple")
    assert "SortMergeJoin" in joined and "hashpartitioning" not in joined


def test_number_of_buckets():
    assert [buckets_for(n) for n in (0, 10**6, 10**9, 10**13)] == [8, 8, 250, 100_000]
    assert buckets_for(1000, rows_per_bucket=10) == 100


def test_laid_out_tables_leave_the_catalog(spark, messy, tmp_path):
    facts = lay_out(Benchmark(messy, PRESET_V2), str(tmp_path), "gone_")
    assert spark.catalog.tableExists("gone_sales_lines")
    facts.drop()
    assert not spark.catalog.tableExists("gone_sales_lines") and not spark.catalog.tableExists("gone_cost_rows")


def test_a_hot_month_of_a_store_is_written_by_several_tasks(spark, messy, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "ROWS_PER_TASK", 1000, raising=False)
    rows = 16_000
    dated = spark.range(0, rows, 1, 4).selectExpr("id", "CASE WHEN id % 8 = 0 THEN DATE'2024-10-03' ELSE DATE'2024-09-07' END AS day", "IF(id % 8 = 1, 5, 14) AS store", "md5(CAST(id AS STRING)) AS text")
    sales = dated.selectExpr("day", "store", "id", "text", *[f"CAST(id % {n} AS DECIMAL(19,4))" for n in (1000, 900, 90)], "CAST(id % 7 AS INT)").toDF(*messy.sales.columns)
    costs = dated.selectExpr("day", "store", "'Rosenheim'", "'Monthly Rent ' || text", "CAST(id % 1000 AS DECIMAL(19,4))").toDF(*messy.costs.columns)
    given = Benchmark(type(messy)(**{**vars(messy), "sales": sales, "costs": costs}), PRESET_V2)
    facts = lay_out(given, str(tmp_path), f"hot_{uuid.uuid4().hex[:8]}_", buckets=3)
    for frame in (facts.lines, facts.costs):
        task = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
        written = [r["count"] for r in frame.groupBy(task.alias("task")).count().collect()]
        assert sum(written) == rows and max(written) <= 1200 and len(written) <= rows / 1000 + 3, written
        files = frame.select("_metadata.file_name", F.pmod(F.hash(*KEYS), F.lit(3)).alias("bucket")).distinct()
        assert files.count() == len(written), "a task writes to one bucket"
    for layer in ("category_sums", "detail_sums", "export_v2"):
        got, wanted = getattr(Benchmark(facts, PRESET_V2), layer), getattr(given, layer)
        assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty(), layer
    facts.drop()
