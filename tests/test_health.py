"""The health report on hand-made faults."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from shopgauge import schemas
from shopgauge.config import BUCKETS_V2
from shopgauge.operators.health import source_health
from tests.conftest import costs_frame, sales_frame
from tests.test_plans import plan


def report(*frames, **options):
    return {(r.source, r.finding): r.n for r in source_health(*frames, BUCKETS_V2, **options).collect()}


def test_clean_sources(sources):
    found = report(sources.sales, sources.costs, sources.stores, sources.locations, store_ids=(3, 5, 14))
    rows = {("sales", "rows"): 9, ("costs", "rows"): 12, ("salesorg", "rows"): 4, ("location", "rows"): 3}
    one_side = {("sales", "months_without_costs"): 1, ("costs", "in_no_bucket"): 1}
    assert {k: v for k, v in found.items() if v} == rows | one_side


def test_faults(spark, sources):
    extra = sales_frame(spark, [("2024-09", 99, "x", 1, 1, 1, 1), ("2024-12", 14, "y", 1, 1, 1, 1)])
    undated = extra.where("ID_STORE = 99").withColumns({"ID_CALMONTH": F.lit(None).cast("date"), "ID_STORE": F.lit(None).cast("int"), "RevenueEUR": F.lit(None).cast("decimal(19,4)")})
    sales = sources.sales.unionByName(extra).unionByName(undated)
    costs = sources.costs.unionByName(costs_frame(spark, [("2024-09", 14, "Rosenheim-Umbau", 5, "ROSENHEIM"), ("2025-01", 3, "Monthly Rent", 1, "Karlsruhe")]))
    stores = sources.stores.unionByName(spark.createDataFrame([(14, "again"), (None, "none")], schemas.SALESORG))
    locations = sources.locations.unionByName(spark.createDataFrame([(5, Decimal(1), None, None)] * 2, schemas.LOCATION))
    found = report(sales, costs, stores, locations)
    assert found == {
        ("sales", "rows"): 13, ("sales", "without_month"): 1, ("sales", "without_store"): 1, ("sales", "unknown_store"): 1,
        ("sales", "without_amount"): 1, ("sales", "months_without_costs"): 3,
        ("costs", "rows"): 15, ("costs", "without_month"): 0, ("costs", "without_store"): 0, ("costs", "unknown_store"): 0,
        ("costs", "without_amount"): 0, ("costs", "months_without_sales"): 1, ("costs", "in_no_bucket"): 2, ("costs", "several_spellings"): 1,
        ("salesorg", "rows"): 6, ("salesorg", "repeated_ids"): 1, ("salesorg", "without_id"): 1,
        ("location", "rows"): 5, ("location", "repeated_ids"): 1, ("location", "without_id"): 0,
    }


def test_empty_sources(sources):
    frames = [f.where("false") for f in (sources.sales, sources.costs, sources.stores, sources.locations)]
    found = report(*frames)
    assert len(found) == 20 and set(found.values()) == {0}


def test_each_table_is_read_once(spark):
    from checks.queries import QUERIES
    from tests.test_plans import SF_DIR, scans

    text = plan(QUERIES["source_health"](spark, SF_DIR))
    assert scans(text)["lineitem"] == 1 and scans(text)["orders"] == 1
