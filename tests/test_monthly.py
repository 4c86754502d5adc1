"""Monthly sums that are stored more than once."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shopgauge.config import PRESET_V2
from shopgauge.operators import period
from shopgauge.plans.benchmark import Benchmark
from shopgauge.plans.monthly import NO_MONTH, MonthlySums
from tests.test_plans import plan

FIGURES = ("sales_agg", "costs_agg", "costs_detail", "kpi", "export_v2", "waterfall", "period_kpis_all")


def changed(sources, **frames):
    return SimpleNamespace(**{**vars(sources), **frames})


def figures(bench):
    return {name: sorted(map(str, getattr(bench, name).collect())) for name in FIGURES}


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*.parquet") if "manifest" not in str(p)}


def in_month(month):
    return F.date_format("ID_CALMONTH", "yyyy-MM") == month


@pytest.fixture()
def folder(sources, tmp_path):
    Benchmark(sources, PRESET_V2).stored(str(tmp_path))
    return str(tmp_path)


@pytest.mark.parametrize("side", ["sales", "costs"])
def test_a_vanished_month_is_gone(sources, folder, side):
    later = changed(sources, **{side: getattr(sources, side).where(~in_month("2024-10"))})
    assert figures(Benchmark(later, PRESET_V2).stored(folder)) == figures(Benchmark(later, PRESET_V2))
    assert "2024-10" not in str(Benchmark(later, PRESET_V2).opened(folder).export_v2.collect())


def test_emptied_facts_leave_nothing(sources, folder):
    later = changed(sources, sales=sources.sales.where("false"), costs=sources.costs.where("false"))
    stored = Benchmark(later, PRESET_V2).stored(folder)
    assert {name: getattr(stored, name).count() for name in (*FIGURES, "available")} == dict.fromkeys((*FIGURES, "available"), 0)


def test_only_changed_months_are_written(spark, sources, folder):
    before = files(folder)
    kept = MonthlySums(spark, folder)
    version = kept.version()
    Benchmark(sources, PRESET_V2).stored(folder)
    assert files(folder) == before and kept.version() == version
    later = changed(sources, costs=sources.costs.withColumn("WertEUR", F.when(in_month("2024-10"), F.col("WertEUR") + 1).otherwise(F.col("WertEUR")).cast("decimal(19,4)")))
    assert figures(Benchmark(later, PRESET_V2).stored(folder)) == figures(Benchmark(later, PRESET_V2))
    after = files(folder)
    assert before.items() <= after.items()
    new = set(after) - set(before)
    assert new and all("detail_sums" in f and "Month=2024-10" in f for f in new)


def test_changes_are_reported(spark, sources, tmp_path):
    kept, bench = MonthlySums(spark, str(tmp_path)), Benchmark(sources, PRESET_V2)
    first = kept.refresh({"detail_sums": bench.detail_sums})
    assert first == {"detail_sums": {"written": ["2024-09", "2024-10"], "removed": []}}
    again = kept.refresh({"detail_sums": bench.detail_sums.where("MonthStart > '2024-09-30'")})
    assert again == {"detail_sums": {"written": [], "removed": ["2024-09"]}} and kept.version() == 2


def test_a_period_touches_its_month_only(sources, folder):
    later = changed(sources, costs=sources.costs.where("false"))
    Benchmark(later, PRESET_V2, "2024-10").stored(folder)
    mixed = changed(sources, costs=sources.costs.where(~in_month("2024-10")))
    assert figures(Benchmark(sources, PRESET_V2).opened(folder)) == figures(Benchmark(mixed, PRESET_V2))
    Benchmark(sources, PRESET_V2, "2024-10").stored(folder)
    assert figures(Benchmark(sources, PRESET_V2).opened(folder)) == figures(Benchmark(sources, PRESET_V2))


def test_another_rule_table_changes_the_sums(sources, folder):
    from dataclasses import replace

    other = replace(PRESET_V2, rules=replace(PRESET_V2.rules, classes=PRESET_V2.rules.classes[1:]))
    assert figures(Benchmark(sources, other).stored(folder)) == figures(Benchmark(sources, other))


def test_a_refresh_that_dies_changes_nothing(spark, sources, folder, monkeypatch):
    expected = figures(Benchmark(sources, PRESET_V2).opened(folder))
    later = changed(sources, costs=sources.costs.limit(3))

    def die(self, rows):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(MonthlySums, "_switch", die)
    with pytest.raises(RuntimeError):
        Benchmark(later, PRESET_V2).stored(folder)
    monkeypatch.undo()
    assert figures(Benchmark(sources, PRESET_V2).opened(folder)) == expected
    assert figures(Benchmark(later, PRESET_V2).stored(folder)) == figures(Benchmark(later, PRESET_V2))


def test_facts_without_a_month(spark, sources, tmp_path):
    undated = sources.costs.limit(2).withColumn("ID_CALMONTH", F.lit(None).cast("date"))
    bench = Benchmark(changed(sources, costs=sources.costs.unionByName(undated)), PRESET_V2)
    assert figures(bench.stored(str(tmp_path))) == figures(bench)
    assert NO_MONTH in {r.month for r in MonthlySums(spark, str(tmp_path)).manifest().collect()}


def test_unstored_folder_is_empty(spark, sources, tmp_path):
    opened = Benchmark(sources, PRESET_V2).opened(f"{tmp_path}/none")
    assert opened.export_v2.isEmpty() and MonthlySums(spark, f"{tmp_path}/none").version() == 0


def test_facts_are_scanned_once_for_a_refresh(spark, sources, tmp_path):
    """The sums are computed once for the comparison and for writing: rows are counted as they are read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = changed(sources, sales=sources.sales.mapInArrow(count, sources.sales.schema))
    Benchmark(counted, PRESET_V2).stored(str(tmp_path))
    assert seen.value == sources.sales.count()


def test_available_months_and_stores(sources, folder, v2):
    stored = Benchmark(sources, PRESET_V2).opened(folder)
    assert set(stored.available.collect()) == set(v2.available.collect())
    text = plan(period.active_stores(stored.available, sources.registry))
    assert "detail_sums" in text and "KostenEur" not in text and "TotalRevenueEur" not in text
