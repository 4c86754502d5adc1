"""Publish the layers as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.config import PRESET_V1, PRESET_V2, Preset
from shopgauge.plans.benchmark import Benchmark, Sources

PREFIX = "benchmark_"
GENERATIONS = ("v1", "v2")


def view_frames(sources: Sources, generation: str = "v2", preset: Preset | None = None) -> dict[str, DataFrame]:
    """The views of a generation by their short names; the first has six, the second seven."""
    if generation not in GENERATIONS:
        raise ValueError(f"generation must be one of {GENERATIONS}, not {generation!r}")
    bench = Benchmark(sources, preset or (PRESET_V1 if generation == "v1" else PRESET_V2))
    frames = {
        "sales_std": bench.sales_std,
        "sales_agg": bench.sales_agg,
        "costs_agg": bench.costs_agg,
        "kpi": bench.kpi,
    }
    if generation == "v1":
        frames.update(store_comparison=bench.store_comparison(), export_monthly=bench.export_v1())
    else:
        frames.update(export_monthly=bench.export_v2, costs_detail=bench.costs_detail, waterfall=bench.waterfall)
    return frames


def register_views(
    sources: Sources, generation: str = "v2", preset: Preset | None = None, prefix: str = PREFIX
) -> list[str]:
    """Create or replace the views of a generation; returns their names."""
    names = []
    for name, frame in view_frames(sources, generation, preset).items():
        frame.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def list_views(spark: SparkSession, prefix: str = PREFIX) -> DataFrame:
    """Registered views whose name starts with a prefix, sorted."""
    views = spark.sql(f"SHOW VIEWS LIKE '{prefix}*'")
    return views.select(F.col("viewName").alias("view_name")).orderBy("view_name")
