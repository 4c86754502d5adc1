"""CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopgauge.config import ALL_PERIODS
from shopgauge.operators.period import in_period


def csv_path(path: str, period: str = ALL_PERIODS) -> str:
    return f"{path.rstrip('/')}/benchmark_export_{period}.csv"


def write_csv(df: DataFrame, path: str, period: str = ALL_PERIODS, column: str = "Monat") -> str:
    """Write the rows of a period with a header, in parallel part files; returns the folder."""
    target = csv_path(path, period)
    in_period(df, period, column).write.mode("overwrite").option("header", True).csv(target)
    return target
