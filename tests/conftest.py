from __future__ import annotations

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import SparkSession

from shopgauge import schemas
from shopgauge.config import PRESET_V1, PRESET_V2
from shopgauge.plans.benchmark import Benchmark
from shopgauge.sources.registry import store_registry


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(month: str) -> dt.date:
    return dt.date.fromisoformat(f"{month}-15")


SALES = [
    ("2024-09", 14, "Grace MX Urban", 5000, 4000, 2500, 2),
    ("2024-09", 14, "Town Lite Rohloff GTS 2012 He", 7797, "6237.60", 2599, 3),
    ("2024-09", 14, "Puky Z2", 300, 180, 150, 2),
    ("2024-09", 5, "Copperhead 3", 2400, 1900, 1200, 2),
    ("2024-09", 5, "Cube Trekking Pedelec", 3000, 2500, 3000, 1),
    ("2024-10", 5, "Vulture 8", 1000, 1200, 1000, 1),
    ("2024-09", 3, "Rixe Comp XXL", 1800, 1200, 900, 2),
    ("2024-10", 3, "Unknown Cruiser", 0, 0, 500, 0),
    ("2024-11", 14, "Diesel 29", 900, 600, 900, 1),
]

NAMES = {14: "Rosenheim", 5: "Freiburg im Breisgau", 3: "Karlsruhe", 7: "München"}

COSTS = [
    ("2024-09", 14, "Monthly Salary", 1000),
    ("2024-09", 14, "Monthly Social Costs", 250),
    ("2024-09", 14, "Commission", 150),
    ("2024-09", 14, "Monthly Rent", 400),
    ("2024-09", 14, "Marketing Campaign", 100),
    ("2024-09", 14, "Additional Procurement Costs for Puky", 60),
    ("2024-09", 5, "Monthly Salary", 800),
    ("2024-09", 5, "Monthly Rent", 300),
    ("2024-09", 5, "Insurance", 50),
    ("2024-10", 5, "Monthly Salary", 800),
    ("2024-09", 3, "Monthly Rent", 200),
    ("2024-10", 3, "Monthly Rent", 200),
]

LOCATIONS = [
    (14, "1000", "12.00", "3.00"),
    (5, "1240", "14.50", "4.00"),
    (3, "800", "10.00", "2.50"),
]


def sales_frame(spark, rows):
    return spark.createDataFrame(
        [(day(m), s, i, d, Decimal(r), Decimal(t), Decimal(p), q) for i, (m, s, d, r, t, p, q) in enumerate(rows)],
        schemas.SALES,
    )


def costs_frame(spark, rows, names=None):
    return spark.createDataFrame(
        [(day(row[0]), row[1], row[4] if len(row) > 4 else NAMES[row[1]], row[2], Decimal(row[3])) for row in rows],
        schemas.COSTS,
    )


@pytest.fixture(scope="session")
def sources(spark):
    # Store 7 lies outside the configured stores and must never show up.
    outside_sale = [("2024-09", 7, "Grace MX Urban", 9999, 1, 1, 1)]
    outside_cost = [("2024-09", 7, "Monthly Rent", 1)]
    return SimpleNamespace(
        sales=sales_frame(spark, SALES + outside_sale),
        costs=costs_frame(spark, COSTS + outside_cost),
        stores=spark.createDataFrame(list(NAMES.items()), schemas.SALESORG),
        locations=spark.createDataFrame([(i, *map(Decimal, rest)) for i, *rest in LOCATIONS], schemas.LOCATION),
        registry=store_registry(spark),
    )


@pytest.fixture(scope="session")
def v2(sources):
    return Benchmark(sources, PRESET_V2)


@pytest.fixture(scope="session")
def v1(sources):
    return Benchmark(sources, PRESET_V1)


@pytest.fixture(scope="session")
def kpis(v2):
    return v2.period_kpis.cache()
