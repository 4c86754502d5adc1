"""Read the four source tables from files or over JDBC."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from shopgauge import config, schemas
from shopgauge.sources.registry import store_registry

SALES_TABLE = "V_LIST_MONTHLY_SALES"
COSTS_TABLE = "V_LIST_MONTHLY_COSTS"
SALESORG_TABLE = "T_SALESORG"
LOCATION_TABLE = "T_LOCATION"
MONTH_COLUMN = "ID_CALMONTH"


def load_settings(source: Mapping | str | Path) -> dict:
    """Source settings, given directly or as the path of a JSON file."""
    if isinstance(source, Mapping):
        return dict(source)
    with open(source, encoding="utf-8") as handle:
        return json.load(handle)


def month_predicates(first: dt.date, last: dt.date, column: str = MONTH_COLUMN, split: str | None = None, parts: int = 1) -> list[str]:
    """One condition per month from `first` to `last`, for a read of its own each; together they hold every row once.

    The first month also takes what is earlier or has no date, the last one what is later, so
    rows that come while the table is read are not lost. Where a month is too big for one
    read, `split` names a whole-number column by whose remainder each is cut into `parts`.
    """
    start = dt.date(first.year, first.month, 1)
    end = dt.date(last.year, last.month, 1)
    begins: list[dt.date] = []
    while not begins or start <= end:
        begins.append(start)
        start = dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)
    day = "CAST('{}' AS DATE)".format
    conditions = []
    for begin, end in zip(begins, [*begins[1:], None]):
        bounds = [f"{column} >= {day(begin)}"] if begin != begins[0] else []
        bounds += [f"{column} < {day(end)}"] if end else []
        inside = " AND ".join(bounds) or "1 = 1"
        conditions.append(f"({inside} OR {column} IS NULL)" if begin == begins[0] else f"({inside})")
    if split is None or parts == 1:
        return conditions
    return [f"{c} AND coalesce(abs({split}) % {parts}, 0) = {k}" for c in conditions for k in range(parts)]


def needs_months(settings: Mapping, name: str) -> bool:
    """Whether a table is one of the facts, and nothing says how to split it or that one reader will do."""
    return name.rpartition(".")[2] in (SALES_TABLE, COSTS_TABLE) and not settings.get("single_reader") and not settings.get("partition", {}).get(name)


def read_by_month(spark: SparkSession, name: str, settings: Mapping) -> DataFrame:
    """A fact table over JDBC, a read per month between its smallest and its largest one, which one query finds.

    Settings: `month_column` (ID_CALMONTH), and `month_split` = {column, count} for big months.
    """
    column, split = settings.get("month_column", MONTH_COLUMN), settings.get("month_split", {})
    options = jdbc_options({**settings, "single_reader": True}, name)
    table = options.pop("dbtable")
    bounds = f"SELECT min({column}) AS first_month, max({column}) AS last_month FROM {table}"
    first, last = spark.read.format("jdbc").options(**options, query=bounds).load().first()
    if first is None:
        return spark.read.format("jdbc").options(**options, dbtable=table).load()
    predicates = month_predicates(first, last, column, split.get("column"), split.get("count", 1))
    return spark.read.jdbc(options.pop("url"), table, predicates=predicates, properties=options)


def jdbc_options(settings: Mapping, name: str) -> dict[str, str]:
    """Reader options for one table, view or query of a SQL Server database.

    `partition` = {table: {column, lower, upper, count}} splits a table or a query (under its
    text) into that many parallel reads. The fact tables need it, as a single task would read
    them whole, or are read by month (`read_by_month`, what `read_table` does without it);
    `"single_reader": true` in the settings allows one reader for small ones.
    """
    host = settings["server"].replace(",", ":")
    options = {
        "url": f"jdbc:sqlserver://{host};databaseName={settings['database']};encrypt=false",
        "user": settings["user"],
        "password": settings["password"],
        "fetchsize": str(settings.get("fetchsize", 10_000)),
    }
    is_query = name.lstrip().lower().startswith(("select", "with"))
    partition = settings.get("partition", {}).get(name)
    if not partition and name.rpartition(".")[2] in (SALES_TABLE, COSTS_TABLE) and not settings.get("single_reader"):
        raise ValueError(f"{name} is read by one task unless the settings give it a partition")
    if is_query and partition:
        if name.lstrip().lower().startswith("with"):
            raise ValueError("a query that starts with WITH can't be split; give its view a name")
        options["dbtable"] = f"({name}) split_query"
    elif is_query:
        options["query"] = name
    else:
        schema = settings.get("schema", "dbo")
        options["dbtable"] = name if "." in name else f"{schema}.{name}"
    if partition:
        options.update(
            partitionColumn=partition["column"],
            lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]),
            numPartitions=str(partition["count"]),
        )
    return options


def read_table(spark: SparkSession, name: str, source: Mapping | str | Path) -> DataFrame:
    """One whole table or view. `source["format"]` is jdbc (default) or a file format."""
    settings = load_settings(source)
    kind = settings.get("format", "jdbc")
    reader: DataFrameReader = spark.read.format(kind)
    if kind == "jdbc" and needs_months(settings, name):
        return read_by_month(spark, name, settings)
    if kind == "jdbc":
        return reader.options(**jdbc_options(settings, name)).load()
    suffix = settings.get("suffix", f".{kind}")
    return reader.options(**settings.get("options", {})).load(f"{settings['path']}/{name}{suffix}")


def load_sales(spark: SparkSession, source) -> DataFrame:
    return schemas.conform(read_table(spark, SALES_TABLE, source), schemas.SALES)


def load_costs(spark: SparkSession, source) -> DataFrame:
    return schemas.conform(read_table(spark, COSTS_TABLE, source), schemas.COSTS)


def load_stores(spark: SparkSession, source) -> DataFrame:
    return schemas.conform(read_table(spark, SALESORG_TABLE, source), schemas.SALESORG)


def load_locations(spark: SparkSession, source) -> DataFrame:
    return schemas.conform(read_table(spark, LOCATION_TABLE, source), schemas.LOCATION)


class SourceTables:
    """The sources of a comparison from one database or folder, with the configured stores."""

    def __init__(self, spark: SparkSession, source: Mapping | str | Path, stores=config.STORES):
        self._spark = spark
        self._source = load_settings(source)
        self._stores = stores

    @cached_property
    def sales(self) -> DataFrame:
        return load_sales(self._spark, self._source)

    @cached_property
    def costs(self) -> DataFrame:
        return load_costs(self._spark, self._source)

    @cached_property
    def stores(self) -> DataFrame:
        return load_stores(self._spark, self._source)

    @cached_property
    def locations(self) -> DataFrame:
        return load_locations(self._spark, self._source)

    @cached_property
    def registry(self) -> DataFrame:
        return store_registry(self._spark, self._stores)
