"""Reading the source tables, registering views and writing the export."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from shopgauge import config
from shopgauge.plans.benchmark import Benchmark
from shopgauge.plans.catalog import list_views, register_views
from shopgauge.schemas import as_doubles
from shopgauge.sources import sink, tables


@pytest.fixture(scope="module")
def folder(sources, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    frames = {tables.SALES_TABLE: sources.sales, tables.COSTS_TABLE: sources.costs,
              tables.SALESORG_TABLE: sources.stores, tables.LOCATION_TABLE: sources.locations}
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return path


def test_files_from_settings_in_json(spark, folder, v2, tmp_path):
    settings = tmp_path / "config.json"
    settings.write_text(json.dumps({"format": "parquet", "path": str(folder)}))
    read = tables.SourceTables(spark, settings)
    assert sorted(Benchmark(read).export_v2.collect()) == sorted(v2.export_v2.collect())
    assert read.locations.count() == 3
    assert [r.id for r in read.registry.orderBy("ord").collect()] == [14, 5, 3]


def test_timestamps_and_dates_give_the_same(spark, sources, v2):
    stamped = sources.sales.selectExpr("* except (ID_CALMONTH)", "CAST(ID_CALMONTH AS TIMESTAMP) AS ID_CALMONTH")
    got = Benchmark(type(sources)(**{**vars(sources), "sales": stamped}), period="2024-09").export_v2
    assert sorted(got.collect()) == sorted(v2.export_v2.where("Monat = '2024-09'").collect())


SETTINGS = {"server": "db,1433", "database": "erp", "user": "u", "password": "p"}


def test_jdbc_table():
    options = tables.jdbc_options(SETTINGS, "T_SALESORG")
    assert options["url"] == "jdbc:sqlserver://db:1433;databaseName=erp;encrypt=false"
    assert (options["dbtable"], options["user"], options["password"]) == ("dbo.T_SALESORG", "u", "p")
    assert "numPartitions" not in options


def test_jdbc_parallel_read():
    split = {"V": {"column": "ID_STORE", "lower": 0, "upper": 100, "count": 10}}
    options = tables.jdbc_options({**SETTINGS, "partition": split}, "V")
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == (
        "ID_STORE", "0", "100", "10")


def test_jdbc_facts_need_a_partition():
    with pytest.raises(ValueError, match="one task"):
        tables.jdbc_options(SETTINGS, "V_LIST_MONTHLY_SALES")
    assert tables.jdbc_options({**SETTINGS, "single_reader": True}, "V_LIST_MONTHLY_SALES")["dbtable"] == "dbo.V_LIST_MONTHLY_SALES"


def test_jdbc_split_query():
    text = "SELECT ID_STORE FROM x"
    split = {text: {"column": "ID_STORE", "lower": 0, "upper": 100, "count": 10}}
    options = tables.jdbc_options({**SETTINGS, "partition": split}, text)
    assert options["dbtable"] == f"({text}) split_query" and options["numPartitions"] == "10"
    assert tables.jdbc_options(SETTINGS, "WITH a AS (SELECT 1 x) SELECT x FROM a")["query"].startswith("WITH")


def test_jdbc_query():
    options = tables.jdbc_options(SETTINGS, "SELECT 1 AS x")
    assert options["query"] == "SELECT 1 AS x" and "dbtable" not in options


@pytest.mark.parametrize("generation, names", [
    ("v1", ["costs_agg", "export_monthly", "kpi", "sales_agg", "sales_std", "store_comparison"]),
    ("v2", ["costs_agg", "costs_detail", "export_monthly", "kpi", "sales_agg", "sales_std", "waterfall"]),
])
def test_views(spark, sources, generation, names):
    prefix = f"check_{generation}_"
    registered = register_views(sources, generation, prefix=prefix)
    assert sorted(registered) == [prefix + n for n in names]
    assert [r.view_name for r in list_views(spark, prefix).collect()] == [prefix + n for n in names]
    for name in registered:
        assert spark.table(name).count() > 0


def test_views_answer_the_documented_questions(spark, sources):
    register_views(sources, "v2", prefix="doc_")
    best = spark.sql("""SELECT BenchmarkCategory, sum(TotalRevenueEur) AS r, sum(TotalQuantity) AS q
        FROM doc_sales_agg GROUP BY 1 ORDER BY r DESC""").first()
    assert (best.BenchmarkCategory, best.q) == ("E-Trekking", 3)
    latest = spark.sql("""SELECT Monat, Filialgruppe, NettogewinnMargeProzent FROM doc_export_monthly
        ORDER BY Monat DESC, Filialgruppe""").first()
    assert (latest.Monat, float(latest.NettogewinnMargeProzent)) == ("2024-10", -100)


def test_unknown_generation(sources):
    with pytest.raises(ValueError):
        register_views(sources, "v3")


@pytest.mark.parametrize("period, rows", [("all", 5), ("2024-10", 2)])
def test_csv(spark, v2, tmp_path, period, rows):
    export = as_doubles(v2.export_v2)
    target = sink.write_csv(export, str(tmp_path), period)
    assert target.endswith(f"benchmark_export_{period}.csv")
    back = spark.read.schema(export.schema).option("header", True).csv(target)
    expected = export if period == config.ALL_PERIODS else export.where(f"Monat = '{period}'")
    key = lambda r: (r.Monat, r.IdStore)
    assert sorted(back.collect(), key=key) == sorted(expected.collect(), key=key)
    assert back.count() == rows


def test_csv_overwrites(spark, v2, tmp_path):
    for _ in range(2):
        target = sink.write_csv(as_doubles(v2.export_v2), str(tmp_path))
    assert spark.read.option("header", True).csv(target).count() == 5


# ---- facts over JDBC, a read per month --------------------------------------------------


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("first, last", [("2023-11-05", "2024-02-20"), ("2024-01-01", "2024-01-31"), ("2023-12-31", "2024-12-01")])
def test_months_hold_every_row_once(spark, first, last, parts):
    predicates = tables.month_predicates(dt.date.fromisoformat(first), dt.date.fromisoformat(last), "d", "n", parts)
    months = (int(last[:4]) - int(first[:4])) * 12 + int(last[5:7]) - int(first[5:7]) + 1
    assert len(predicates) == months * parts
    rows = spark.sql("SELECT explode(sequence(DATE'2023-01-01', DATE'2025-12-31', INTERVAL 5 DAY)) AS d").selectExpr("d", "CAST(dayofyear(d) - 180 AS INT) AS n")
    rows = rows.unionByName(spark.createDataFrame([(None, None), (None, 4), (dt.date(2024, 1, 1), None)], "d date, n int"))
    hits = rows.selectExpr(" + ".join(f"CAST(coalesce({p}, false) AS INT)" for p in predicates) + " AS hits")
    assert [r.hits for r in hits.distinct().collect()] == [1]


class Reader:
    """Keeps what it is asked for, and answers the query for the smallest and largest month."""

    def __init__(self, bounds):
        self.bounds, self.asked = bounds, []

    read = property(lambda self: self)

    def format(self, kind):
        assert kind == "jdbc"
        return self

    def options(self, **options):
        self.asked.append(options)
        return self

    def load(self):
        return self

    def first(self):
        return self.bounds

    def jdbc(self, url, table, predicates, properties):
        self.asked.append({"url": url, "dbtable": table, "predicates": predicates, **properties})
        return self


def test_facts_are_read_by_month():
    reader = Reader((dt.datetime(2024, 1, 15), dt.datetime(2024, 3, 1)))
    tables.read_table(reader, "V_LIST_MONTHLY_SALES", {**SETTINGS, "month_split": {"column": "ID_STORE", "count": 2}})
    bounds, read = reader.asked
    assert bounds["query"] == "SELECT min(ID_CALMONTH) AS first_month, max(ID_CALMONTH) AS last_month FROM dbo.V_LIST_MONTHLY_SALES"
    assert "dbtable" not in bounds and read["dbtable"] == "dbo.V_LIST_MONTHLY_SALES" and read["user"] == "u"
    assert len(read["predicates"]) == 6 and read["predicates"][0].startswith("(ID_CALMONTH < CAST('2024-02-01' AS DATE) OR ID_CALMONTH IS NULL)")


def test_empty_facts_and_other_tables_are_read_at_once():
    reader = Reader((None, None))
    tables.read_table(reader, "V_LIST_MONTHLY_COSTS", SETTINGS)
    assert reader.asked[1]["dbtable"] == "dbo.V_LIST_MONTHLY_COSTS"
    for name, settings in (("T_SALESORG", SETTINGS), ("V_LIST_MONTHLY_SALES", {**SETTINGS, "single_reader": True}),
                           ("V_LIST_MONTHLY_SALES", {**SETTINGS, "partition": {"V_LIST_MONTHLY_SALES": {"column": "a", "lower": 0, "upper": 1, "count": 2}}})):
        assert not tables.needs_months(settings, name)
