"""Text forms, wildcard rules, ratios and column discovery."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shopgauge import config
from shopgauge.config import CategoryRules, CostBucket
from shopgauge.functions import expressions as ex
from shopgauge.functions import formats as fm
from shopgauge.operators import lookup


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(expression).collect()]


def python_eur(value):
    if value >= 1_000_000:
        return f"{value / 1_000_000:.1f} Mio €"
    if value >= 1_000:
        return f"{value / 1_000:.0f} Tsd €"
    return f"{value:,.0f} €"


AMOUNTS = [0.0, 0.5, 1.5, 2.5, 999.4, 999.5, 999.99, 1000.0, 1500.0, 2500.0, 999999.0, 1e6, 1.25e6, 1.35e6, 2.5e9,
           12345678901.0, -1.0, -1234.5, -1e6, -12345678.9, 0.25]


def test_currency(spark):
    assert values(spark, AMOUNTS, "v double", fm.fmt_eur(F.col("v"))) == [python_eur(v) for v in AMOUNTS]


def test_percent(spark):
    rows = [0.25, 0.35, -0.25, 12.34, 1234.56, 5.0]
    assert values(spark, rows, "v double", fm.fmt_pct(F.col("v"))) == [f"{v:.1f}%" for v in rows]


def test_signed_change(spark):
    rows = [2.34, -2.34, 0.0, None]
    assert values(spark, rows, "v double", fm.signed_pct(F.col("v"))) == ["+2.3%", "-2.3%", None, None]
    assert values(spark, rows, "v double", fm.change_class(F.col("v"))) == ["positive", "negative", "neutral", None]


def test_trend(spark):
    rows = [3.0, 3.01, -3.0, -3.01, 0.0]
    assert values(spark, rows, "v double", fm.trend_band(F.col("v"))) == ["flat", "up", "flat", "down", "flat"]
    assert values(spark, rows, "v double", fm.trend_arrow(F.col("v"))) == ["➡️", "↗️", "➡️", "↘️", "➡️"]


def test_ratio_guards(spark):
    rows = [(1, 4), (1, 0), (1, -2), (None, 3), (1, None)]
    frame = spark.createDataFrame(rows, "n int, d int")
    got = frame.select(ex.pct(F.col("n"), F.col("d")), ex.pct(F.col("n"), F.col("d"), 0.0)).collect()
    assert [r[0] for r in got] == [25.0, None, None, None, None]
    assert [r[1] for r in got] == [25.0, 0.0, 0.0, None, 0.0]


def test_rounding_is_half_away_from_zero(spark):
    got = spark.sql("SELECT CAST(v AS DECIMAL(19,4)) AS v FROM VALUES (1.005), (-1.005), (2.675), (0.0049) t(v)")
    assert [str(r[0]) for r in got.select(ex.round2(F.col("v"))).collect()] == ["1.01", "-1.01", "2.68", "0.00"]


def test_rules_ignore_case_unless_told(spark):
    names = ["JMS E-BIKE", "s-pedelec", "Leopard", "kathmandu pro", None, "", "x"]
    got = values(spark, names, "v string", ex.classify(F.lower("v"), config.RULES_V2))
    assert got == ["E-Trekking", "E-Trekking", "Kid Bikes", "Trekking Bikes", "City Bikes", "City Bikes", "City Bikes"]
    strict = CategoryRules(config.RULES_V2.classes, config.RULES_V2.fallback, case_sensitive=True)
    assert values(spark, names[:2], "v string", ex.classify(F.col("v"), strict)) == ["City Bikes", "City Bikes"]


def test_rule_order_and_wildcards(spark):
    rules = CategoryRules((("A", ("a_c%",)), ("B", ("%b%",))), "rest")
    assert values(spark, ["abcd", "ac", "xb", "zz"], "v string", ex.classify(F.lower("v"), rules)) == [
        "A", "rest", "B", "rest"]


def test_buckets(spark):
    bucket = CostBucket(equals=("Rent",), prefixes=("Extra",))
    rows = ["rent", "Rent a car", "extra for x", "an extra", None]
    assert values(spark, rows, "v string", ex.in_bucket(F.col("v"), bucket)) == [True, False, True, False, False]
    assert values(spark, rows, "v string", ex.in_bucket(F.col("v"), bucket, True)) == [False] * 5


def test_money_mean_rounds_half_up_to_four_places(spark):
    frame = spark.sql("SELECT CAST(v AS DECIMAL(19,4)) AS v FROM VALUES (0.0001), (0.0002), (NULL) t(v)")
    assert str(frame.agg(ex.money_mean(F.col("v"))).first()[0]) == "0.0002"
    assert frame.where("v IS NULL").agg(ex.money_mean(F.col("v"))).first()[0] is None


def test_find_column(spark):
    frame = spark.createDataFrame([(1, 2.0, None)], "UmsatzEur int, NettogewinnMargeProzent double, Leer double")
    assert lookup.find_col(frame, "monat", "UMSATZ") == "UmsatzEur"
    assert lookup.find_col(frame, "nichts") is None
    row = frame.agg(
        lookup.safe_sum(frame, "umsatz").alias("a"),
        lookup.safe_mean(frame, "marge").alias("b"),
        lookup.safe_sum(frame, "nichts").alias("c"),
        lookup.safe_mean(frame, "nichts").alias("d"),
        lookup.safe_sum(frame, "leer").alias("e"),
        lookup.safe_mean(frame, "leer").alias("f"),
    ).first()
    assert tuple(row) == (1, 2.0, 0, 0.0, 0.0, None)


@pytest.mark.parametrize("month, expected", [("2024-02-29", "2024-02"), ("1999-12-31", "1999-12")])
def test_month_key(spark, month, expected):
    frame = spark.sql(f"SELECT DATE'{month}' AS d, TIMESTAMP'{month} 23:59:59' AS t, TIMESTAMP_NTZ'{month} 23:59:59' AS n")
    got = frame.select(*[ex.month_key(F.col(c)) for c in "dtn"], *[ex.month_key(ex.month_start(F.col(c))) for c in "dtn"])
    assert set(got.first()) == {expected}
