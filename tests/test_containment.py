"""Containment by rare pieces against plain loops, and what is built on it."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopgauge import config
from shopgauge.config import CategoryRules
from shopgauge.functions.expressions import classified, free_name
from shopgauge.operators import containment, location, lookup, ruletable
from shopgauge.schemas import CATEGORY_REGISTRY, STORE_REGISTRY
from shopgauge.sources.registry import store_registry
from tests.test_lookup import loop
from tests.test_plans import plan


def some_texts(seed, n, most, letters="abAB é"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]


def test_pieces(spark):
    frame = spark.createDataFrame([("",), ("a",), ("ab",), ("abab",), (None,)], "t string")
    got = [(r.t, sorted(r.p) if r.p else r.p, r.w) for r in frame.select("t", containment.pieces(F.col("t")).alias("p"), containment.whole_pieces(F.col("t")).alias("w")).collect()]
    assert got[:4] == [
        ("", [""], [""]), ("a", ["", "a"], ["a"]), ("ab", ["", "a", "ab", "b"], ["ab"]),
        ("abab", ["", "a", "ab", "aba", "b", "ba", "bab"], ["aba", "bab"])]


def test_pieces_grow_with_the_length(spark):
    rows = spark.range(1).select(F.expr("array_join(transform(sequence(1, 4000), i -> cast(i * 7919 as string)), ' ')").alias("t"))
    found = rows.select(F.length("t").alias("n"), F.size(containment.pieces(F.col("t"))).alias("p")).first()
    assert found.p <= 3 * found.n + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contained_pairs(spark, seed):
    texts, parts = some_texts(seed, 60, 9), some_texts(seed + 10, 40, 5)
    left = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    right = spark.createDataFrame([(p,) for p in [*parts, None]], "part string")
    got = containment.contained(left, "text", right, "part").collect()
    expected = {(t, p) for t in texts for p in parts if p in t}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_sums_by_names_out_of_the_facts(spark):
    rng = random.Random(5)
    entries = [(i, "".join(rng.choices("abAB ", k=rng.randint(1, 5))), f"e{i}") for i in range(20)]
    names = [*some_texts(6, 50, 7), None, "", "AB", "ab"]
    rows = [(n, m, Decimal(v)) for n in names for m in (1, 2) for v in range(rng.randint(1, 4))]
    facts = spark.createDataFrame(rows, "name string, month int, value decimal(19,4)")
    registry = spark.createDataFrame(entries, CATEGORY_REGISTRY)
    got = lookup.match_sums(facts, registry, "name", "found", ["month"], {"total": F.sum("value"), "n": F.count("*")})
    assert plan(got, "simple").count("Scan ExistingRDD[name#") == 1
    plain = {}
    for n, m, v in rows:
        total, count = plain.get((n, m), (0, 0))
        plain[n, m] = (total + v, count + 1)
    assert {(r["name"], r.month): (r.total, r.n, r.found_short) for r in got.collect()} == {k: (*v, loop(k[0], entries)) for k, v in plain.items()}


def test_sums_with_an_empty_side(spark):
    facts = spark.createDataFrame([("a", 1)], "name string, value int")
    registry = spark.createDataFrame([(0, "a", "A")], CATEGORY_REGISTRY)
    assert lookup.match_sums(facts.where("false"), registry, "name", "x", [], {"s": F.sum("value")}).isEmpty()
    assert lookup.match_sums(facts, registry.where("false"), "name", "x", [], {"s": F.sum("value")}).collect() == [("a", 1, None, None)]


# ---- areas by name ----------------------------------------------------------------------

AREAS = [
    (1, "Filiale ROSENHEIM", "900"), (2, "Karlsruhe/Rosenheim", "1500"), (3, "karlsruhe", "800"), (4, "Freiburg", "77"), (5, None, "5"),
]


def test_areas_by_name(spark):
    areas = spark.createDataFrame([(i, n, Decimal(a)) for i, n, a in AREAS], "row int, StoreName string, LOC_SIZE_M2 decimal(12,2)")
    got = {r.id: int(r.size_m2) for r in location.areas_by_name(areas, store_registry(spark), ["row"]).collect()}
    # The last row counts; "Freiburg" does not contain "Freiburg im Breisgau".
    assert got == {14: 1500, 3: 800}
    backwards = areas.withColumn("row", -F.col("row"))
    assert {r.id: int(r.size_m2) for r in location.areas_by_name(backwards, store_registry(spark), ["row"]).collect()} == {14: 900, 3: 1500}


def test_unknown_last_area_counts_as_default(spark, kpis):
    areas = spark.createDataFrame([(1, "Rosenheim", Decimal(900)), (2, "Rosenheim", None)], "row int, StoreName string, LOC_SIZE_M2 decimal(12,2)")
    sized = location.with_size_by_name(kpis, areas, store_registry(spark), ["row"])
    assert {r.store_id: int(r.size_m2) for r in sized.collect()} == {14: 1, 5: 1, 3: 1}
    assert sized.columns == [*kpis.columns, "size_m2"] or set(sized.columns) == {*kpis.columns, "size_m2"}


def test_stores_with_the_same_name_share_the_area(spark):
    registry = spark.createDataFrame([(0, 1, "Ulm", "U"), (1, 2, "ULM", "V"), (2, 3, None, "W")], STORE_REGISTRY)
    areas = spark.createDataFrame([("Ulm Mitte", Decimal(7))], "StoreName string, LOC_SIZE_M2 decimal(12,2)")
    assert {r.id: int(r.size_m2) for r in location.areas_by_name(areas, registry, []).collect()} == {1: 7, 2: 7}


# ---- categories from a rule table -------------------------------------------------------

PATTERNS = ["%ab%", "a%", "%b", "b_a", "%", "a", "%a%b%", "_b%", "%é%", "", r"a\%%", "% %"]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_rule_table_against_predicates(spark, case_sensitive):
    rng = random.Random(9)
    texts = [*some_texts(4, 150, 6), None, "a%", "A%b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "text int, desc string").withColumnRenamed("text", "found")
    for size in (1, 3, 6):
        classes = tuple((f"c{i}", tuple(rng.sample(PATTERNS, 2))) for i in range(size))
        rules = CategoryRules(classes, "none", case_sensitive)
        expected = {r.found: r.BenchmarkCategory for r in classified(frame, "desc", rules).collect()}
        got = ruletable.classified_by_table(frame, "desc", ruletable.rule_table(spark, rules), "none", case_sensitive=case_sensitive)
        assert {r.found: r.BenchmarkCategory for r in got.collect()} == expected and got.columns == [*frame.columns, "BenchmarkCategory"]


def test_many_rules_make_no_longer_plan(spark):
    frame = spark.createDataFrame([(i, f"model {i} x") for i in range(200)], "id int, desc string")
    few, many = (
        ruletable.classified_by_table(frame, "desc", spark.range(n).selectExpr("int(id) AS ord", "'c' || id AS category", "'%model ' || id || ' %' AS pattern"), "none")
        for n in (10, 10_000)
    )
    assert len(plan(many, "simple")) <= len(plan(few, "simple")) + 50
    assert {r.id: r.BenchmarkCategory for r in many.collect()} == {i: f"c{i}" for i in range(200)}


def test_configured_rules(spark):
    names = ["Grace MX", "Cube Trekking Pedelec", "rixe COMP", "Corona", "unknown", None]
    frame = spark.createDataFrame([(n,) for n in names], "desc string")
    rules = ruletable.rule_table(spark, config.RULES_V2)
    got = ruletable.classified_by_table(frame, "desc", rules, config.RULES_V2.fallback)
    assert sorted(map(str, got.collect())) == sorted(map(str, classified(frame, "desc", config.RULES_V2).collect()))
    unusable = rules.select(F.lit(None).cast("int").alias("ord"), "category", "pattern")
    assert {r.BenchmarkCategory for r in ruletable.classified_by_table(frame, "desc", unusable, "none").collect()} == {"none"}


def test_free_names(spark):
    frame = spark.createDataFrame([("A", 1, 2)], "desc string, LOWER int, _lower int")
    assert free_name(frame, "lower") == "__lower" and free_name(frame, "x") == "x"
    assert classified(frame, "desc", config.RULES_V1).columns == [*frame.columns, "BenchmarkCategory"]
