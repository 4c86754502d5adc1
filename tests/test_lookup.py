"""Name matching against a plain loop over the registry."""

from __future__ import annotations

import random

from shopgauge import config
from shopgauge.operators import lookup
from shopgauge.schemas import CATEGORY_REGISTRY
from shopgauge.sources.registry import category_names, category_registry, store_registry


def loop(name, entries):
    if name is None:
        return None
    low = name.lower()
    return next((short for _, entry, short in entries if entry.lower() in low or low in entry.lower()), None)


def matched(spark, rows, entries, **options):
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(rows)], "row int, given_name string")
    registry = spark.createDataFrame(entries, CATEGORY_REGISTRY)
    result = lookup.match_name(frame, registry, "given_name", "found", **options)
    return {r.row: r.found_short for r in result.collect()}


def test_configured_stores(spark):
    frame = spark.createDataFrame(
        [("Freiburg",), ("FREIBURG IM BREISGAU",), ("Freiburg/Karlsruhe",), ("Filiale Rosenheim Süd",), ("Ulm",), ("",), (None,)],
        "StoreName string")
    got = lookup.match_name(frame, store_registry(spark), "StoreName", "registry")
    assert {r.StoreName: r.registry_short for r in got.collect()} == {
        "Freiburg": "FRE", "FREIBURG IM BREISGAU": "FRE", "Freiburg/Karlsruhe": "KAR",
        "Filiale Rosenheim Süd": "ROS", "Ulm": None, "": "ROS", None: None}


def test_configured_categories(spark):
    frame = category_names(spark, config.RULES_V2)
    got = lookup.match_name(frame, category_registry(spark), "name", "category")
    assert {(r.name, r.category_short) for r in got.collect()} == {
        ("City Bikes", "CITY"), ("E-Trekking", "ETRK"), ("Kid Bikes", "KIDS"), ("Mountain Bikes", "MTB"),
        ("Race Bikes", "RACE"), ("Trekking Bikes", "TREK")}


def test_random_names_against_a_loop(spark):
    rng = random.Random(7)
    for size in (1, 5, 40):
        entries = [(i, "".join(rng.choices("abAB ", k=rng.randint(1, 5))), f"e{i}") for i in range(size)]
        names = ["".join(rng.choices("abAB ", k=rng.randint(0, 7))) for _ in range(120)] + [None]
        expected = {i: loop(n, entries) for i, n in enumerate(names)}
        assert matched(spark, names, entries) == expected
        known = spark.createDataFrame([(n,) for n in set(names)] + [("unused",)], "n string")
        assert matched(spark, names, entries, names=known) == expected


def test_long_names_and_one_hot_name(spark):
    entries = [(0, "needle", "n"), (1, "x" * 50 + "needle", "x")]
    names = ["hay " * 300 + "NEEDLE"] + ["nee"] * 500 + ["other"]
    got = matched(spark, names, entries)
    assert got == {i: loop(n, entries) for i, n in enumerate(names)}


def test_empty_registry(spark):
    assert matched(spark, ["a", ""], []) == {0: None, 1: None}


def test_store_by_id(spark):
    frame = spark.createDataFrame([(14,), (99,)], "IdStore int")
    got = {r.IdStore: r.registry_short for r in lookup.with_store(frame, store_registry(spark)).collect()}
    assert got == {14: "ROS", 99: None}


def test_columns_of_the_input_stay(spark):
    frame = spark.createDataFrame([("Ulm", 1, 2, 3)], "name string, given int, entry int, hit int")
    got = lookup.match_name(frame, store_registry(spark), "name", "store")
    assert got.drop("store_name", "store_short").first() == frame.first()
