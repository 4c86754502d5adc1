"""Corpus operators used again, on hot groups, and where a bound decided before."""

from __future__ import annotations

import random

import duckdb
import pytest
from brute import contaminated
from pyspark.sql import functions as F

from shopgauge.llm import decontaminate, exactdup, neardup, pii, toxicity
from shopgauge.llm.oracle import ORACLE
from shopgauge.llm.shared import shared_folder


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- digest index -----------------------------------------------------------------------


def test_groups_grow_over_all_batches(spark):
    """3, 2 and 1 copies in three batches, and once more after the index is opened again."""
    folder = shared_folder(spark)
    index = exactdup.DigestIndex(spark, folder)
    sizes = []
    for start, copies in ((1, 3), (10, 2), (20, 1)):
        batch = frame(spark, [(start + i, "same text") for i in range(copies)] + [(start + 5, f"own {start}")])
        found = {r.doc_id: r for r in exactdup.deduplicate(batch, index).collect()}
        sizes.append((found[start].group_size, found[start].keep_id, found[start].kept, found[start + 5].kept))
    assert sizes == [(3, 1, True, True), (5, 1, False, True), (6, 1, False, True)]
    index.close()
    assert not spark.catalog.tableExists(index.table)
    again = exactdup.DigestIndex(spark, folder, expected=10**12)
    assert again.buckets == index.buckets
    found = exactdup.deduplicate(frame(spark, [(30, "same text"), (31, None)]), again).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found} == {(30, 1, 7, False), (31, 31, 1, True)}
    again.close()


def test_buckets_follow_the_expected_size(spark):
    sizes = [exactdup.DigestIndex(spark, shared_folder(spark), n) for n in (0, 10**9, 10**15)]
    assert [i.buckets for i in sizes] == [48, 250, 100_000]
    for index in sizes:
        index.close()


def test_unknown_ids_stay_unknown(spark):
    index = exactdup.DigestIndex(spark, shared_folder(spark))
    for size in (1, 2):
        found = exactdup.deduplicate(frame(spark, [(None, "x")]), index).collect()
        assert [(r.doc_id, r.keep_id, r.group_size) for r in found] == [(None, None, size)]
    index.close()


def test_the_index_side_is_not_shuffled(spark):
    from tests.test_plans import plan

    index = exactdup.DigestIndex(spark, shared_folder(spark))
    exactdup.deduplicate(frame(spark, [(i, f"text {i}") for i in range(50)]), index).collect()
    assert "hashpartitioning" not in plan(index.rows(), "simple") and "Bucketed: true" in plan(index.rows(), "simple")
    index.close()


# ---- near-duplicates --------------------------------------------------------------------


@pytest.mark.parametrize("strays", [1, 3])
def test_a_large_group_with_strays_is_sent_about_once(spark, strays):
    n, s = 20_000, neardup.Settings()
    rest = spark.range(n + strays).select(
        F.lit(1).cast("bigint").alias("bucket"), F.lit(n + strays).cast("bigint").alias("n"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("name"),
        F.unhex(F.lpad(F.hex(F.when(F.col("id") < n, 0).otherwise(F.col("id"))), 16, "0")).alias("root"),
    )
    dealt = neardup.blocks_of(rest, s)
    assert n < dealt.count() < 1.1 * n
    most = dealt.groupBy("bucket", "i", "j").count().agg(F.max("count")).first()[0]
    assert most < 1.5 * s.block


@pytest.mark.parametrize("block", [1, 3, 7])
def test_every_pair_of_different_roots_meets(spark, block):
    rng = random.Random(block)
    rows = [(b, 40, bytes([b, i]), bytes([rng.choice([0, 0, 0, 0, 1, 2, i])])) for b in (1, 2) for i in range(40)]
    rest = spark.createDataFrame(rows, "bucket long, n long, name binary, root binary")
    met, groups = set(), {}
    for r in neardup.blocks_of(rest, neardup.Settings(block=block)).collect():
        groups.setdefault((r.bucket, r.i, r.j), []).append(r)
    for (bucket, i, j), members in groups.items():
        for x in members:
            for y in members:
                if (i == j or (x.own == i and y.own == j)) and x.root != y.root:
                    met |= {(bucket, bytes(x.name), bytes(y.name)), (bucket, bytes(y.name), bytes(x.name))}
    assert met == {(b, m, k) for b, _, m, r in rows for c, _, k, q in rows if b == c and r != q}


# ---- labelled samples -------------------------------------------------------------------


def test_the_sample_has_a_row_per_id(spark):
    docs = frame(spark, [(1, f"copy {i}") for i in range(500)] + [(2, "two"), (3, None), (4, "four")])
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, "toxic", F.lit(True), 2).collect()
    assert len(rows) == 2 and len({r.doc_id for r in rows}) == 2
    every = toxicity.labelled(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in every) == [(1, 1), (2, 1), (3, 1)]
    again = toxicity.labelled(docs.repartition(7), labels, "toxic", F.lit(True), 10).collect()
    assert sorted(map(str, again)) == sorted(map(str, every))


# ---- personal data ----------------------------------------------------------------------


def test_instances_seed_further_patterns(spark):
    """`reach` is learned from addresses; what it finds teaches `handle is`, and that finds an identifier of its own."""
    rows = [(i, f"please reach user{i}@host{i}.example.org when it rains, number {i} of the list") for i in range(60)]
    rows += [(100 + i, f"please reach anna_{i}#host now and again") for i in range(20)]
    rows += [(200 + i, f"her handle is anna_{i}#host since spring") for i in range(20)]
    rows += [(300, "his handle is otto_x#place since spring"), (301, "the lid is a_b#c on top"), (302, "")]
    rows += [(400 + i, f"the sun is warm and it stays so for {i} days") for i in range(60)]
    found = {r.doc_id: [(s.kind, s.text) for s in r.more] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(found[100 + i] == [("email", f"anna_{i}#host")] for i in range(20))
    assert all(found[200 + i] == [("email", f"anna_{i}#host")] for i in range(20))
    assert found[300] == [("email", "otto_x#place")] and not found[301] and not found[302]


def test_words_of_any_length_are_whole_in_a_pattern():
    long = "y" * 300
    before = f"{long} {long}1 a_b#c {long}2 {long}"
    at = before.index("a_b#c")
    assert dict(pii._context(before, at, at + 5)) == {2: f"{long}1", 0: f"{long} {long}1", 1: f"{long}2 {long}"}
    spaced = f"one two{' ' * 500}a_b#c{' ' * 500}three four five"
    at = spaced.index("a_b#c")
    assert dict(pii._context(spaced, at, at + 5)) == {2: "two", 0: "one two", 1: "three four"}
    assert list(pii._context("a_b#c", 0, 5)) == []


def test_longer_runs_of_digits(spark):
    text = " ".join(["1234"] * 8)
    spans = {text[b:e] for b, e, _ in pii._identifiers(text, [], 19)}
    assert max(map(len, spans)) == 19 and max(len(text[b:e]) for b, e, _ in pii._identifiers(text, [], 100)) == len(text)


# ---- benchmark --------------------------------------------------------------------------

SOME = decontaminate.Settings()
FEW_BITS = decontaminate.Settings(blocks=16, flips=0, radius=2)


def some_documents(seed, items):
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 40]))]
        item = rng.choice(items).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            item[rng.randrange(len(item))] = f"x{rng.randrange(9)}"
        at = rng.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + item + own[at:])))
    return docs


@pytest.mark.parametrize("settings", [SOME, FEW_BITS, decontaminate.Settings(broadcast_bytes=0)])
def test_no_window_is_lost_beyond_the_radius(spark, settings):
    rng = random.Random(3)
    phrase = "all items begin with these very words and go on"
    items = [f"{phrase} {' '.join(f'w{rng.randrange(400)}' for _ in range(25))}" for _ in range(12)]
    docs = some_documents(4, items)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, docs), bench, settings).collect()}
    assert got == pytest.approx(contaminated(docs, list(enumerate(items)))) and len(got) > 15


def test_sql_knows_short_items(spark):
    docs = [(1, "Paris is the capital of France"), (2, "in PARIS"), (3, "paris,"), (4, None), (5, "the capital of"), (6, " ".join(f"t{i}" for i in range(30)))]
    items = [(1, "paris"), (2, "The capital"), (3, ""), (4, None), (5, " ".join(f"t{i}" for i in range(5, 25)))]
    con = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), bench).select("doc_id", "item_id", "start_word", "n_words", "similarity")
    theirs = con.execute(f"SELECT doc_id, item_id, start_word, n_words, similarity FROM ({ORACLE['op10_simhash']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(theirs) and len(theirs) == 5
    assert {(d, i) for d, i, *_ in theirs} == set(contaminated(docs, items))
