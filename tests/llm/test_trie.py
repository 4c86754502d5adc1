"""The prefix trie of conversations against a plain version and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from checks.compare import connect, mismatch
from shopgauge.llm import queries, trie
from shopgauge.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, pos string, digest int, total string, long string"


def order(row):
    return tuple((x is not None, x) for x in row)


def plain(rows, spread=9, group=5):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [v for _, v in sorted(x, key=lambda i: i[0])] for c, x in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % spread
        donor = c - (abs(c) % group) * (1 if c >= 0 else -1)
        path = tuple(own.get(donor, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=order
    )


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), None, -3, -4, -5, 1000]:
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["u", "u", "u", None]), rng.choice(["a", "a", "a", "bé", None, "a"])))
    return rows + [(7, 1, "u", "a")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("settings", [trie.Settings(), trie.Settings(longest=3, shard_turns=20), trie.Settings(longest=5, shard_turns=1)])
def test_nodes(spark, settings):
    """Long conversations in segments, shards of a few turns, ties, nulls, negative ids and repeated rows."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if settings.longest < 9 else old)
    try:
        for seed in (1, 2):
            rows = some_rows(seed)
            found = trie.prefix_nodes(*trie.rebuilt(trie.numbered(frame(spark, rows))), settings)
            assert sorted(map(tuple, found.collect()), key=order) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_hot_conversation_and_empty_table(spark):
    """A third of all conversations are equal, and one has a third of all turns."""
    rows = [(5 * i, t, "user", f"turn {t}") for i in range(120) for t in range(3)] + [(3000, t, "user", "long " * 50) for t in range(700)]
    rows += [(5 * i + 1, t, "user", f"own {i} {t}") for i in range(120) for t in range(2)]
    found = trie.prefix_nodes(*trie.rebuilt(trie.numbered(frame(spark, rows))), trie.Settings(longest=64))
    assert sorted(map(tuple, found.collect()), key=order) == plain(rows)
    none = trie.prefix_nodes(*trie.rebuilt(trie.numbered(frame(spark, rows).where("false"))))
    assert none.count() == 0 and none.columns == found.columns


def test_query_against_sql(spark):
    assert mismatch(queries.op13_double_array(spark, SF), connect(SF), ORACLE["op13_double_array"]) is None


def test_double_array_keeps_every_child():
    rng = np.random.default_rng(3)
    array, kids, front, used = trie.DoubleArray(5000), {}, np.array([0]), set()
    for _ in range(6):
        parents, turns = [], []
        for s in front.tolist():
            own = np.sort(rng.choice(np.arange(1, 5001), size=int(rng.choice([1, 1, 2, 3, 40])), replace=False))
            parents += [s] * len(own)
            turns += own.tolist()
        order_ = np.lexsort((turns, parents))
        p, t = np.array(parents)[order_], np.array(turns)[order_]
        array.add(p, t)
        kids |= dict(zip(zip(p.tolist(), t.tolist()), array.step(p, t).tolist()))
        assert len(set(kids.values())) == len(kids) and 0 not in kids.values()
        front = rng.permutation(array.step(p, t))[:400]
        used.update(front.tolist())
    for (s, t), to in kids.items():
        assert array.step(np.array([s]), np.array([t]))[0] == to
    with pytest.raises(AssertionError):
        array.step(np.array([0]), np.array([-1]))
