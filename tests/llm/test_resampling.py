"""Importance resampling against a plain version, SQL, and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import connect, mismatch
from shopgauge.llm import queries, resampling
from shopgauge.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
LETTERS = ["a", "B", "é", "文", " ", "  ", "\n", "1", "_", "zz", "\x00", "\x7f", "Z", "z9"]


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(own), own + [" ".join(p) for p in zip(own, own[1:])]


def plain(rows, target, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, counts in (([r[1] for r in rows], s), (target, t)):
        for text in texts:
            counts.update(map(bucket, plain_features(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets)))) for k in range(buckets)]
    out = []
    for i, text in rows:
        n, found = plain_features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append((i, n >= least, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u)))))
    order = sorted((r for r in out if r[1]), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter(r[0] for r in order[: percent * len(order) // 100])
    return sorted(r[:1] + r[2:] for r in out if r[0] is not None), drawn


def test_features_of_each_text():
    rng, joined = random.Random(2), resampling.Joined()
    texts = ["".join(rng.choices(LETTERS, k=rng.choice([0, 1, 2, 30]))) for _ in range(300)] + ["x" * 70_000 + " y " + "q" * 300]
    for chunk in (texts, texts[:1], [""], ["", ""], ["a"], ["a", ""], texts[5:40], []):
        found = resampling.features(pa.array(chunk, pa.large_string()), 10_000, joined)
        for i, text in enumerate(chunk):
            got = sorted(found.words[found.word_of == i].tolist() + found.pairs[found.pair_of == i].tolist())
            n, features = plain_features(text)
            assert found.n_words[i] == n and got == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def test_crc_of_joined_parts():
    rng, joined = random.Random(4), resampling.Joined()
    parts = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 5, 300]))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    assert joined(crc(0), crc(1), np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_query_against_sql(spark):
    assert mismatch(queries.op11_arrow_resampling(spark, SF), connect(SF), ORACLE["op11_arrow_resampling"]) is None


def test_awkward_tables(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["red", "Blue", "grün", "x1", "of"], k=rng.choice([0, 5, 19, 20, 60])))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "..."), (None, "red " * 30), (5, rows[5][1]), (300, "blue " * 40_000)] + [(400, "of red " * 20)] * 30
    target = ["red red x1", None, "", "grün blue"]
    docs = spark.createDataFrame([(*r, 1, "s", 2, "k") for r in rows], "doc_id long, text string, score int, rank string, place int, _range string").repartition(4)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(docs, goal).collect()
    expected, drawn = plain(rows, target)
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == expected
    assert Counter(r.doc_id for r in got if r["rank"]) == drawn
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, sum(drawn.values()) + 1)) and len(got) == len(rows)
    assert resampling.resample(docs.where("false"), goal).count() == 0
    assert resampling.resample(docs, goal.where("false")).count() == len(rows)


@pytest.mark.parametrize("buckets", [1, 7, 100])
def test_other_settings(spark, buckets):
    rng = random.Random(buckets)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 12)))) for i in range(40)]
    s = resampling.Settings(buckets=buckets, least_words=4, percent=50, seed=3)
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b c",)], "text string")
    got = resampling.resample(docs, goal, s).collect()
    expected, drawn = plain(rows, ["a b c"], buckets, 4, 50, 3)
    assert sorted(tuple(r)[:4] for r in got) == expected and Counter(r.doc_id for r in got if r["rank"]) == drawn
