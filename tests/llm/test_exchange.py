"""The exchange of packed keys level by level: same answers as in one step, at a cost that does not grow with the corpus."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import without_repeats
from pyspark.sql import functions as F

from shopgauge.llm import katz, packed, passages

SMALL = {"batch_bytes": 1500, "per_shard": 40, "fan_bits": 2, "fan": 3}


def some_rows(seed, n=150):
    """Texts with a word and a passage that almost all of them hold, copies, empty and null texts, repeated and null ids."""
    rng = random.Random(seed)
    hot = " ".join(f"h{i}" for i in range(16))
    rows = []
    for i in range(n):
        own = [rng.choice(["the", "the", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([0, 3, 40, 120]))]
        at = rng.randint(0, len(own))
        rows.append((i, " ".join(own[:at] + ([hot] if rng.random() < 0.8 else []) + own[at:])))
    return rows + [(i, rows[5][1]) for i in range(n, n + 20)] + [(900, None), (901, ""), (5, rows[5][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_rows(1) + [(None, "the h0 h1")], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("settings", [SMALL, SMALL | {"fan_bits": 1, "fan": 2}, SMALL | {"fan": 1000}])
def test_scores_level_by_level(docs, settings):
    order = lambda r: (r[0] is None, r[0] or 0, r[2:4])
    one = sorted(map(tuple, katz.scores(docs).collect()), key=order)
    many = sorted(map(tuple, katz.scores(docs, **settings).collect()), key=order)
    assert [r[:5] for r in many] == [r[:5] for r in one]
    assert np.allclose([r[5:] for r in many], [r[5:] for r in one], rtol=1e-9)


@pytest.mark.parametrize("settings", [SMALL, SMALL | {"fan_bits": 1, "fan": 2}])
def test_passages_level_by_level(spark, settings):
    rows = [r for r in some_rows(2) if r[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.without_repeats(docs, **settings).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == without_repeats(rows) and sum(r.n_removed for r in got) > 500


def test_a_hot_key_is_merged_on_its_way(spark):
    """No group of the exchange holds a row of every batch: 400 batches have one key in common."""
    batches, fan = 400, 8
    rng = np.random.default_rng(1)
    rows = []
    for b in range(batches):
        keys = np.unique(np.append(rng.integers(0, 2**63, 30).astype(np.uint64) * np.uint64(2), np.uint64(5)))
        rows += [(s, b, e - a, packed.packed(keys[a:e], True), packed.packed(np.full(e - a, b, np.int64))) for s, a, e in packed.cut_by_shard(keys, 2)]
    asks = spark.createDataFrame([(s, b, n, bytearray(k), bytearray(v)) for s, b, n, k, v in rows], "shard long, batch long, n long, keys binary, least binary")
    asked = packed.Asked({"least": (np.int64, np.minimum)}, {"earlier": bool}, passages._share)

    def answer(table):
        assert table.num_rows <= 2 * fan  # rows of merged batches, not of all
        keys, own, sizes = asked.joined(table)
        _, place, _, values = asked.merged(keys, own)
        bits = np.split(values["least"][place] < own["least"], np.cumsum(sizes)[:-1])
        return pa.table({"batch": table["batch"], "shard": table["shard"], "n": table["n"], "earlier": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    found = packed.exchanged(asks, ["shard"], asked, answer, "batch long, shard long, n long, earlier binary", 6, batches, 2, 2, fan)
    bits = {(r.shard, r.batch): r for r in found.collect()}
    hot = {b: np.unpackbits(np.frombuffer(bits[0, b].earlier, np.uint8))[0] for b in range(batches)}
    assert hot == {b: int(b > 0) for b in range(batches)} and len(bits) == len(rows)


@pytest.mark.parametrize("corpus", [30e9, 1e12, 1e14])
def test_a_batch_sends_full_rows_whatever_the_corpus(corpus):
    """The first level cuts a batch of 350,000 keys into 256 rows, the next ones into no more."""
    tree = katz.Tree(packed.shard_bits(int(corpus) // 6), int(corpus) >> 22)
    assert tree.first <= packed.FAN_BITS and tree.bits > tree.first
    levels = math.ceil((tree.bits - tree.first) / packed.FAN_BITS)
    assert levels <= 2 and tree.batches / packed.FAN**levels < 2 * packed.FAN
