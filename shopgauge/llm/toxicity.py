"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import id_remainder
from shopgauge.llm.words import LOWER, mixed, pieces, text_bytes, word_hashes

#: Everything but ASCII letters, digits and bytes of other scripts separates words here.
BREAK = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """`fit_rows`: the most labelled rows a model is fitted on, those with the smallest hash of the id."""

    fit_rows: int = 20_000
    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 9.0
    l2: float = 1.0
    epochs: int = 6


def features(words: np.ndarray, bits: int) -> np.ndarray:
    """Hashed words, pairs, and pairs with one or two words skipped, one number per occurrence."""
    found = [words]
    for kind, gap in ((1, 1), (2, 2), (3, 3)):
        if len(words) > gap:
            found.append(mixed(words[:-gap] * np.uint64(2 * kind + 1) + words[gap:]))
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def train(texts: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the non-zero weights; the last number, 2**bits, is the constant."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.abs(z[at]) > s.l1 * (at < size)
        return np.where(free, -(z[at] - np.sign(z[at]) * s.l1 * (at < size)) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2), 0)

    for _ in range(s.epochs):
        for at, label in zip(texts, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = np.arange(size + 1)
    w = weights(every)
    return every[w != 0], w[w != 0]


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn, fit_rows: int) -> DataFrame:
    """At most `fit_rows` labelled documents (doc_id, text, label) that `learn` lets in; one label per id, the largest.

    An id that several rows have gives one row, that with the smallest hash of its text.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("digest"), "text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(least["text"].alias("text"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned in one task from the bounded sample; the model is as large as its non-zero weights."""
    sample = labelled(docs, labels, "toxic", id_remainder(3) != 1, s.fit_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for piece in pieces(batches):
            hashes, of = word_hashes(*text_bytes(piece.column("text")), LOWER, BREAK)
            for i, (id_, label) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("label").to_pylist(), strict=True)):
                at = np.unique(features(hashes[of[i] : of[i + 1]], s.bits)).astype(np.int32)
                rows.append((id_, len(at), int(at.sum()), label, np.append(at, np.int32(1 << s.bits))))
        rows.sort(key=lambda r: r[:4])
        order = np.random.default_rng(7).permutation(len(rows))
        at, w = train([rows[i][4] for i in order], np.array([rows[i][3] for i in order], float), s)
        yield pa.RecordBatch.from_pydict({"at": at, "w": w})

    # bounded by fit_rows, so one task; few weights differ from zero
    model = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    return model["at"].to_numpy(), model["w"].to_numpy()


def scores(raw: np.ndarray, at: np.ndarray, dense: np.ndarray, bits: int) -> np.ndarray:
    """Probability of each text: each feature that occurs counts once."""
    hashes, of = word_hashes(raw, at, LOWER, BREAK)
    out = np.full(len(at) - 1, dense[-1])
    for i in range(len(at) - 1):
        found = features(hashes[of[i] : of[i + 1]], bits)
        found = found[dense[found] != 0]
        if len(found):
            out[i] += dense[np.unique(found)].sum()
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; an empty or null text has the score of the constant alone.

    Repeated rows get the same score, a null id counts as an empty text when rows are held out, and without any
    labelled row every score is 0.5. A very long text is scored whole; an empty table gives no rows.
    """
    at, w = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((at.astype(np.int32), w))  # non-zero weights: 2**bits + 1 at most

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << s.bits) + 1)
        dense[shared.value[0]] = shared.value[1]
        for piece in pieces(batches):
            found = scores(*text_bytes(piece.column("text")), dense, s.bits)
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": found, "predicted": (found >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_remainder(3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
