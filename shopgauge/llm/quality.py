"""Quality by supervised subword embeddings: averaged vectors of hashed word and character n-grams, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import id_remainder
from shopgauge.llm.toxicity import labelled
from shopgauge.llm.words import GAP, SAME, mixed, pieces, text_bytes, word_hashes


@dataclass(frozen=True)
class Settings:
    """`fit_rows`: the most labelled rows a model is fitted on, those with the smallest hash of the id."""

    fit_rows: int = 6_000
    bits: int = 16
    dims: int = 8
    rate: float = 1.0
    epochs: int = 5
    seed: int = 11


def features(raw: np.ndarray, at: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each text the hashed words, word pairs, and runs of 3 and 4 bytes with white space at their edges only.

    A word followed by itself is one and the same pair, whatever the word.
    """
    hashes, of = word_hashes(raw, at, SAME)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    pairs[hashes[:-1] == hashes[1:]] = np.uint64(0x5851F42D4C957F2D)
    shift = np.uint64(64 - bits)
    hashes, pairs = (hashes >> shift).astype(np.int32), (pairs >> shift).astype(np.int32)
    gap = GAP[raw]
    code = np.where(gap, np.uint8(32), raw).astype(np.uint32)
    runs = []
    for n in (3, 4):
        if len(raw) < n:
            runs.append((n, np.zeros(0, np.int32), np.zeros(0, bool)))
            continue
        many = len(raw) - n + 1
        value, inner = np.zeros(many, np.uint32), np.ones(many, bool)
        for i in range(n):
            value |= code[i : many + i] << np.uint32(8 * i)
            if 0 < i < n - 1:
                inner &= ~gap[i : many + i]
        value = (value ^ (value >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)
        value = (value ^ (value >> np.uint32(13))) * np.uint32(2246822519)
        runs.append((n, (value >> np.uint32(32 - bits)).astype(np.int32), inner))
    for i in range(len(at) - 1):
        a, b = of[i], of[i + 1]
        found = [hashes[a:b], pairs[a : max(a, b - 1)]]
        for n, value, inner in runs:
            a, b = at[i], max(at[i], at[i + 1] - n + 1)
            found.append(value[a:b][inner[a:b]])
        yield np.concatenate(found)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """One weight per bucket and a constant: what the learned vectors add to the log-odds of label 1.

    texts: buckets and their shares of the text. As nothing but the average lies between vectors and output, vector
    and output weights fold into one number per bucket once training is over.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (1 << s.bits, s.dims))
    out, bias = np.zeros((s.dims, 2)), np.zeros(2)
    steps, done = s.epochs * len(texts), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(texts)):
            at, share = texts[i]
            hidden = share @ vectors[at]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            rate = s.rate * (1 - done / steps)
            vectors[at] -= rate * len(at) ** 0.5 * share[:, None] * (out @ p)
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            done += 1
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The folded model, 2**bits + 1 numbers, learned in one task from the bounded sample."""
    sample = labelled(docs, labels, "quality", id_remainder(5) != 0, s.fit_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for piece in pieces(batches):
            found = features(*text_bytes(piece.column("text")), s.bits)
            for id_, label, at in zip(piece.column("doc_id").to_pylist(), piece.column("label").to_pylist(), found, strict=True):
                at, n = np.unique(at, return_counts=True)
                if len(at):
                    rows.append((id_, len(at), int(at.sum()), label, at, (n / n.sum()).astype(np.float32)))
        rows.sort(key=lambda r: r[:4])
        weights, bias = train([r[4:] for r in rows], np.array([r[3] for r in rows], int), s)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(weights) + 1), "w": np.append(weights, bias)})

    # bounded by fit_rows, so one task; the model has a fixed size
    model = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    return model.sort_values("at")["w"].to_numpy() if len(model) else np.zeros((1 << s.bits) + 1)


def scores(raw: np.ndarray, at: np.ndarray, model: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 for each text."""
    logit = np.full(len(at) - 1, model[-1])
    for i, found in enumerate(features(raw, at, bits)):
        if len(found):
            logit[i] += model[found].mean()
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def accepted(docs: DataFrame, model: np.ndarray, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose score reaches the threshold; a null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits + 1 numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
            found = [scores(*text_bytes(p.column("text")), shared.value, s.bits) for p in pieces([texts])]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(apply, docs.schema)


def score(docs: DataFrame, model: np.ndarray, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; an empty or null text has the score of the constant alone.

    Repeated rows get the same score, a null id counts as an empty text when rows are held out, and without any
    labelled row every score is 0.5. A very long text is scored whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits + 1 numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = scores(*text_bytes(piece.column("text")), shared.value, s.bits)
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": found, "predicted": (found >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_remainder(5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
