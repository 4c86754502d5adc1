"""Resampling towards a target distribution: hashed n-gram counts of corpus and target, gains per bucket, Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import running_total, stored
from shopgauge.llm.words import pieces

#: What separates words here: all of ASCII but digits and small letters, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    """`buckets` bounds both count tables and the gains; `percent` of the documents with `least_words` words are drawn."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


class Joined:
    """CRC-32 of two byte strings one after the other, from the CRC-32 of each and the length of the second.

    CRC-32 is linear: `n` more bytes turn the number of what is before them by a matrix that depends on n alone.
    """

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        """What each value of each of the four bytes of a number becomes under n more bytes."""
        if n not in self.tables:
            zeros = bytes(n)
            bits = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)]
            value = np.arange(256)
            table = np.zeros((4, 256), np.uint32)
            for k, bit in enumerate(bits):
                table[k // 8] ^= np.where(value >> (k % 8) & 1, bit, 0).astype(np.uint32)
            self.tables[n] = table
        return self.tables[n]

    def __call__(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = second.copy()
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
            at = order[a:b]
            t, x = self.table(int(size[at[0]])), first[at]
            out[at] ^= t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return out


@dataclass
class Features:
    """Buckets of words and of pairs, in the order of the texts, with the text of each; and the number of words per text."""

    words: np.ndarray
    word_of: np.ndarray
    pairs: np.ndarray
    pair_of: np.ndarray
    n_words: np.ndarray


def features(text: pa.Array, buckets: int, joined: Joined) -> Features:
    """The hashed words and word pairs of each text, by Arrow kernels: each distinct word and pair is hashed once."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), BREAKS)
    flat, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")  # before a leading and after a trailing break
    encoded = pc.dictionary_encode(flat.filter(real))
    of = of.filter(real).to_numpy()
    at = encoded.indices.to_numpy().astype(np.int64)
    distinct = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    spaced = joined(crc, np.full(len(crc), zlib.crc32(b" "), np.uint32), np.ones(len(crc), np.int64))

    together = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    coded = pc.dictionary_encode(pa.array(at[together] * len(distinct) + at[together + 1 if len(of) else together]))
    first, second = np.divmod(coded.dictionary.to_numpy(), max(1, len(distinct)))
    pair_crc = joined(spaced[first], crc[second], size[second])
    return Features(
        pc.take(pa.array(crc % np.uint32(buckets)), encoded.indices).to_numpy(),
        of,
        pc.take(pa.array(pair_crc % np.uint32(buckets)), coded.indices).to_numpy(),
        of[together],
        np.bincount(of, minlength=len(text)),
    )


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of features per bucket over all texts; one row per task and used bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, total = Joined(), np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            found = features(piece.column("text"), buckets, joined)
            total += np.bincount(found.words, minlength=buckets) + np.bincount(found.pairs, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of target and corpus, for each bucket."""
    n, corpus_all, target_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = (float((t + 1) * (corpus_all + n)) / float((s + 1) * (target_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratios), np.int64, n)


def segment_sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each text; `of` never falls."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.searchsorted(of, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of the features, 0 without any) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, table = Joined(), shared.value
        for piece in pieces(batches):
            found, rows = features(piece.column("text"), len(table), joined), piece.num_rows
            n = found.n_words + np.maximum(found.n_words - 1, 0)
            total = segment_sums(table[found.words], found.word_of, rows) + segment_sums(table[found.pairs], found.pair_of, rows)
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_words": found.n_words, "n_features": n, "weight": total // np.maximum(n, 1)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row; rank is null where a document is not drawn.

    Both tables need a text; other columns are ignored, but for doc_id. A null or empty text has no features and weight
    0. The noise of a score comes from the id alone: rows with the same id share it, a null id counts as an empty
    one and comes last among equal scores, and rows that agree in score and id get their ranks in the order in which
    they were stored. A very long text is counted like any other, with a few numbers per word in memory. Empty tables
    are fine: without a target the gains favour rare buckets, without documents there are no rows.

    The texts are read twice, once for counts and once for weights. What is shuffled are counts per bucket and, for the
    draw, six numbers per document, range-sorted by score with a unique last key, so that no task gets a hot id.
    """
    gain = gains(bucket_counts(docs, s.buckets), bucket_counts(target, s.buckets))
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296
    rows = weights(docs, gain).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= s.least_words
    drawn = rows.where(enough).count() * s.percent // 100
    placed = rows.select(
        "*", F.when(enough, 1).otherwise(0).alias("_counts"), (~enough).alias("_out"), (-F.col("score")).alias("_low"), F.col("doc_id").isNull().alias("_no_id")
    )
    ranked = running_total(placed, "_counts", [], ["_out", "_low", "_no_id", "doc_id", "place"], "_rank")
    rank = F.when(enough & (F.col("_rank") <= drawn), F.col("_rank").cast("bigint")).alias("rank")
    return ranked.select("doc_id", "n_features", "weight", "score", rank)
