"""Katz backoff: Good-Turing discounted counts of words and word pairs, exactly normalised backoff weights.

Counts and backoff weights live in tables partitioned by the hash of their key. Batches of documents send the distinct
words, pairs and contexts they hold and get back counts and weights; no table is ever broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.packed import FAN, FAN_BITS, Asked, answered, batched, cut_by_shard, exchanged, packed, shard_bits, unpacked
from shopgauge.llm.shared import id_remainder, stored, whole_text
from shopgauge.llm.words import LOWER, mixed, text_bytes, word_hashes

#: The token that ends every text, and the context of its first token.
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)
#: Counts up to this one are discounted.
SMALL = 5
WORDS, PAIRS, CONTEXTS = 0, 1, 2


@dataclass(frozen=True)
class Counts:
    """of[r] keys occur r times, for r from 1 to SMALL + 1; kinds keys occur, total times in all."""

    of: tuple[int, ...]
    kinds: int
    total: int

    def discounts(self) -> np.ndarray:
        """Factor for each count from 0 to SMALL + 1 (the last for all larger ones, 1).

        Good-Turing after Katz, renormalised so that the singletons' mass is what is set free; if copies make the
        counts of counts too uneven for that, from a line through their logarithms; if there are too few even for
        that, all small counts lose the singletons' share.
        """
        out, r = np.ones(SMALL + 2), np.arange(1, SMALL + 2)
        n = np.array(self.of, float)
        tries = [n] if n.all() else []
        if (n > 0).sum() > 1:
            slope, start = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
            tries.append(np.exp(start + slope * np.log(r)))
        for of in tries:
            cut = (SMALL + 1) * of[SMALL] / of[0]
            found = (r[1:] * of[1:] / (r[:-1] * of[:-1]) - cut) / (1 - cut) if cut < 1 else np.zeros(SMALL)
            if np.all((found > 0) & (found < 1)):
                out[1 : SMALL + 1] = found
                return out
        out[1 : SMALL + 1] = 1 - max(1, self.of[0]) / (self.total + 1)
        return out

    def unseen(self) -> float:
        """The mass that discounting sets free, for what does not occur; all of it where nothing occurs."""
        if not self.total:
            return 1.0
        d = self.discounts()
        free = sum((1 - d[r]) * r * self.of[r - 1] for r in range(1, SMALL + 1)) / self.total
        return free if free > 0 else 1 / (self.total + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of keys with these counts; 0 stands for all that do not occur together."""
        if not self.total:
            return np.ones(len(counts))
        d = self.discounts()
        p = d[np.minimum(counts, SMALL + 1)] * counts / self.total
        if sum((1 - d[r]) * r * self.of[r - 1] for r in range(1, SMALL + 1)) <= 0:  # nothing small: one more is counted
            p = p * self.total / (self.total + 1)
        return np.where(counts > 0, p, self.unseen())


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end for each text, the token before each, and where each text begins (and the end)."""
    words, of = word_hashes(*text_bytes(texts.cast(pa.large_string())), LOWER)
    tokens = np.insert(words, of[1:], END)
    at = of + np.arange(len(of))
    before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    before[at[:-1]] = START
    return tokens, before, at


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def count_asks(batches: DataFrame, bits: int) -> DataFrame:
    """Distinct words and pairs of each batch by kind and shard, with their counts in the batch's training texts."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                tokens, before, at = tokens_of(batch.column(2)[i].values)
                train = np.repeat(~np.asarray(batch.column(1)[i].values.to_pylist(), bool), np.diff(at))
                out = []
                for kind, keys in ((WORDS, tokens), (PAIRS, pair_keys(before, tokens))):
                    distinct, place = np.unique(keys, return_inverse=True)
                    counts = np.bincount(place[train], minlength=len(distinct)).astype(np.int64)
                    out += [(kind, s, batch.column(0)[i].as_py(), b - a, packed(distinct[a:b], True), packed(counts[a:b])) for s, a, b in cut_by_shard(distinct, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["kind", "shard", "batch", "n", "keys", "counts"])

    return batches.select("batch", "held_out", "text").mapInArrow(ask, "kind long, shard long, batch long, n long, keys binary, counts binary")


def _grouped(table: pa.Table, columns: dict[str, type]) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The rows in order of their batch, their lengths, the sorting of all keys, the begin of each key, and the columns."""
    table = table.sort_by("batch")
    counts = table.column("n").to_pylist()
    keys = np.concatenate([unpacked(k, n, np.uint64, True) for k, n in zip(table.column("keys").to_pylist(), counts, strict=True)])
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    values = {c: np.concatenate([unpacked(v, n, t) for v, n in zip(table.column(c).to_pylist(), counts, strict=True)]) for c, t in columns.items()}
    return table, counts, order, begins, values


def _share_counts(own: dict, place: np.ndarray, first: np.ndarray, merged: dict, answers: dict) -> dict[str, np.ndarray]:
    return {"overall": answers["overall"][place], "first": answers["first"][place] & first}


def _share_weights(own: dict, place: np.ndarray, first: np.ndarray, merged: dict, answers: dict) -> dict[str, np.ndarray]:
    return {c: x[place] for c, x in answers.items()}


@dataclass(frozen=True)
class Tree:
    """How keys are exchanged: bits of a shard in all, number of batches, and the fan of each level."""

    bits: int
    batches: int
    fan_bits: int = FAN_BITS
    fan: int = FAN

    @property
    def first(self) -> int:
        """Bits by which a batch cuts its keys."""
        return min(self.bits, self.fan_bits)

    def answers(self, asks: DataFrame, by: list[str], asked: Asked, answer, schema: str) -> DataFrame:
        return exchanged(asks, by, asked, answer, schema, self.bits, self.batches, self.first, self.fan_bits, self.fan)


def counted(questions: DataFrame, tree: Tree) -> DataFrame:
    """For each batch, kind and shard: the overall count of its keys, and a bit for those it is the first to train on.

    The first row of a kind and shard also has `stats`: how many keys occur 1 to SMALL + 1 times, at all, and in total.
    """

    def answer(table: pa.Table) -> pa.Table:
        table, lengths, order, begins, values = _grouped(table, {"counts": np.int64})
        own = values["counts"][order]
        sums = np.add.reduceat(own, begins)
        spread = np.diff(np.append(begins, len(order)))
        seen = np.cumsum(own > 0)
        before = np.repeat(seen[begins] - (own[begins] > 0), spread)
        overall, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
        overall[order] = np.repeat(sums, spread)
        first[order] = (own > 0) & (seen - before == 1)
        cuts = np.cumsum(lengths)[:-1]
        stats = [[*np.bincount(np.minimum(sums, SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].tolist(), int((sums > 0).sum()), int(sums.sum())]]
        return pa.table({
            "batch": table.column("batch"),
            "kind": table.column("kind"),
            "shard": table.column("shard"),
            "n": table.column("n"),
            "overall": pa.array([packed(x) for x in np.split(overall, cuts)], pa.binary()),
            "first": pa.array([np.packbits(x).tobytes() for x in np.split(first, cuts)], pa.binary()),
            "stats": pa.array(stats + [None] * (len(lengths) - 1), pa.list_(pa.int64())),
        })

    asked = Asked({"counts": (np.int64, np.add)}, {"overall": np.int64, "first": bool}, _share_counts)
    return tree.answers(questions, ["kind", "shard"], asked, answer, "batch long, kind long, shard long, n long, overall binary, first binary, stats array<long>")


def totals(answers: DataFrame, kind: int) -> Counts:
    """The counts of counts of one kind: eight sums."""
    size = SMALL + 3
    sums = answers.where(F.col("kind") == kind).agg(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(size))).first()
    return Counts(tuple(sums[: SMALL + 1]), sums[SMALL + 1], sums[SMALL + 2])


def _answer(answers: list[dict], kind: int, keys: np.ndarray, bits: int, column: str, dtype: type) -> np.ndarray:
    """One column of the answers to the distinct sorted keys of a kind."""
    of = {a["shard"]: a[column] for a in answers if a["kind"] == kind}
    if column == "first":
        parts = [np.unpackbits(np.frombuffer(of[s], np.uint8), count=b - a).astype(bool) for s, a, b in cut_by_shard(keys, bits)]
    else:
        parts = [unpacked(of[s], b - a, dtype) for s, a, b in cut_by_shard(keys, bits)]
    return np.concatenate([*parts, np.zeros(0, dtype)])


def context_asks(full: DataFrame, bits: int, words: Counts, pairs: Counts) -> DataFrame:
    """Distinct contexts of each batch by shard, with what its own first pairs add to them: count, set free, mass of followers."""
    lost = 1 - pairs.discounts()

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                answers = batch.column(2)[i].as_py()
                tokens, before, _ = tokens_of(batch.column(1)[i].values)
                known, word = np.unique(tokens, return_inverse=True)
                share = words.probability(_answer(answers, WORDS, known, bits, "overall", np.int64))[word]
                keys, place, pair = np.unique(pair_keys(before, tokens), return_index=True, return_inverse=True)
                counts = _answer(answers, PAIRS, keys, bits, "overall", np.int64)
                mine = _answer(answers, PAIRS, keys, bits, "first", bool)
                contexts, context = np.unique(before, return_inverse=True)
                of = context[place[mine]]
                count = np.bincount(of, counts[mine], len(contexts)).astype(np.int64)
                free = np.bincount(of, lost[np.minimum(counts[mine], SMALL + 1)] * counts[mine], len(contexts))
                mass = np.bincount(of, share[place[mine]], len(contexts))
                out = [(s, batch.column(0)[i].as_py(), b - a, packed(contexts[a:b], True), packed(count[a:b]), packed(free[a:b]), packed(mass[a:b])) for s, a, b in cut_by_shard(contexts, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "batch", "n", "keys", "count", "free", "mass"])

    return full.select("batch", "text", "answers").mapInArrow(ask, "shard long, batch long, n long, keys binary, count binary, free binary, mass binary")


def weighted(questions: DataFrame, tree: Tree) -> DataFrame:
    """For each batch and shard, of each context: its count (one more if nothing is set free otherwise) and backoff weight.

    The weight is the mass set free over the mass of the words that do not follow the context, so that the
    probabilities of all words after a context add up to 1. A context without followers has count 0 and weight 1.
    """

    def answer(table: pa.Table) -> pa.Table:
        table, lengths, order, begins, values = _grouped(table, {"count": np.int64, "free": np.float64, "mass": np.float64})
        count, free, mass = (np.add.reduceat(values[c][order], begins) for c in ("count", "free", "mass"))
        full = (count > 0) & (free <= 0)
        whole = count + full
        weight = np.where(count > 0, np.where(full, 1, free) / np.maximum(whole, 1) / np.maximum(1 - mass, 1e-300), 1.0)
        spread = np.diff(np.append(begins, len(order)))
        back = {}
        for name, value in (("overall", whole), ("weight", weight)):
            column = np.empty(len(order), value.dtype)
            column[order] = np.repeat(value, spread)
            back[name] = pa.array([packed(x) for x in np.split(column, np.cumsum(lengths)[:-1])], pa.binary())
        kind = pa.array([CONTEXTS] * len(lengths), pa.int64())
        return pa.table({"batch": table.column("batch"), "kind": kind, "shard": table.column("shard"), "n": table.column("n"), **back})

    asked = Asked({c: (t, np.add) for c, t in (("count", np.int64), ("free", np.float64), ("mass", np.float64))}, {"overall": np.int64, "weight": np.float64}, _share_weights)
    return tree.answers(questions, ["shard"], asked, answer, "batch long, kind long, shard long, n long, overall binary, weight binary").drop("n")


def scores(docs: DataFrame, held_out: int = 2, divisor: int = 7, batch_bytes: int = 4 << 20, per_shard: int = 1 << 21, fan_bits: int = FAN_BITS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from the rows whose id's crc32 leaves another remainder than `held_out`. A pair of words that
    occurs has its discounted share of its context, any other the context's weight times its word's probability; words
    that never occur share one class. Null and empty texts are an end alone, a null id counts as an empty text,
    repeated rows count each, and without training rows every score is 0. A very long text is a batch of its own, with some
    numbers per word in memory; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_remainder(divisor) == held_out).alias("held_out"), whole_text().alias("text"))
    batches, size = batched(rows, batch_bytes)
    tree = Tree(shard_bits(size // 6, per_shard), -(-size // batch_bytes), fan_bits, fan)
    bits = tree.first
    counts = stored(counted(count_asks(batches, bits), tree), "kind")
    words, pairs = totals(counts, WORDS), totals(counts, PAIRS)
    answers = counts.select("batch", "kind", "shard", "overall", "first")
    weights = weighted(context_asks(answered(batches, answers, "kind", "overall", "first"), bits, words, pairs), tree)
    everything = answers.select("batch", "kind", "shard", "overall", F.lit(None).cast("binary").alias("weight")).unionByName(weights)
    discounts = pairs.discounts()

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                found = batch.column(3)[i].as_py()
                tokens, before, at = tokens_of(batch.column(2)[i].values)
                known, word = np.unique(tokens, return_inverse=True)
                count = _answer(found, WORDS, known, bits, "overall", np.int64)
                base = np.log10((count + 1) / (words.total + words.kinds + 1))[word]
                keys, pair = np.unique(pair_keys(before, tokens), return_inverse=True)
                together = _answer(found, PAIRS, keys, bits, "overall", np.int64)[pair]
                contexts, context = np.unique(before, return_inverse=True)
                whole = _answer(found, CONTEXTS, contexts, bits, "overall", np.int64)[context]
                weight = _answer(found, CONTEXTS, contexts, bits, "weight", np.float64)[context]
                follows = discounts[np.minimum(together, SMALL + 1)] * together / np.maximum(whole, 1)
                backed = np.where(together > 0, follows, weight * words.probability(count)[word])
                begins = at[:-1]
                n = len(begins)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values,
                    batch.column(1)[i].values,
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(np.add.reduceat((count > 0)[word].astype(np.int64), begins)),
                    pa.array(np.full(n, words.total, np.int64)),
                    pa.array(np.add.reduceat(base, begins)),
                    pa.array(np.add.reduceat(np.log10(backed), begins)),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    full = answered(batches, everything, "kind", "overall", "weight").select("doc_id", "held_out", "text", "answers")
    return full.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
