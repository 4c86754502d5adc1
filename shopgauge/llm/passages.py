"""Removal of repeated passages: shared runs of words are confirmed, compiled into automata and located in all documents.

Confirming is one exchange of hashed windows, in which each batch of documents learns which of its windows recur.
The automata are sharded with the documents: each holds the recurring passages that occur in its batch, at most one
node per word of it, and the batch is streamed through it. So memory is bounded and work grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.packed import FAN, FAN_BITS, Asked, answered, batched, cut_by_shard, exchanged, packed, shard_bits, unpacked
from shopgauge.llm.shared import whole_text
from shopgauge.llm.words import SAME, shingles, text_bytes, word_hashes

#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def windows_of(texts: pa.Array, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the texts' places in them, the hash of each window, and the document number of each window."""
    words, of = word_hashes(*text_bytes(texts.cast(pa.large_string())), SAME)
    parts = [shingles(words[a:b], width) for a, b in zip(of[:-1], of[1:], strict=True)]
    keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return words, of, keys, np.repeat(np.arange(len(ids)), [len(p) for p in parts])


def ids_of(row: pa.ListScalar) -> np.ndarray:
    return np.asarray(row.values.fill_null(NO_ID)).astype(np.int64)


def least_ids(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, the smallest and largest id of each, and for every given key its place among them."""
    distinct, place = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), NO_ID)
    most = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, place, ids)
    np.maximum.at(most, place, ids)
    return distinct, least, most, place


def asks(batches: DataFrame, width: int, bits: int) -> DataFrame:
    """The distinct windows of each batch, by shard, with the smallest id that holds each in the batch."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                ids = ids_of(batch.column(1)[i])
                *_, keys, doc = windows_of(batch.column(2)[i].values, ids, width)
                keys, least, *_ = least_ids(keys, ids[doc])
                out = [(s, batch.column(0)[i].as_py(), b - a, packed(keys[a:b], True), packed(least[a:b])) for s, a, b in cut_by_shard(keys, bits)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "batch", "n", "keys", "least"])

    return batches.select("batch", "doc_id", "text").mapInArrow(ask, "shard long, batch long, n long, keys binary, least binary")


def _share(own: dict, place: np.ndarray, first: np.ndarray, merged: dict, answers: dict) -> dict[str, np.ndarray]:
    """A smaller id has the window elsewhere if the merged batches were told so, or one of them has a smaller id."""
    return {"earlier": answers["earlier"][place] | (merged["least"][place] < own["least"])}


def confirmed(questions: DataFrame, bits: int, batches: int, fan_bits: int = FAN_BITS, fan: int = FAN) -> DataFrame:
    """For each batch and shard one bit per window: whether a document of a smaller id in another batch has it."""

    def answer(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_pylist()
        keys = np.concatenate([unpacked(k, n, np.uint64, True) for k, n in zip(table.column("keys").to_pylist(), counts, strict=True)])
        least = np.concatenate([unpacked(k, n, np.int64) for k, n in zip(table.column("least").to_pylist(), counts, strict=True)])
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        overall = np.repeat(np.minimum.reduceat(least[order], begins), np.diff(np.append(begins, len(keys))))
        earlier = np.empty(len(keys), bool)
        earlier[order] = overall < least[order]
        parts = np.split(earlier, np.cumsum(counts)[:-1])
        return pa.table({"batch": table.column("batch"), "shard": table.column("shard"), "n": table.column("n"), "earlier": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    asked = Asked({"least": (np.int64, np.minimum)}, {"earlier": bool}, _share)
    return exchanged(questions, ["shard"], asked, answer, "batch long, shard long, n long, earlier binary", bits, batches, min(bits, fan_bits), fan_bits, fan)


def located(words: np.ndarray, of: np.ndarray, keys: np.ndarray, doc: np.ndarray, ids: np.ndarray, earlier: np.ndarray, width: int) -> np.ndarray:
    """Which words are to go. earlier: for each distinct key, sorted, whether a smaller id elsewhere has it.

    A passage is a longest run of windows that recur; with it goes, for each of its windows, the id that keeps it.
    """
    gone = np.zeros(len(words), bool)
    _, least, most, place = least_ids(keys, ids[doc])
    owner = np.where(earlier, np.iinfo(np.int64).min, least)[place]
    recurs = (earlier | (least < most))[place]
    if not recurs.any():
        return gone
    number = np.unique(words, return_inverse=True)[1].tolist()
    first = np.searchsorted(doc, np.arange(len(ids)))  # the window that each document begins with
    edge = np.concatenate([[True], (recurs[1:] != recurs[:-1]) | (doc[1:] != doc[:-1])])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(keys))
    automaton, passages = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
    for a, b in zip(starts[recurs[starts]].tolist(), ends[recurs[starts]].tolist(), strict=True):
        at = int(of[doc[a]]) + a - int(first[doc[a]])
        passage = tuple(number[at : at + b - a + width - 1])
        if passage not in automaton:
            automaton.add_word(passage, len(passages))
            passages.append((b - a, owner[a:b]))
    automaton.make_automaton()
    for d in np.unique(doc[recurs]).tolist():
        cover = np.zeros(int(of[d + 1] - of[d]) + 1, np.int64)
        for end, name in automaton.iter(tuple(number[of[d] : of[d + 1]])):
            many, keeper = passages[name]
            begin = end + 1 - many - (width - 1)
            hit = begin + np.flatnonzero(keeper < ids[d])
            if len(hit):
                # windows of a run overlap: mark the first word of each and the word after its last
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + width, -1)
        gone[of[d] : of[d + 1]] = np.cumsum(cover)[:-1] > 0
    return gone


def without_repeats(docs: DataFrame, width: int = 13, batch_bytes: int = 4 << 20, per_shard: int = 1 << 21, fan_bits: int = FAN_BITS, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: one row per document.

    Words go that a window of `width` words covers whose words, unchanged, also begin somewhere in a document with a
    smaller id; windows are judged on the input. The kept words are joined by one space. Null texts have no words, a
    null id comes after all others, rows with the same id spare each other, a very long text is a batch of its own, and an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    batches, size = batched(rows, batch_bytes)
    every = shard_bits(size // 6, per_shard)
    bits = min(every, fan_bits)  # by which a batch cuts its windows
    replies = confirmed(asks(batches, width, bits), every, -(-size // batch_bytes), fan_bits, fan)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                ids = ids_of(batch.column(0)[i])
                words, of, keys, doc = windows_of(batch.column(1)[i].values, ids, width)
                bits_of = {a["shard"]: a["earlier"] for a in batch.column(2)[i].as_py() or ()}
                distinct = np.unique(keys)
                earlier = [np.unpackbits(np.frombuffer(bits_of[s], np.uint8), count=b - a) for s, a, b in cut_by_shard(distinct, bits)]
                earlier = np.concatenate([*earlier, np.zeros(0, np.uint8)]).astype(bool)
                gone = located(words, of, keys, doc, ids, earlier, width)
                kept = []
                for d, text in enumerate(batch.column(1)[i].values.to_pylist()):
                    own = text.encode().split()
                    if gone[of[d] : of[d + 1]].any():
                        own = [w for w, g in zip(own, gone[of[d] : of[d + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i].values,
                    pa.array(np.diff(of).astype(np.int64)),
                    pa.array(np.add.reduceat(np.append(gone, False), np.minimum(of[:-1], len(gone))) * (np.diff(of) > 0), pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "n_removed", "kept_text"])

    full = answered(batches, replies, "earlier").select("doc_id", "text", "answers")
    return full.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")
