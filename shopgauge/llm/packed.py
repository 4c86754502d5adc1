"""Batches of documents that ask for facts about their hashed keys and are answered, in packed arrays.

A batch sends each key once, however often it holds it. Sorted 64-bit keys are sent as differences whose bytes are laid
out by place and compressed: some six bytes a key.

The exchange is a tree. A batch sends its keys in FAN parts, by their first bits. Parts of FAN batches are merged into
one, which again is as large as a batch and is cut into FAN parts by the next bits, until a part of all keys fits into a
task. So whatever the size of the corpus, a packed row holds some thousand keys, a group holds about FAN rows, and a key
that every batch has is merged level by level. A level costs the same for each GB; there is one more for each factor FAN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import shared_folder, stored

#: Bits of a key that one level of the exchange tells apart, and batches that one level merges.
FAN_BITS, FAN = 8, 256


def packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """The numbers (8 bytes each) as compressed byte planes; with `rising`, as differences of sorted unsigned numbers."""
    if rising:
        numbers = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpacked(data: bytes, count: int, dtype: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * count, asbytes=True), np.uint8).reshape(8, -1)
    numbers = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(numbers, dtype=dtype) if rising else numbers


def batched(rows: DataFrame, limit: int = 4 << 20) -> tuple[DataFrame, int]:
    """The rows in runs of about `limit` bytes of text, and the number of bytes in all.

    Columns: batch, and an array for every column of `rows` (one is `text`, not null). The table is bucketed by batch,
    so that answers find their batch without another shuffle of the texts.
    """
    spark = rows.sparkSession
    names = rows.columns
    at = names.index("text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in table.columns]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([size], pa.int64()), *lists], ["batch", "bytes", *names])

        for batch in batches:
            start = 0
            sizes = np.asarray(pa.compute.binary_length(batch.column(at))).astype(np.int64)
            for i, n in enumerate(sizes.tolist()):
                size += n + 16
                if size >= limit:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row()
                    start, held, size, number = i + 1, [], 0, number + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row()

    schema = ", ".join(["batch long", "bytes long", *(f"`{n}` array<{t}>" for n, t in rows.dtypes)])
    folder = shared_folder(spark)
    table = f"batches_{folder.rsplit('/', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(gather, schema)
    made.write.option("compression", "zstd").option("path", folder).bucketBy(buckets, "batch").saveAsTable(table)
    stored = spark.table(table)
    return stored, stored.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def cut_by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the sorted keys that share their first `bits` bits."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(shard[a]), a, b


def shard_bits(keys: int, per_shard: int = 1 << 21) -> int:
    """Bits of the shard number, for `per_shard` keys in each at most when all are different."""
    return max(0, (max(1, keys) - 1) // per_shard).bit_length()


@dataclass(frozen=True)
class Asked:
    """What goes with each key of a question and comes back in each answer.

    values: column -> how those of several members become one (np.add, np.minimum). answers: column -> type, bool for a
    bit per key. share(own, place, first, merged, answers) gives a member's answers: `own` values and `place` among the
    merged keys for every key of all members in order, whether it is the `first` member with that key and a value
    above 0 in the first column, and for each merged key the merged values and the answers to them.
    """

    values: dict[str, tuple[type, np.ufunc]]
    answers: dict[str, type]
    share: Callable[[dict, np.ndarray, np.ndarray, dict, dict], dict[str, np.ndarray]]

    def joined(self, table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray], list[int]]:
        """Keys and values of all rows, one after the other, and the length of each row."""
        sizes = table.column("n").to_pylist()
        keys = [unpacked(k, n, np.uint64, True) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
        own = {c: np.concatenate([unpacked(v, n, t) for v, n in zip(table.column(c).to_pylist(), sizes, strict=True)]) for c, (t, _) in self.values.items()}
        return np.concatenate(keys), own, sizes

    def merged(self, keys: np.ndarray, own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Distinct keys, the place of each key among them, the first of each that counts, and the merged values."""
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        spread = np.diff(np.append(begins, len(order)))
        place, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
        place[order] = np.repeat(np.arange(len(begins)), spread)
        counts = next(iter(own.values()))[order] > 0
        seen = np.cumsum(counts)
        first[order] = counts & (seen - np.repeat(seen[begins] - counts[begins], spread) == 1)
        return keys[order][begins], place, first, {c: ufunc.reduceat(own[c][order], begins) for c, (_, ufunc) in self.values.items()}

    def pack(self, column: str, values: np.ndarray) -> bytes:
        return np.packbits(values).tobytes() if self.answers[column] is bool else packed(values)

    def unpack(self, column: str, data: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool) if self.answers[column] is bool else unpacked(data, n, self.answers[column])


def exchanged(asks: DataFrame, by: list[str], asked: Asked, answer: Callable, schema: str, bits: int, batches: int, used: int = 0, fan_bits: int = FAN_BITS, fan: int = FAN) -> DataFrame:
    """The answers to the asks: `answer` maps all rows of a part of the keys (grouped `by`, which ends with shard) to answers.

    asks: the columns `by`, batch, n, keys and the values; `used` bits of a key make its shard, `bits` in all are wanted.
    `batches`: how many ask. Rows of both sides have the columns of `by` and batch, and answers `n`; `stats`, lists of
    sums that an answer may have, are summed up.
    """
    if used >= bits:
        return asks.groupBy(*by).applyInArrow(answer, schema)
    step, groups = min(fan_bits, bits - used), max(1, -(-batches // fan))
    rows = stored(asks.withColumn("group", F.pmod(F.xxhash64("batch"), F.lit(groups).cast("bigint"))))

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        keys, own, _ = asked.joined(table)
        distinct, _, _, values = asked.merged(keys, own)
        cuts = list(cut_by_shard(distinct, used + step))
        out = {c: [table.column(c)[0].as_py()] * len(cuts) for c in by}
        out |= {"shard": [s for s, *_ in cuts], "batch": [table.column("group")[0].as_py()] * len(cuts), "n": [b - a for _, a, b in cuts]}
        out |= {"keys": [packed(distinct[a:b], True) for _, a, b in cuts], **{c: [packed(v[a:b]) for _, a, b in cuts] for c, v in values.items()}}
        return pa.table(out).select(names)

    def share(members: pa.Table, replies: pa.Table) -> pa.Table:
        members, replies = members.sort_by("batch"), replies.sort_by("shard")
        keys, own, sizes = asked.joined(members)
        _, place, first, values = asked.merged(keys, own)
        found = {c: np.concatenate([asked.unpack(c, d, n) for d, n in zip(replies.column(c).to_pylist(), replies.column("n").to_pylist(), strict=True)]) for c in asked.answers}
        mine = asked.share(own, place, first, values, found)
        ends = np.cumsum(sizes)[:-1]
        out = {c: members.column(c) for c in (*by, "batch", "n")}
        out |= {c: pa.array([asked.pack(c, x) for x in np.split(mine[c], ends)], pa.binary()) for c in asked.answers}
        if "kind" in replies.column_names:
            out["kind"] = pa.array([replies.column("kind")[0].as_py()] * len(sizes), pa.int64())
        if "stats" in replies.column_names:
            lists = [x for x in replies.column("stats").to_pylist() if x is not None]
            total = [[sum(x) for x in zip(*lists, strict=True)] if lists else None]
            out["stats"] = pa.array(total + [None] * (len(sizes) - 1), pa.list_(pa.int64()))
        return pa.table(out).select(columns)

    names, columns = asks.columns, [c.split()[0] for c in schema.split(", ")]
    merged = stored(rows.groupBy(*by, "group").applyInArrow(merge, asks.schema))
    replies = exchanged(merged, by, asked, answer, schema, bits, groups, used + step, fan_bits, fan)
    replies = stored(replies.withColumn("part", F.shiftright("shard", step)))
    of = [c for c in by if c != "shard"]
    return rows.groupBy(*of, "shard", "group").cogroup(replies.groupBy(*of, "part", "batch")).applyInArrow(lambda a, b: share(a, b), schema)


def answered(batches: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """The batches with an array `answers` of structs (shard and the given columns), empty without any."""
    lists = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", *columns)).alias("answers"))
    return batches.join(lists.hint("merge"), "batch", "left")
