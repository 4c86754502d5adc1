"""The prefix trie of conversations: double-array tries over sorted shards, and a global merge of what shards share.

Equal conversations are one sequence. Sequences are range-sorted, so that each shard holds a run of the trie in depth-first
order and shares nodes with its neighbours only on the path of its first and of its last sequence: these nodes are open,
all others are closed and final. Open nodes are summed up globally. What lies below them is passed up along the paths:
each open node counts on the least path through it, and as the nodes that a path owns are its deepest ones, a running sum
from the deepest node upwards gives what the path adds to each of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgauge.llm.shared import running_total, running_totals, stored

NOTHING = hashlib.sha256(b"").hexdigest()
SHARD_ROWS = (
    "kind string, a long, b long, up_a long, up_b long, up_conv long, up_open boolean, conv_id long, depth long, bytes long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, path string"
)


@dataclass(frozen=True)
class Settings:
    """`longest`: turns in one array; what a conversation has beyond is a segment of its own. `shard_turns`: turns in one trie."""

    longest: int = 512
    shard_turns: int = 1 << 19


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and bytes of every turn of a known conversation, texts left behind.

    Turns are ordered by `turn`, null first, equal ones by the MD5 of role and text; a repeated row is a turn of its own.
    Null roles and texts are empty ones.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").isNotNull().alias("_given"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    rows = stored(rows).withColumn("place", F.monotonically_increasing_id()).withColumn("_one", F.lit(1))
    placed = running_total(rows, "_one", ["conv_id"], ["_given", "turn", "digest", "place"], "pos")
    return stored(placed.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "digest", "bytes"))


def rebuilt(turns: DataFrame, spread: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (conv_id, total) of each, and their turns, from `numbered` ones.

    The first h turns come from conversation c - c % group (all if it has fewer, none if it is absent), h = crc32(c) %
    spread, then c's own turns after its first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % group})
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    taken = F.least("h", F.coalesce("donor_n", F.lit(0)))
    plan = convs.join(donors, "donor", "left").withColumn("taken", taken)
    plan = stored(plan.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    first = turns.where(F.col("pos") < spread).withColumnRenamed("conv_id", "donor")
    lent = plan.select("conv_id", "donor", "taken", "total").join(first, "donor").where("pos <= taken")
    # one row per conversation on the other side, so a hot conversation is split where it is skewed
    own = turns.join(plan.select("conv_id", "h", "taken", "total"), "conv_id").where("pos > h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "total", "pos", "digest", "bytes"]
    return plan.select("conv_id", "total"), lent.select(columns).unionByName(own.select(columns))


def _segments(turns: DataFrame, longest: int) -> DataFrame:
    """A row per conversation and run of `longest` turns: the turns in order, and the key of the node where the run begins.

    A turn is hashed together with its place, twice 64 bits; a node's key is the exclusive or of the hashes on its path.
    """
    hashed = turns.select(
        "conv_id", "total", "pos", F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", "pos").alias("b"), "bytes",
        F.floor((F.col("pos") - 1) / longest).alias("seg"),
    )
    rows = hashed.groupBy("conv_id", "total", "seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("turns"),  # `longest` turns at most
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"),
    )
    rows = stored(rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes")))))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    zero, single = F.lit(0).cast("bigint"), F.col("total") <= longest
    short = rows.where(single).withColumns({"root_a": zero, "root_b": zero, "long": F.lit(None).cast("bigint")})
    long = rows.where(~single).withColumns({
        "root_a": F.coalesce(F.bit_xor("a").over(before), zero), "root_b": F.coalesce(F.bit_xor("b").over(before), zero), "long": F.col("conv_id"),
    })
    last = ((F.col("seg") + 1) * longest >= F.col("total")).alias("last")
    return short.unionByName(long).select(
        "conv_id", "seg", "turns", "root_a", "root_b", "long", last,
        F.col("root_a").bitwiseXOR(F.col("a")).alias("a"), F.col("root_b").bitwiseXOR(F.col("b")).alias("b"),
    )


class DoubleArray:
    """States of a trie in two arrays: from state s, turn t leads to BASE[s] + t, if CHECK there says s."""

    #: Slots among which a place is sought before one behind all others is taken.
    WINDOW = 2048

    def __init__(self, turns: int):
        self.base, self.check = np.zeros(2 * turns + 2, np.int64), np.full(2 * turns + 2, -1, np.int64)
        self.check[0] = 0  # the state above all roots
        self.head, self.end = 1, 1  # no free slot is sought before head, none is used from end on

    def grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Gives the parents their children; pairs are distinct and sorted by parent, then turn. A parent comes once."""
        cuts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(cuts, append=len(parents))
        for i in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:  # widest first
            s, t = parents[cuts[i]], turns[cuts[i] : cuts[i] + sizes[i]]
            at = self.place(t - t[0])
            self.base[s], self.check[at + t - t[0]] = at - t[0], s
            self.end = max(self.end, at + int(t[-1] - t[0]) + 1)
        lone = cuts[sizes == 1]
        self.grow(self.end + len(lone))
        at = (np.flatnonzero(self.check[self.head : self.end + len(lone)] < 0) + self.head)[: len(lone)]
        self.base[parents[lone]], self.check[at] = at - turns[lone], parents[lone]
        self.end = max(self.end, int(at[-1]) + 1) if len(at) else self.end

    def place(self, offsets: np.ndarray, tries: int = 64) -> int:
        """A slot from which all offsets are free: among the first free ones of the window, or else behind the last."""
        span = int(offsets[-1]) + 1
        self.grow(max(self.end, self.head + self.WINDOW) + span)
        free = np.flatnonzero(self.check[self.head : self.head + self.WINDOW] < 0) + self.head
        if len(free) < self.WINDOW // 16:
            self.head += self.WINDOW  # what is left free there goes unused
        for at in free[:tries]:
            if (self.check[at + offsets] < 0).all():
                return int(at)
        return self.end

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The next states."""
        after = self.base[states] + turns
        if not (self.check[after] == states).all():
            raise AssertionError("a turn leads nowhere")
        return after


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 for equal keys, in the order of their first places."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    cuts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.argsort(np.argsort(np.minimum.reduceat(order, cuts), kind="stable"), kind="stable") if len(cuts) else group
    out = np.empty(len(order), np.int64)
    out[order] = rank[group]
    return out


def shard_nodes(rows: pa.Table, name: str, longest: int) -> pa.RecordBatch:
    """The nodes of a run of sorted sequences: closed ones, open ones, and the open paths, as SHARD_ROWS."""
    rows = rows.combine_chunks()
    number = lambda c: rows[c].fill_null(0).to_numpy().astype(np.int64)
    n, conv, seg, root_a, root_b = (number(c) for c in ("n", "conv_id", "seg", "root_a", "root_b"))
    is_long = rows["long"].is_valid().to_numpy()
    last = rows["last"].to_numpy()
    lists = rows["turns"].chunk(0) if rows["turns"].num_chunks else pa.array([], rows["turns"].type)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    turn = lists.flatten()
    count = len(size)

    # sequences laid out by depth, the root of each as its first turn
    at = np.cumsum(size + 1) - size - 1
    inner = np.ones(int(size.sum()) + count, bool)
    inner[at] = False
    a, b, weight = (np.zeros(len(inner), np.int64) for _ in range(3))
    a[at], b[at] = root_a, root_b
    for out, field in ((a, "a"), (b, "b"), (weight, "bytes")):
        out[inner] = pc.struct_field(turn, field).to_numpy()
    owner = np.repeat(np.arange(count), size + 1)
    level = np.arange(len(inner)) - at[owner]
    by_level = np.lexsort((owner, level))
    dense = np.empty(len(inner), np.int64)
    dense[by_level] = _dense([inner[by_level], b[by_level], a[by_level]]) + 1

    # a turn begins a new node where a sequence has left the path of the one before
    same = np.zeros(len(inner), bool)
    other = at[owner - 1] + level
    known = (owner > 0) & (level <= size[owner - 1])
    same[known] = dense[known] == dense[other[known]]
    left = np.minimum.reduceat(np.where(same, len(inner), level), at)
    fresh = level >= left[owner]

    trie = DoubleArray(int(dense.max(initial=0)))
    state = np.zeros(count, np.int64)
    levels, walked = [], np.searchsorted(level[by_level], np.arange(int(size.max(initial=-1)) + 3))
    names = ("n", "conv", "a", "b", "depth", "bytes", "ends")
    node = {k: np.zeros(len(trie.check), np.int64) for k in names}
    opened = np.zeros(len(trie.check), bool)
    paths = {i: str(conv[i]) if is_long[i] else f"{name}:{i}" for i in {0, count - 1, *np.flatnonzero(is_long).tolist()}}
    path_rows: list[tuple[str, np.ndarray, np.ndarray]] = []
    edge = np.array(sorted(paths))
    for d in range(int(size.max(initial=-1)) + 1):
        here = by_level[walked[d] : walked[d + 1]]
        who, new = owner[here], fresh[here]
        parents, turns = state[who][new], dense[here][new]
        order = np.lexsort((turns, parents))
        trie.add(parents[order], turns[order])
        for k in names:
            node[k] = np.concatenate([node[k], np.zeros(len(trie.check) - len(node[k]), np.int64)])
        opened = np.concatenate([opened, np.zeros(len(trie.check) - len(opened), bool)])
        reached = trie.step(state[who], dense[here])
        born = reached[new]
        node["conv"][born] = np.iinfo(np.int64).max
        node["a"][born] = a[here][new] ^ node["a"][parents] if d else a[here][new]
        node["b"][born] = b[here][new] ^ node["b"][parents] if d else b[here][new]
        node["depth"][born] = seg[who][new] * longest + d
        node["bytes"][born] = weight[here][new]
        if d:
            np.add.at(node["n"], reached, n[who])
            np.minimum.at(node["conv"], reached, conv[who])
        ended = last[who] & (size[who] == d)
        np.add.at(node["ends"], reached[ended], n[who[ended]])
        state[who] = reached
        on_edge = edge[size[edge] >= d]
        opened[state[on_edge]] = True
        if d == 0:
            opened[born] = True
            on_edge = on_edge[seg[on_edge] == 0]  # deeper segments begin where the one before ends
        path_rows.append((d, on_edge, state[on_edge]))
        levels.append(born)

    children, leaves, saved = (np.zeros(len(trie.check), np.int64) for _ in range(3))
    for born in reversed(levels):
        closed = born[~opened[born]]
        leaves[closed] += children[closed] == 0
        saved[closed] += (node["n"][closed] - 1) * node["bytes"][closed]
        up = trie.check[closed]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[closed])
        np.add.at(saved, up, saved[closed])

    every = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    up, rooted = trie.check[every], np.concatenate([np.full(len(x), d == 0) for d, x in enumerate(levels)]) if levels else np.zeros(0, bool)
    is_open = opened[every]
    conv_of = pa.array(node["conv"][every], mask=rooted)
    nodes = {
        "kind": np.where(is_open, "open", "closed").astype(object),
        "a": node["a"][every], "b": node["b"][every],
        "up_a": pa.array(node["a"][up], mask=rooted), "up_b": pa.array(node["b"][up], mask=rooted),
        "up_conv": pa.array(node["conv"][up], mask=rooted | opened[up]), "up_open": opened[up],
        "conv_id": conv_of, "depth": node["depth"][every], "bytes": node["bytes"][every], "n_convs": node["n"][every],
        "n_children": children[every], "n_leaves": leaves[every], "saved_tokens": saved[every], "path": pa.nulls(len(every), pa.string()),
    }
    on, deep = np.concatenate([s for _, _, s in path_rows]), np.concatenate([who for _, who, _ in path_rows])
    schema = pa.schema([(f, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for f, t in (c.split() for c in SHARD_ROWS.split(", "))])
    lines = {
        "kind": pa.array(["path"] * len(on), pa.string()), "a": node["a"][on], "b": node["b"][on], "depth": node["depth"][on],
        "path": pa.array([paths[i] for i in deep.tolist()], pa.string()),
    }
    lines |= {f.name: pa.nulls(len(on), f.type) for f in schema if f.name not in lines}
    both = [pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) if isinstance(x[f.name], np.ndarray) else x[f.name] for f in schema], schema=schema) for x in (nodes, lines)]
    return pa.Table.from_batches(both).combine_chunks().to_batches()[0]


def _shards(sequences: DataFrame, s: Settings) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, turns, shard = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                turns += len(batch.column("turns").flatten())
            if turns >= s.shard_turns:
                yield shard_nodes(pa.Table.from_batches(held), f"{task}:{shard}", s.longest)
                held, turns, shard = [], 0, shard + 1
        if held:
            yield shard_nodes(pa.Table.from_batches(held), f"{task}:{shard}", s.longest)

    order = ["root_a", "root_b", "seg", "turns", "last", "long"]
    return sequences.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, SHARD_ROWS)


def _end_digests(ends: DataFrame) -> DataFrame:
    """For each node (a, b): SHA-256 of the sorted ids of the conversations that end there, comma-joined.

    Ids are range-sorted and joined to pieces first, so that the one task that reads all pieces of a node, as its digest
    must, reads a row for each piece, and holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
            cuts = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1] - 1) != 0)) if len(a) else []
            texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts, [*cuts[1:], len(a)], strict=False)]
            yield pa.RecordBatch.from_pydict({"a": a[cuts], "b": b[cuts], "first": ids[cuts], "ids": pa.array(texts, pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        done: list[tuple[int, int, str]] = []

        def out() -> pa.RecordBatch:
            a, b, sha = zip(*done, strict=True) if done else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], ["a", "b", "ends_sha256"])

        for batch in batches:
            for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (a, b) == key:
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (a, b), hashlib.sha256(ids.encode())
            yield out()
            done = []
        if key is not None:
            done.append((*key, running.hexdigest()))
            yield out()

    order = ["a", "b", "conv_id"]
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "a long, b long, first long, ids string")
    return cut.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_nodes(members: DataFrame, turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The trie of conversations, one row per node; `members` is (conv_id, total), `turns` (conv_id, total, pos, digest, bytes).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A
    conversation without turns is a member of the root alone; without members there is no node, not even a root.
    Conversations of any length are cut into segments, whose nodes are all open; everything else is final in its shard.
    """
    spark = members.sparkSession
    segments = stored(_segments(turns, s.longest))
    sequences = stored(segments.groupBy("root_a", "root_b", "seg", "turns", "last", "long").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")))
    found = stored(_shards(sequences, s), "kind")
    closed, opened, paths = (found.where(F.col("kind") == k) for k in ("closed", "open", "path"))

    count, first = members.agg(F.count("*"), F.min("conv_id")).first()
    if not count:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    columns = ["a", "b", "up_a", "up_b", "conv_id", "depth", "bytes", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shape = ", ".join(f"{c} long" for c in columns)
    root = spark.createDataFrame([(0, 0, None, None, first, 0, 0, count, 0, 0, 0)], shape)
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    kept = [F.max(c).alias(c) for c in ("up_a", "up_b", "depth", "bytes")]
    merged = stored(opened.select(columns).unionByName(root).groupBy("a", "b").agg(*kept, F.min("conv_id").alias("conv_id"), *total.values()))
    below = merged.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    nodes = merged.join(below, ["a", "b"], "left").withColumn("n_children", children).drop("more")
    nodes = stored(nodes.withColumns({
        "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"),
    }))
    lines = paths.select("path", "a", "b", "depth").unionByName(root.select(F.lit("").alias("path"), "a", "b", "depth")).distinct()
    owner = lines.groupBy("a", "b").agg(F.min("path").alias("path"))
    own = nodes.select("a", "b", F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved")).join(owner, ["a", "b"])
    carried = lines.join(own, ["path", "a", "b"], "left").fillna(0, ["_leaves", "_saved"]).withColumn("_up", -F.col("depth"))
    carried = running_totals(carried, {"leaves": "_leaves", "saved": "_saved"}, ["path"], ["_up"])
    sums = carried.groupBy("a", "b").agg(F.sum("leaves").cast("bigint").alias("n_leaves"), F.sum("saved").cast("bigint").alias("saved_tokens"))
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums, ["a", "b"])

    above = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("_up_conv"))
    out = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = F.col("up_open") & ((F.col("up_a") != 0) | (F.col("up_b") != 0))
    inside = closed.where(~top).withColumn("parent_conv_id", F.coalesce("up_conv", F.lit(first)))  # the root is known
    under = closed.where(top).join(above, ["up_a", "up_b"]).withColumn("parent_conv_id", F.col("_up_conv"))
    shared = nodes.join(above, ["up_a", "up_b"], "left").withColumn("parent_conv_id", F.col("_up_conv"))
    every = inside.select(out).unionByName(under.select(out)).unionByName(shared.select(out))

    ends = segments.where("last").select("a", "b", "conv_id")
    ends = ends.unionByName(members.where("total = 0").select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv_id"))
    digests = _end_digests(stored(ends))
    return every.join(digests, ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*out[2:], "ends_sha256")
