"""Near-duplicates: MinHash bands propose, sequential Bayesian tests on signatures prune, full shingle sets decide.

Documents with equal shingle sets are one node from the start. In each bucket of equal band values one member is
compared with all others, which joins large groups without forming their pairs; members of a bucket that are then
still in different components are compared inside tasks, block by block, until links join all that are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from shopgauge.llm.graph import components
from shopgauge.llm.shared import KEYS, row_keys, stored, whole_text
from shopgauge.llm.words import mixed, pieces, shingle_set, text_bytes, word_hashes


@dataclass(frozen=True)
class Settings:
    """Documents whose sets have `percent` or more of their union in common are linked.

    bands * rows values make a signature; a pair at the threshold shares no band with probability (1 - 0.75**4)**32,
    5 in a million. Signatures are compared `step` values at a time, and a pair is dropped when the posterior
    probability of the threshold or more, from a uniform prior, falls below `miss`.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    step: int = 32
    miss: float = 1e-6
    block: int = 1000


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    number = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return number[:count] | np.uint64(1), number[count:]


def signature(found: np.ndarray, count: int) -> np.ndarray:
    """The `count` smallest values of as many hash functions over a non-empty set, 32 bits each."""
    a, b = _hashers(count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (a[:, None] * found[None, i : i + 2048] + b[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def set_name(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([mixed(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(found * np.uint64(0x2545F4914F6CDD1D)))], np.uint64).tobytes()


def least_matches(s: Settings) -> dict[int, int]:
    """For each number of compared values the fewest matches that keep a pair.

    After m matches in n the posterior is Beta(m + 1, n - m + 1); its tail above x is the chance of at most m
    successes in n + 1 trials of probability x.
    """
    out, x = {}, s.percent / 100
    for n in range(s.step, s.bands * s.rows + 1, s.step):
        tail, m = 0.0, -1
        while tail < s.miss:
            m += 1
            tail += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out[n] = m
    return out


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, KEYS, n_shingles, name and signature of each document's set; the last two null without words."""
    count = s.bands * s.rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            hashes, of = word_hashes(*text_bytes(piece.column("text")))
            sets = [shingle_set(hashes[a:b], s.words) for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"),
                **{k: piece.column(k) for k in KEYS},
                "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                "name": pa.array([set_name(x) if len(x) else None for x in sets], pa.binary()),
                "signature": pa.array([signature(x, count).tobytes() if len(x) else None for x in sets], pa.binary()),
            })

    return _texts(docs).mapInArrow(sketch, f"doc_id long, {KEYS[0]} long, {KEYS[1]} long, n_shingles long, name binary, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*row_keys(docs), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def proposed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that the sequential test on their signatures keeps."""
    least = least_matches(s)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("of_a", "of_b"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, int)
            for n, m in least.items():
                matches[alive] += (left[alive, n - s.step : n] == right[alive, n - s.step : n]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    one, two = (sets.select(F.col("name").alias(c), F.col("signature").alias(f"of_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(test, "a binary, b binary")


def linked(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough. `texts`: name, text.

    Each `a` is sent once with every few hundred of its partners, sorted in front of them, and only its set is kept.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    heads = dealt.select("a", "part", F.col("a").alias("name"), F.lit(0).alias("member")).distinct()
    rows = heads.union(dealt.select("a", "part", F.col("b").alias("name"), F.lit(1).alias("member"))).join(texts, "name")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, kept = np.zeros(0, np.uint64), {"a": [], "b": []}
        for piece in pieces(batches):
            hashes, of = word_hashes(*text_bytes(piece.column("text")))
            ends, names, member = piece.column("a").to_pylist(), piece.column("name").to_pylist(), piece.column("member").to_pylist()
            for i, name in enumerate(names):
                own = shingle_set(hashes[of[i] : of[i + 1]], s.words)
                if not member[i]:
                    head = own
                    continue
                both = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum())
                if 100 * both >= s.percent * (len(head) + len(own) - both):
                    kept["a"].append(ends[i])
                    kept["b"].append(name)
            yield pa.RecordBatch.from_pydict(kept, pa.schema([("a", pa.binary()), ("b", pa.binary())]))
            kept = {"a": [], "b": []}

    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.select("a", "name", "member", "text").mapInArrow(verify, "a binary, b binary")


def buckets_of(sets: DataFrame, s: Settings) -> DataFrame:
    """bucket, name for every band of every set, of buckets with two sets or more."""
    width = 4 * s.rows
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(s.bands)))
    rows = sets.select("name", F.explode(keys).alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("name").alias("head")).where("n > 1")
    return rows.join(many, "bucket").select("bucket", "n", "head", "name")


def blocks_of(rest: DataFrame, s: Settings) -> DataFrame:
    """The rows of large buckets once for every pair of blocks (i, j) in which they may meet another root; own: the row's block.

    Rows of the root that most rows of a bucket have are joined already and never meet each other: they lie in blocks
    below 0, which meet the blocks of the others only. So a large group with few strays is sent about once.
    """
    roots = rest.groupBy("bucket", "root").agg(F.count("*").alias("rows"))
    main = roots.groupBy("bucket").agg(F.max(F.struct("rows", "root")).alias("main"), F.sum("rows").alias("all"))
    blocks = main.select(
        "bucket", F.col("main.root").alias("main"), F.ceil(F.col("main.rows") / s.block).cast("int").alias("chunks"),
        F.ceil((F.col("all") - F.col("main.rows")) / s.block).cast("int").alias("blocks"),
    )
    name, others, chunks = F.xxhash64("name"), F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(1), F.col("chunks"))

    def pair(i: Column, j: Column, own: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), own.cast("int").alias("own"))

    chunk, mine = -1 - F.pmod(name, "chunks"), F.pmod(name, "blocks")
    joined = F.transform(others, lambda j: pair(chunk, j, chunk))
    stray = F.concat(F.transform(others, lambda j: pair(F.least(mine, j), F.greatest(mine, j), mine)), F.transform(chunks, lambda k: pair(-k, mine, mine)))
    rows = rest.join(blocks, "bucket").withColumn("at", F.explode(F.when(F.col("root") == F.col("main"), joined).otherwise(stray)))
    return rows.select("bucket", "at.i", "at.j", "at.own", "name", "root")


def likely(rows: list[dict], s: Settings) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a block pair with different roots that the sequential test keeps.

    A pair that shares several bands is left to the first, as far as the rows tell which band theirs is.
    """
    least = least_matches(s)
    sig = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint32).reshape(len(rows), -1)
    banded = sig.reshape(len(rows), s.bands, s.rows)
    shared = np.flatnonzero((banded == banded[:1]).all(axis=(0, 2)))
    band = shared[0] if len(shared) else 0
    roots = np.unique([r["root"].hex() for r in rows], return_inverse=True)[1]
    own = np.array([r["own"] for r in rows])
    i, j = rows[0]["i"], rows[0]["j"]
    for x in range(len(rows)):
        if i == j:
            alive = np.arange(x + 1, len(rows))
        else:
            alive = np.flatnonzero(own == j) if own[x] == i else np.zeros(0, int)
        alive = alive[roots[alive] != roots[x]]
        matches = np.zeros(len(alive), int)
        for n, m in least.items():
            matches += (sig[alive, n - s.step : n] == sig[x, n - s.step : n]).sum(axis=1)
            alive, matches = alive[matches >= m], matches[matches >= m]
        if len(alive):
            first = (banded[alive] == banded[x]).all(axis=2).argmax(axis=1)
            for y in alive[first >= band]:
                yield x, int(y)


def in_blocks(rows: DataFrame, handle, fields: dict[str, pa.DataType]) -> DataFrame:
    """What `handle` makes (dicts) of the rows of each block pair; one block pair is in memory at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (at := (row["bucket"], row["i"], row["j"])) != key:
                    out += handle(held) if held else []
                    key, held = at, []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held and (out := handle(held)):
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(list(fields.items()))
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(each, from_arrow_schema(schema))


def rest_links(rest: DataFrame, sets: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join all components whose members in a bucket (bucket, n, name, root) are linked.

    First the rows that have a likely partner are found from signatures alone. They come back with their texts, and
    likely pairs are verified on full sets; pairs that links of the same block already join are skipped, so a block
    gives fewer links than it has rows, however many pairs it holds.
    """
    def partners(rows: list[dict]) -> list[dict]:
        found = {x for pair in likely(rows, s) for x in pair}
        return [{k: rows[x][k] for k in ("bucket", "i", "j", "own", "name", "root", "signature")} for x in sorted(found)]

    def verified(rows: list[dict]) -> list[dict]:
        own, out, up = {}, [], {}

        def top(root: bytes) -> bytes:
            while root in up:
                root = up[root]
            return root

        def shingled(x: int) -> np.ndarray:
            if x not in own:
                text = pa.array([rows[x]["text"]], pa.large_string())
                own[x] = shingle_set(word_hashes(*text_bytes(text))[0], s.words)
            return own[x]

        for x, y in likely(rows, s):
            one, two = top(rows[x]["root"]), top(rows[y]["root"])
            if one == two:
                continue
            both = len(np.intersect1d(shingled(x), shingled(y), assume_unique=True))
            if 100 * both >= s.percent * (len(own[x]) + len(own[y]) - both):
                up[max(one, two)] = min(one, two)
                out.append({"a": rows[x]["name"], "b": rows[y]["name"]})
        return out

    rows = blocks_of(rest, s).join(sets.select("name", "signature"), "name")
    fields = {"bucket": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "name": pa.binary(), "root": pa.binary(), "signature": pa.binary()}
    open_rows = stored(in_blocks(rows.select(*fields), partners, fields))
    full = open_rows.join(texts, "name").select(*fields, "text")
    return in_blocks(full, verified, {"a": pa.binary(), "b": pa.binary()})


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, root (one value per component, null without words), KEYS.

    component_id is the smallest id reachable over links; null ids link but never name a component, unless all its ids
    are null. kept: the row has the component's id; rows repeated with that id are all kept, as they are the same
    document. A document without words is linked with nothing. A very long text is one set, hashed whole in memory. An empty table gives no rows.
    """
    rows = stored(sketches(docs, s))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *KEYS))
    sets = rows.where("name is not null").groupBy("name").agg(first.alias("first"), F.min("signature").alias("signature"))
    sets = stored(sets.select("name", "first.doc_id", *(f"first.{k}" for k in KEYS), "signature"))
    buckets = stored(buckets_of(sets, s))
    wanted = buckets.select("name").distinct().join(sets, "name").select("name", *KEYS)
    found = _texts(docs).join(wanted, KEYS)
    texts = stored(found.select("name", "text").dropDuplicates(["name"]))

    pairs = buckets.where("name <> head").select(F.col("head").alias("a"), F.col("name").alias("b")).distinct()
    links = stored(linked(stored(proposed(pairs, sets, s)), texts, s))
    roots = components(links)

    members = buckets.where("name <> head").join(roots, F.col("name") == F.col("node"), "left")
    members = stored(members.select("bucket", "n", "name", F.coalesce("root", "name").alias("root")))
    open_ = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    more = rest_links(members.join(open_, "bucket"), sets, texts, s)
    roots = components(links.union(more))

    # by set, not by document, and from tables, so that Spark can split the rows of a large component or group of copies
    of_set = sets.join(roots, F.col("name") == F.col("node"), "left").select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    of_set = stored(of_set)
    ids = stored(of_set.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least_id")))
    placed = stored(of_set.join(ids, F.col("root") == F.col("of")).select(F.col("name").alias("of_name"), "root", "least_id"))
    out = rows.join(placed, F.col("name") == F.col("of_name"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root", *KEYS)
