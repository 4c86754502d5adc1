"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted similarity.

A window of n words has n - 4 shingles of five words, whatever it holds. So its weighted similarity to an item of n
words (sum of the smaller counts over sum of the larger) grows with the shingles they share, and moving a window right
to its first shared shingle loses none: windows that begin at a shared shingle, or end the text, reach the largest
similarity. Those that could reach the threshold by their number of shared shingles get fingerprints, and what the
index of fingerprints leaves out of them is verified as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import GAPS, KEYS, row_keys, stored, whole_text


@dataclass(frozen=True)
class Settings:
    """Fingerprints have `blocks` blocks of `width` bits. All pairs within blocks * (flips + 1) - 1 bits share a block up to
    `flips` bits, so the index, which holds every item under all those block values, misses none within `radius`.
    A window at the threshold of 0.75 differs by about 22 of 128 bits; more than 40 in one case of 100,000. Such windows
    are verified beside those that the index finds, so the radius decides about no result.
    `broadcast_bytes`: the shingles of the benchmark go to all tasks up to this size and are shuffled beyond it.
    """

    words: int = 5
    percent: int = 75
    blocks: int = 16
    width: int = 8
    flips: int = 2
    radius: int = 40
    broadcast_bytes: int = 16 << 20

    def __post_init__(self):
        if self.radius >= self.blocks * (self.flips + 1):
            raise ValueError("the index would miss fingerprints within this radius")


def words_of(text: Column) -> Column:
    """Lower-case words; none for an empty text."""
    return F.filter(F.split(F.lower(text), GAPS), lambda w: w != "")


def runs_of(words: Column, n: int) -> Column:
    """Hashes of all runs of n words in order, each as an item of just these words; none for a shorter text."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def shingles_of(words: Column, s: Settings) -> Column:
    """Hashes of all runs of `s.words` words in order; a shorter text is one run, an empty one has none."""
    runs = F.sequence(F.lit(1), F.size(words) - (s.words - 1))
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    hashed = F.transform(runs, lambda i: F.xxhash64(*(F.get(words, i - 1 + k) for k in range(s.words))))
    return F.when(F.size(words) >= s.words, hashed).otherwise(whole)


def fingerprint(shingles: Column, s: Settings) -> Column:
    """Each bit by majority over the shingles, every occurrence a vote; as an array of block values."""

    def votes(hashes: Column, bit: int) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.shiftright(h, bit).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))

    def block(i: Column) -> Column:
        hashes = F.transform(shingles, lambda h: F.xxhash64(h, i))
        return sum((F.when(votes(hashes, bit) > 0, 1 << bit).otherwise(0) for bit in range(s.width)), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(s.blocks - 1)), block)


def near_values(s: Settings) -> list[int]:
    """All block values with at most `s.flips` bits set: what a block may differ by."""
    return [v for v in range(1 << s.width) if v.bit_count() <= s.flips]


def shared_weight(one: Column, other: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    def count(where: Column, h: Column) -> Column:
        return F.size(F.filter(where, lambda x: x == h))

    return F.aggregate(F.array_intersect(one, other), F.lit(0), lambda n, h: n + F.least(count(one, h), count(other, h)))


def benchmark_items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """item_id, n_words, shingles, fingerprint of every item with words."""
    words = words_of(whole_text())
    items = benchmark.select(F.col("item_id").alias("item_id"), words.alias("words")).where("size(words) > 0")
    items = items.select("item_id", F.size("words").alias("n_words"), shingles_of(F.col("words"), s).alias("shingles"))
    return items.withColumn("fingerprint", fingerprint(F.col("shingles"), s))


def enough(shared: Column, own: Column, other: Column, s: Settings) -> Column:
    """Whether `shared` of two bags of shingles is at least the asked share of what both hold."""
    return 100 * shared >= s.percent * (own + other - shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """KEYS, doc_id, item_id, start_word, n_words, similarity: the best window of each document and item that match.

    Null texts and items without words match nothing. An item of fewer than five words is one shingle, and so is each
    window of its length: it matches documents that hold just its words in order. A document shorter than an item is one window. Repeated rows and repeated ids with equal text give one row per item; ties
    between windows go to the first. A very long text has a row per
    word while it is searched. Empty tables give no row.
    """
    every = stored(benchmark_items(benchmark, s))
    items = every.where(F.col("n_words") >= s.words)
    sizes = F.size("shingles").alias("item_size")
    # a row per shingle and item, however many items have a shingle in common
    keys = stored(items.select(F.explode("shingles").alias("shingle"), "item_id", "n_words", sizes).distinct())
    text = docs.select(*row_keys(docs), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    cut = text.select(*KEYS, "doc_id", words_of(F.col("text")).alias("words"))
    cut = cut.select(*KEYS, "doc_id", F.size("words").alias("doc_words"), shingles_of(F.col("words"), s).alias("shingles"))
    # outer, as Spark would else filter by the array's size before it and split the text once for each word
    places = cut.select(*KEYS, "doc_id", "doc_words", F.posexplode_outer("shingles").alias("place", "shingle"))
    hits = places.join(small(keys, s), "shingle").select(*KEYS, "doc_id", "doc_words", "place", F.struct("item_id", "n_words", "item_size").alias("h"))
    by_item = hits.groupBy(*KEYS, "doc_id", "doc_words", "h").agg(F.sort_array(F.collect_set("place")).alias("places"))
    # a window holds min(item, document) words; so many shared shingles make the threshold possible
    span = F.least(F.col("h.item_size"), F.greatest(F.col("doc_words") - (s.words - 1), F.lit(1)))
    need = F.ceil(s.percent * (span + F.col("h.item_size")) / (100 + s.percent)).cast("int")
    by_item = by_item.withColumn("span", span).withColumn("need", F.greatest(need, F.lit(1)))
    last = F.greatest(F.col("doc_words") - F.col("h.n_words"), F.lit(0))
    dense = F.filter(F.col("places"), lambda p, i: F.coalesce(F.get(F.col("places"), i + F.col("need") - 1) - p < F.col("span"), F.lit(False)))
    starts = F.transform(dense, lambda p: F.least(p, last))
    asked = by_item.select(*KEYS, "doc_id", F.col("h.item_id").alias("item_id"), F.col("h.n_words").alias("n_words"), "span", F.explode(starts).alias("start"))
    asked = stored(asked.distinct())
    windows = asked.drop("item_id").distinct()
    wanted = windows.groupBy(*KEYS).agg(F.collect_list(F.struct("n_words", "span", "start")).alias("windows"))
    wanted = stored(wanted)
    again = text.join(wanted, KEYS).dropDuplicates(KEYS)
    again = again.withColumn("words", words_of(F.col("text"))).withColumn("shingles", shingles_of(F.col("words"), s))
    again = again.select(*KEYS, "doc_id", "shingles", F.explode("windows").alias("w"))
    bags = again.select(*KEYS, "doc_id", "w.n_words", "w.start", F.slice("shingles", F.col("w.start") + 1, F.col("w.span")).alias("bag"))
    prints = stored(bags.withColumn("print", fingerprint(F.col("bag"), s)).withColumn("window", F.monotonically_increasing_id()))

    entry = F.struct(F.col("block"), F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    index = items.select("item_id", "n_words", "shingles", "fingerprint", F.posexplode("fingerprint").alias("block", "value"))
    index = index.withColumn("flip", F.explode(F.array(*map(F.lit, near_values(s))))).select("item_id", "n_words", entry.alias("entry"))
    probe = prints.select("window", "n_words", F.posexplode("print").alias("block", "value")).select("window", "n_words", F.struct("block", "value").alias("entry"))
    found = probe.join(index, ["n_words", "entry"]).select("window", "item_id").distinct()
    known = items.select("item_id", F.col("shingles").alias("item_bag"), "fingerprint")
    places_of = prints.select("window", *KEYS, "n_words", "start")
    could = asked.select(*KEYS, "n_words", "start", "item_id").join(places_of, [*KEYS, "n_words", "start"]).select("window", "item_id")
    pairs = found.withColumn("by_index", F.lit(True)).join(could.distinct().withColumn("by_count", F.lit(True)), ["window", "item_id"], "full")
    pairs = pairs.join(prints, "window").join(known, "item_id")
    apart = F.aggregate(F.zip_with("print", "fingerprint", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    open_ = (apart <= s.radius) | F.col("by_count")  # what the index missed, the count of shared shingles still asks about
    near = pairs.where(open_).withColumn("shared", shared_weight(F.col("bag"), F.col("item_bag")))
    own, other = F.size("bag"), F.size("item_bag")
    checked = near.where(enough(F.col("shared"), own, other, s)).withColumn("similarity", F.col("shared") / (own + other - F.col("shared")))
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    out = checked.groupBy(*KEYS, "doc_id", "item_id").agg(best.alias("best"))
    out = out.select(*KEYS, "doc_id", "item_id", F.col("best.start").alias("start_word"), "best.n_words", "best.similarity")
    short = stored(every.where(F.col("n_words") < s.words).select("n_words", "item_id", F.get("shingles", F.lit(0)).alias("run")))
    for row in short.select("n_words").distinct().collect():  # four at most
        out = out.unionByName(short_items(text, short.where(F.col("n_words") == row.n_words), row.n_words, s))
    return out


def small(rows: DataFrame, s: Settings) -> DataFrame:
    """The rows, to be sent to all tasks if they are few bytes; 64 for each and the text of its item's id."""
    size = rows.agg(F.sum(64 + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)))).first()[0] or 0
    return F.broadcast(rows) if size <= s.broadcast_bytes else rows


def short_items(text: DataFrame, items: DataFrame, n: int, s: Settings) -> DataFrame:
    """The rows of `contaminated` for items of n words, fewer than a shingle has: the first window that is the item."""
    runs = text.select(*KEYS, "doc_id", words_of(F.col("text")).alias("words"))
    runs = runs.select(*KEYS, "doc_id", F.posexplode_outer(runs_of(F.col("words"), n)).alias("start_word", "run"))
    first = runs.join(small(items, s), "run").groupBy(*KEYS, "doc_id", "item_id", "n_words").agg(F.min("start_word").alias("start_word"))
    return first.select(*KEYS, "doc_id", "item_id", "start_word", "n_words", F.lit(1.0).alias("similarity"))
