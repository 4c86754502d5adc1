"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgauge.llm.shared import KEYS, WORD, row_keys, running_total, stored, whole_text

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
REPEATS = 3


def units(docs: DataFrame) -> DataFrame:
    """One row per document, repeated rows counted: KEYS, doc_id, source, text digest, size in words, rows, place in the shuffle."""
    text = whole_text()
    rows = docs.select(
        *row_keys(docs),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.md5(text.cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
    )
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest").cast("binary"))
    return rows.groupBy(*KEYS, "doc_id", "source", "digest", "size").agg(F.count("*").alias("rows")).withColumn("place", place)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: number in code point order (null last), size, target.

    Filling level: with the sources sorted by cap over weight, the level if exactly the first ones are capped is
    largest at the right cut; a source gets its weight times that level, or its cap.
    """
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier, later = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    levels = capped.withColumn("level", level)
    share = F.col("weight") * F.max("level").over(everything)
    return levels.select("source", "source_no", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """KEYS, doc_id, source, digest, size, rows, source_size, target and copies of each distinct document.

    Documents are shuffled by a digest, so reruns agree. The k-th copy of a document finishes at (k - 1 times the
    source's size, plus what the source has queued up to the document) over the target; copies that start before their
    source's target are range-sorted by that time, and the queue is cut where the words exceed the total. Documents
    without words are never queued and take nothing; null source is a source of its own; empty input gives no row.
    """
    rows = stored(units(docs))
    by_source = targets(rows, weights, repeats).withColumnRenamed("source", "_source")
    # one row per source; broadcast only below Spark's threshold, split by adaptive execution otherwise
    known = rows.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = known.withColumn("words", F.col("size") * F.col("rows"))
    ahead = running_total(queued, "words", ["source_no"], ["place", "doc_id", "digest", *KEYS], "ahead")
    copies = ahead.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("copy") * F.col("source_size") + F.col("ahead")
    copies = copies.withColumn("asked", (F.col("size") > 0) & (end - F.col("words") < F.col("target")))
    copies = copies.where(F.col("asked") | (F.col("copy") == 0)).withColumn("finish", F.when(F.col("asked"), end / F.col("target")).otherwise(0.0))
    copies = copies.withColumn("load", F.when(F.col("asked"), F.col("words")).otherwise(0))
    total = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    line = running_total(copies, "load", [], ["finish", "source_no", "place", "doc_id", "digest", *KEYS, "copy"], "sent")
    keys = [*KEYS, "doc_id", "source", "digest", "size", "rows", "source_size", "target"]
    return line.groupBy(*keys).agg(F.sum((F.col("asked") & (F.col("sent") <= total)).cast("bigint")).alias("copies"))


def mixed_words(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken."""
    each = mix(docs).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
