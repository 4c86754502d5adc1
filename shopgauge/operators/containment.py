"""Which texts contain which others: candidates share a rare piece of three characters, and comparing the texts confirms them.

A text has at most three pieces per character, so what is shuffled grows with the length of the texts, and a text meets
only those that hold its rarest piece. Nothing compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest piece; shorter texts are their own piece.
SIZE = 3


def _pieces(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def pieces(text: Column) -> Column:
    """All pieces of up to three characters that a text holds, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *(_pieces(text, n) for n in range(1, SIZE + 1))))


def whole_pieces(text: Column) -> Column:
    """The pieces of three characters; a shorter text is its own piece."""
    return F.when(F.length(text) >= SIZE, F.array_distinct(_pieces(text, SIZE))).otherwise(F.array(text))


def rarest_piece(texts: DataFrame, column: str, held: DataFrame | None = None) -> DataFrame:
    """Each distinct text with the piece of it that fewest texts hold; `held` (piece, held) counts them elsewhere."""
    own = texts.select(column).distinct().select(column, F.explode(whole_pieces(F.col(column))).alias("piece"))
    if held is None:
        held = own.groupBy("piece").agg(F.count("*").alias("held"))
    rare = own.join(held, "piece").groupBy(column).agg(F.min(F.struct("held", "piece")).alias("rare"))
    return rare.select(column, F.col("rare.piece").alias("piece"))


def contained(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs (text, part) of distinct texts and distinct parts that they contain, null on neither side."""
    asked = texts.select(text).where(F.col(text).isNotNull()).distinct().select(text, F.explode(pieces(F.col(text))).alias("piece"))
    known = rarest_piece(parts.where(F.col(part).isNotNull()), part)
    return asked.join(known, "piece").where(F.col(text).contains(F.col(part))).select(text, part)


def first_match(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds to each row the least `hit` of the entries whose text contains its name or is contained in it, NULL without.

    `names` has a row per distinct `given` text, and any other columns; `entries` has `entry` and `hit`. The names run
    through a single chain of joins with tables made from the entries, so whatever they come from is read once; their
    other columns travel on one row of each name only.
    """
    carried = [c for c in names.columns if c != "given"]
    payload = F.struct(*carried) if carried else F.lit(True)
    entries = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.min("hit").alias("hit"))
    holding = entries.select("entry", "hit", F.explode(pieces(F.col("entry"))).alias("piece"))
    held = holding.groupBy("piece").agg(F.count("*").alias("held"))
    indexed = rarest_piece(entries, "entry", held).join(entries, "entry")
    probes = indexed.select("piece").distinct().withColumn("probe", F.lit(True))
    dictionary = held.join(probes, "piece", "left")

    asked = names.select("given", payload.alias("payload"), F.explode(pieces(F.col("given"))).alias("piece"))
    asked = asked.withColumn("payload", F.when(F.col("piece") == "", F.col("payload"))).join(dictionary, "piece", "left")
    own = F.length("piece") == F.least(F.lit(SIZE), F.length("given"))
    each = asked.groupBy("given").agg(
        F.collect_list(F.when(F.col("probe"), F.struct(F.lit("part").alias("role"), "piece"))).alias("probes"),
        F.min(F.when(own, F.struct(F.coalesce("held", F.lit(0)).alias("held"), "piece"))).alias("rare"),
        F.max("payload").alias("payload") if not carried else F.first("payload", ignorenulls=True).alias("payload"),
    )
    whole = F.when(F.col("rare.held") > 0, F.array(F.struct(F.lit("whole").alias("role"), F.col("rare.piece").alias("piece"))))
    nothing = F.array(F.struct(F.lit("none").alias("role"), F.lit("").alias("piece")))
    looked = each.select("given", "payload", F.inline(F.concat(nothing, "probes", F.coalesce(whole, F.slice(nothing, 1, 0)))))
    looked = looked.withColumn("payload", F.when(F.col("role") == "none", F.col("payload")))
    posts = indexed.select(F.lit("part").alias("role"), "piece", "entry", "hit").unionByName(
        holding.select(F.lit("whole").alias("role"), "piece", "entry", "hit")
    )
    right = F.when(F.col("role") == "part", F.col("given").contains(F.col("entry"))).otherwise(F.col("entry").contains(F.col("given")))
    found = looked.join(posts, ["role", "piece"], "left").groupBy("given").agg(
        F.min(F.when(right, F.col("hit"))).alias("hit"), F.first("payload", ignorenulls=True).alias("payload")
    )
    return found.select("given", *(F.col(f"payload.{c}") for c in carried), "hit")
