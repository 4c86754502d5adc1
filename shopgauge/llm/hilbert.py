"""Sharding in Hilbert-curve order, so that a file covers a small box of the metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgauge.llm.shared import KEYS, row_keys, running_total, stored, whole_text

BITS = 8


def grid_of_size(size: Column) -> Column:
    """Length in bits and the two bits below the leading one: four steps per doubling, below 2**BITS."""
    bits = F.length(F.bin(size))
    below = F.call_function("shiftright", F.shiftleft(size, 2), bits - 1).bitwiseAND(F.lit(3))
    return F.least((bits - 1) * 4 + below, F.lit((1 << BITS) - 1)).cast("int")


def grid_of_values(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of a text column among its distinct values (null first), scaled to 2**BITS steps."""
    values = df.select(F.col(column).alias("_value")).distinct()
    rank = F.row_number().over(Window.orderBy(F.col("_value").asc_nulls_first())) - 1
    grid = F.floor(rank * (1 << BITS) / F.count("*").over(Window.partitionBy())).cast("int")
    return df.join(values.withColumn(out, grid), F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def with_curve(df: DataFrame, columns: list[str], out: str, bits: int = BITS) -> DataFrame:
    """Adds the Hilbert index of the integer columns, each below 2**bits. Every step is a projection in generated code."""
    axes = [f"_x{i}" for i in range(len(columns))]
    df = df.withColumns({a: F.col(c).cast("bigint") for a, c in zip(axes, columns, strict=True)})
    first = axes[0]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in axes:
            is_set = F.col(axis).bitwiseAND(F.lit(1 << bit)) != 0
            swap = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(F.lit(low))
            new = {first: F.when(is_set, F.col(first).bitwiseXOR(F.lit(low))).otherwise(F.col(first).bitwiseXOR(swap))}
            if axis != first:
                new[axis] = F.when(is_set, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap))
            df = df.withColumns(new)
    for before, axis in zip(axes, axes[1:], strict=False):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    last = F.col(axes[-1])
    flips = [F.when(last.bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)) for bit in range(1, bits)]
    df = df.withColumn("_flip", reduce(lambda a, b: a.bitwiseXOR(b), flips))
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col("_flip")) for a in axes})
    spread = [F.shiftleft(F.shiftright(F.col(a), bit).bitwiseAND(F.lit(1)), bit * len(axes) + len(axes) - 1 - i) for bit in range(bits) for i, a in enumerate(axes)]
    return df.withColumn(out, reduce(lambda a, b: a + b, spread)).drop(*axes, "_flip")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """KEYS, doc_id, size, text_crc32, law, curve, shard, slot, grown_shard: one row per document.

    Language, source and size are quantised and put on a Hilbert curve; the curve is cut into `shards` runs of rows
    whose counts differ by one at most (law `rows`). Ties on the curve follow a digest of id and text. Null texts have
    no bytes, null languages and sources are values of their own, and an empty table gives no row. Rows that agree in
    everything are interchangeable.
    """
    text = whole_text()
    rows = docs.select(
        *row_keys(docs),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary")).alias("place"),
    )
    rows = stored(rows)  # the range sort reads its input twice
    axes = grid_of_values(grid_of_values(rows, "lang", "lang_step"), "source", "source_step")
    axes = axes.withColumn("size_step", grid_of_size(F.col("size")))
    placed = with_curve(axes, ["lang_step", "source_step", "size_step"], "curve").withColumn("one", F.lit(1))
    ranked = running_total(placed, "one", [], ["curve", "place", "doc_id", *KEYS], "rank")
    n = max(1, rows.count())
    cut = ranked.withColumn("shard", F.expr(f"((rank - 1) * {shards}) div {n}").cast("int"))
    start = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return cut.select(
        *KEYS, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "curve", "shard",
        (F.col("rank") - 1 - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
