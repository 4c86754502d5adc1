"""Registry lookups by name and by id, and column discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgauge.operators.containment import first_match

#: Matches up to this number become a local table of known size.
FEW = 10_000


def _entries(registry: DataFrame) -> DataFrame:
    return registry.select(F.lower("name").alias("entry"), F.struct("ord", "name", "short").alias("hit"))


def match_name(
    df: DataFrame, registry: DataFrame, column: str, prefix: str, names: DataFrame | None = None
) -> DataFrame:
    """Find, for each name, the first registry entry whose name contains it or is contained in it.

    Case is ignored. Adds `{prefix}_name` and `{prefix}_short`, NULL without a match.

    The distinct names are matched through an index of the registry on rare pieces of three
    characters instead of comparing every pair, and the result is joined back by name. The
    distinct names come from `df`, which is read once more for them, or from `names`, any
    table whose first column holds every name that can occur. Matches of such a table are
    found beforehand when there are few, so that their size is known when the join is planned
    and big rows need no shuffle. `match_sums` reads rows without such a table only once.
    """
    given_names = names is not None
    known = names if given_names else df.select(column)
    names = known.select(F.lower(known[known.columns[0]]).alias("given")).where("given IS NOT NULL").distinct()
    best = first_match(names, _entries(registry)).select(
        "given", F.col("hit.name").alias(f"{prefix}_name"), F.col("hit.short").alias(f"{prefix}_short")
    )
    if given_names:
        few = best.limit(FEW + 1).toArrow()
        if few.num_rows <= FEW:
            best = df.sparkSession.createDataFrame(few)
    key = f"{prefix}_key"
    return df.withColumn(key, F.lower(column)).join(best.withColumnRenamed("given", key), key, "left").drop(key)


def match_sums(
    df: DataFrame, registry: DataFrame, column: str, prefix: str, keys: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Sums per name and `keys`, with the registry entry that `match_name` finds for the name. `df` is read once.

    For names that no table but the facts holds. The facts shrink to a row per name and keys
    before anything else; the sums of a name then travel through the match in an array, so
    `keys` should have few values for each name, as months have. Rows without a name have no match.
    """
    totals = df.groupBy(column, *keys).agg(*[value.alias(name) for name, value in sums.items()])
    columns = [column, *keys, *sums]
    given = F.coalesce(F.lower(column), F.lit(""))
    names = totals.groupBy(given.alias("given")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    found = first_match(names, _entries(registry)).select(F.inline("rows"), "hit")
    hit = F.when(F.col(column).isNotNull(), F.col("hit"))
    return found.select(*columns, hit["name"].alias(f"{prefix}_name"), hit["short"].alias(f"{prefix}_short"))


def with_store(df: DataFrame, registry: DataFrame, column: str = "IdStore") -> DataFrame:
    """Add the registry entry of a store id, NULL without one."""
    entries = registry.select(
        F.col("id").alias(column), F.col("name").alias("registry_name"), F.col("short").alias("registry_short")
    )
    return df.join(entries, column, "left")


def find_col(df: DataFrame, *patterns: str) -> str | None:
    """The first column whose name contains one of the patterns, in any case."""
    return next((c for c in df.columns if any(p.lower() in c.lower() for p in patterns)), None)


def safe_sum(df: DataFrame, pattern: str) -> Column:
    """Sum of the first column like `pattern`; 0 without such a column or without values."""
    found = find_col(df, pattern)
    return F.lit(0) if found is None else F.coalesce(F.sum(found), F.lit(0))


def safe_mean(df: DataFrame, pattern: str) -> Column:
    """Mean of the first column like `pattern`; 0 without such a column, NULL without values."""
    found = find_col(df, pattern)
    if found is None:
        return F.lit(0.0)
    return F.sum(found).cast("double") / F.nullif(F.count(found), F.lit(0))
