"""Column expressions shared by the layers: month keys, ratios, wildcard rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgauge.config import CategoryRules, CostBucket


def month_start(col: Column) -> Column:
    """First day of the month. Facts are grouped on this date and formatted once per group."""
    return F.trunc(col, "MM")


def month_key(col: Column) -> Column:
    """`YYYY-MM` of a date or timestamp."""
    return F.date_format(col, "yyyy-MM")


def gross_profit(revenue: Column, transfer: Column) -> Column:
    """Both are line totals, so no quantity enters."""
    return revenue - transfer


def pct(num: Column, den: Column, default: float | None = None) -> Column:
    """`num / den * 100` as double where `den` is positive, else `default`."""
    ratio = num.cast("double") / den.cast("double") * 100
    return F.when(den > 0, ratio).otherwise(F.lit(default).cast("double"))


def mean(col: Column) -> Column:
    """Mean over the non-null rows of a group, summed exactly when `col` is decimal."""
    return F.sum(col).cast("double") / F.nullif(F.count(col), F.lit(0))


def mean_over(col: Column, window) -> Column:
    """`mean` of a decimal column over a window."""
    return F.sum(col).over(window).cast("double") / F.nullif(F.count(col).over(window), F.lit(0))


def money_mean(col: Column) -> Column:
    """Mean of an amount as an amount of four places, which later means can sum exactly."""
    return F.round(F.sum(col) / F.nullif(F.count(col), F.lit(0)), 4).cast("decimal(19,4)")


def round2(col: Column) -> Column:
    return F.round(col, 2)


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


#: Column of the category that rules give a sales line.
CATEGORY = "BenchmarkCategory"


def like_match(col: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Wildcard match; the optimiser turns `%word%` and `word%` into contains and starts-with."""
    return col.like(pattern) if case_sensitive else col.ilike(pattern)


def classify(col: Column, rules: CategoryRules) -> Column:
    """Category of a description: the first class with a matching pattern, else the fallback.

    With rules that ignore case, `col` is the description in lower case. Last classes that
    equal the fallback decide nothing and are left out.
    """
    classes = list(rules.classes)
    while classes and classes[-1][0] == rules.fallback:
        classes.pop()
    fold = (lambda p: p) if rules.case_sensitive else str.lower
    result = None
    for category, patterns in classes:
        hit = reduce(Column.__or__, [col.like(fold(p)) for p in patterns])
        result = F.when(hit, F.lit(category)) if result is None else result.when(hit, F.lit(category))
    return F.lit(rules.fallback) if result is None else result.otherwise(F.lit(rules.fallback))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case: `name` behind as many underscores as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def classified(df: DataFrame, column: str, rules: CategoryRules, name: str = CATEGORY) -> DataFrame:
    """Add the category of a description; the text is lowered once, in a projection of its own."""
    if rules.case_sensitive:
        return df.withColumn(name, classify(F.col(column), rules))
    lower = free_name(df, "lower")
    return df.withColumn(lower, F.lower(column)).withColumn(name, classify(F.col(lower), rules)).drop(lower)


def in_bucket(col: Column, bucket: CostBucket, case_sensitive: bool = False) -> Column:
    """Whether a cost category belongs to a bucket; a missing category belongs to none."""
    fold = (lambda s: s) if case_sensitive else str.lower
    text = col if case_sensitive else F.lower(col)
    hits = [text.startswith(fold(p)) for p in bucket.prefixes]
    if bucket.equals:
        hits.append(text.isin([fold(e) for e in bucket.equals]))
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False))


def banded(col: Column, bands, otherwise: str, at_least: bool) -> Column:
    """Label by thresholds: the first band with `col >= limit` (or `col < limit`)."""
    result = F
    for limit, label in bands:
        result = result.when(col >= limit if at_least else col < limit, F.lit(label))
    return result.otherwise(F.lit(otherwise))
