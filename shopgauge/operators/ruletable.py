"""Product categories from a table of rules, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.config import CategoryRules
from shopgauge.functions.expressions import CATEGORY, free_name
from shopgauge.operators.containment import contained

RULES = "ord int, category string, pattern string"


def rule_table(spark: SparkSession, rules: CategoryRules) -> DataFrame:
    """Ordered rules as rows: the first class whose pattern matches decides."""
    rows = [(i, name, pattern) for i, (name, patterns) in enumerate(rules.classes) for pattern in patterns]
    return spark.createDataFrame(rows, RULES)


def _longest_literal(pattern: Column) -> Column:
    """The longest run of a LIKE pattern without wildcards (an escaped character ends a run, too); the first one of equals."""
    runs = F.split(F.regexp_replace(pattern, r"\\.", "%"), "[%_]+")
    return F.element_at(F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.length(r)).alias("size"), i.alias("i"), r.alias("run")))), 1)["run"]


def classified_by_table(
    df: DataFrame, column: str, rules: DataFrame, fallback: str, name: str = CATEGORY, case_sensitive: bool = False
) -> DataFrame:
    """Add the category of a description by a table of rules (`ord`, `category`, `pattern`): LIKE, the least `ord` wins.

    The same as a chain of predicates, but 10,000 rules make a plan of the same size as ten: a
    pattern can match only descriptions that hold its longest literal, which an index on rare
    pieces of three characters finds; LIKE then decides. Rules with the same `ord` should have
    one category, else the least one counts; rules without an order or a pattern never match.
    The distinct descriptions are matched and joined back, so `df` is read twice: give it the
    dimension that holds the descriptions rather than the facts.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    usable = rules.where("ord IS NOT NULL AND pattern IS NOT NULL")
    patterns = usable.select(F.struct("ord", "category").alias("rule"), fold(F.col("pattern")).alias("pattern"))
    patterns = patterns.withColumn("part", _longest_literal(F.col("pattern")))
    texts = df.select(fold(F.col(column)).alias("text")).where("text IS NOT NULL").distinct()
    pairs = contained(texts, "text", patterns, "part").join(patterns, "part").where("text LIKE pattern")
    text, found = free_name(df, "text"), free_name(df, "found")
    first = pairs.groupBy("text").agg(F.min("rule")["category"].alias(found)).withColumnRenamed("text", text)
    joined = df.join(first, fold(F.col(column)) == F.col(text), "left").drop(text)
    return joined.withColumn(name, F.coalesce(found, F.lit(fallback))).drop(found)
