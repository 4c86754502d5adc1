"""Store, category, group and month registries as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopgauge import config, schemas


def store_registry(spark: SparkSession, stores=config.STORES) -> DataFrame:
    """`(ord, id, name, short)`; the order decides ties."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(stores)], schemas.STORE_REGISTRY)


def category_registry(spark: SparkSession, categories=config.CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(categories)], schemas.CATEGORY_REGISTRY)


def category_names(spark: SparkSession, rules: config.CategoryRules) -> DataFrame:
    """Every category a rule table can give."""
    names = dict.fromkeys([name for name, _ in rules.classes] + [rules.fallback])
    return spark.createDataFrame([(name,) for name in names], "name string")


def store_groups(spark: SparkSession, groups=config.STORE_GROUPS) -> DataFrame:
    return spark.createDataFrame(list(groups), schemas.STORE_GROUPS)


def month_labels(spark: SparkSession, labels=config.MONTH_LABELS) -> DataFrame:
    return spark.createDataFrame(list(labels), schemas.MONTH_LABELS)
