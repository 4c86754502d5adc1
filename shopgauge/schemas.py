"""Schemas of the four sources and the column lists of the published views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(19, 4)
AREA = T.DecimalType(12, 2)

SALES = T.StructType([
    T.StructField("ID_CALMONTH", T.DateType()),
    T.StructField("ID_STORE", T.IntegerType()),
    T.StructField("ID_MATERIAL", T.LongType()),
    T.StructField("ProduktBeschreibung", T.StringType()),
    T.StructField("RevenueEUR", MONEY),
    T.StructField("TransferPriceEUR", MONEY),
    T.StructField("SalesPriceEUR", MONEY),
    T.StructField("SalesAmount", T.IntegerType()),
])

COSTS = T.StructType([
    T.StructField("ID_CALMONTH", T.DateType()),
    T.StructField("ID_STORE", T.IntegerType()),
    T.StructField("StoreName", T.StringType()),
    T.StructField("Kostenkategorie", T.StringType()),
    T.StructField("WertEUR", MONEY),
])

SALESORG = T.StructType([
    T.StructField("SALESORG_ID", T.IntegerType()),
    T.StructField("STORE_LOCATION", T.StringType()),
])

LOCATION = T.StructType([
    T.StructField("ID_STORE", T.IntegerType()),
    T.StructField("LOC_SIZE_M2", AREA),
    T.StructField("LOC_RENT_EUR_M2", AREA),
    T.StructField("LOC_NEBENKOSTEN_EUR", AREA),
])

STORE_REGISTRY = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("short", T.StringType()),
])

CATEGORY_REGISTRY = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("short", T.StringType()),
])

STORE_GROUPS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("group", T.StringType()),
])

MONTH_LABELS = T.StructType([
    T.StructField("period", T.StringType()),
    T.StructField("label", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the columns of `schema`, in its order and types.

    Date columns may arrive as date or timestamp and stay as they are, so that a range
    filter on them still reaches the scan.
    """
    return df.select(*[
        F.col(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name).cast(f.dataType)
        for f in schema
    ])


def as_doubles(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double, for reports and for clients without decimals."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema
    ])
