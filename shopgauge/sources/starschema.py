"""Present a sales/orders star schema as the four source tables.

A nation plays the store and a region the store group. `part` and `supplier` grow with the
facts, so no join carries a broadcast hint: a side is broadcast only when its size is below
`spark.sql.autoBroadcastJoinThreshold`, and otherwise both sides are shuffled on the key,
where adaptive execution splits hot keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge import schemas
from shopgauge.config import COMMISSION, MARKETING, PROCUREMENT, RENT, SALARY, SOCIAL, CategoryRules
from shopgauge.functions.expressions import CATEGORY, classified

RULES = CategoryRules(
    classes=(
        ("Gadgets", ("%widget%", "%gizmo%")),
        ("Small Parts", ("%small%",)),
        ("Rods and Rings", ("%rod%", "%ring%")),
        ("Hot Parts", ("%hot%",)),
        ("Plates", ("%plate%", "%anvil%")),
    ),
    fallback="Fasteners",
)

CATEGORIES = (
    ("Gadgets", "GADG"),
    ("Small Parts", "SMAL"),
    ("Rods and Rings", "RODS"),
    ("Hot Parts", "HOTP"),
    ("Plates", "PLAT"),
    ("Fasteners", "FAST"),
)


TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, with its schema given: inferring it would read file footers in a job of its own."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def amount(value: Column) -> Column:
    """A double as an amount rounded to four places, ties away from zero.

    Going through a whole number of ten-thousandths is exact and much cheaper per row than
    the cast from double to decimal, which goes through text.
    """
    units = F.when(value < 0, F.ceil(value * 10_000 - 0.5)).otherwise(F.floor(value * 10_000 + 0.5)).cast("decimal(19,0)")
    return (units * F.lit("0.0001").cast("decimal(4,4)")).cast(schemas.MONEY)


def sales(spark: SparkSession, sf_dir: str, rules: CategoryRules | None = None) -> DataFrame:
    """Sales lines; with `rules` also their category, formed once per part instead of once per line."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_retailprice", amount(F.col("p_retailprice")).alias("SalesPriceEUR")
    )
    if rules:
        parts = classified(parts, "p_name", rules, CATEGORY)
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_shipdate").alias("ID_CALMONTH"),
            F.col("s_nationkey").alias("ID_STORE"),
            F.col("l_partkey").alias("ID_MATERIAL"),
            F.col("p_name").alias("ProduktBeschreibung"),
            amount(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("RevenueEUR"),
            amount(F.col("p_retailprice") * F.col("l_quantity")).alias("TransferPriceEUR"),
            "SalesPriceEUR",
            F.col("l_quantity").cast("int").alias("SalesAmount"),
            *([CATEGORY] if rules else []),
        )
    )


def cost_category(priority, status):
    return (
        F.when(priority == "1-URGENT", SALARY)
        .when(priority == "2-HIGH", SOCIAL)
        .when(priority == "3-MEDIUM", RENT)
        .when((priority == "4-NOT SPECIFIED") & (status == "F"), MARKETING)
        .when((priority == "4-NOT SPECIFIED") & (status == "O"), PROCUREMENT)
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit(f"{PROCUREMENT} for "), status))
        .when((priority == "5-LOW") & (status == "P"), "Insurance")
        .otherwise(COMMISSION)
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").alias("ID_CALMONTH"),
            F.col("c_nationkey").alias("ID_STORE"),
            F.col("n_name").alias("StoreName"),
            cost_category(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("Kostenkategorie"),
            amount(F.col("o_totalprice") * 0.2).alias("WertEUR"),
        )
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("SALESORG_ID"), F.col("n_name").alias("STORE_LOCATION")
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("n_nationkey") != 24, F.col("n_nationkey") % 7 * 100)  # one store's area is missing
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ID_STORE"),
        known.cast(schemas.AREA).alias("LOC_SIZE_M2"),
        (F.col("n_regionkey") + 10).cast(schemas.AREA).alias("LOC_RENT_EUR_M2"),
        F.lit("2.50").cast(schemas.AREA).alias("LOC_NEBENKOSTEN_EUR"),
    )


def store_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ord"),
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("short"),
    )


def store_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("r_name").alias("group")
    )


class StarSchema:
    """The sources of a comparison, read from the tables in a folder when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._args = (spark, sf_dir)

    @cached_property
    def sales(self) -> DataFrame:
        return sales(*self._args)

    def classified_sales(self, rules: CategoryRules) -> DataFrame:
        return sales(*self._args, rules)

    @cached_property
    def costs(self) -> DataFrame:
        return costs(*self._args)

    @cached_property
    def stores(self) -> DataFrame:
        return stores(*self._args)

    @cached_property
    def locations(self) -> DataFrame:
        return locations(*self._args)

    @cached_property
    def registry(self) -> DataFrame:
        return store_registry(*self._args)

    @cached_property
    def groups(self) -> DataFrame:
        return store_groups(*self._args)
