"""Store areas and rents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.config import DEFAULT_AREA
from shopgauge.operators.containment import contained
from shopgauge.operators.sales import where_stores


def monthly_rent(locations: DataFrame, stores: DataFrame, store_ids=None) -> DataFrame:
    """Rent per m² with side costs, and the monthly rent of each store."""
    master = stores.select(F.col("SALESORG_ID").alias("ID_STORE"), F.col("STORE_LOCATION").alias("StoreName"))
    per_m2 = F.col("LOC_RENT_EUR_M2") + F.col("LOC_NEBENKOSTEN_EUR")
    return where_stores(locations, store_ids).join(master, "ID_STORE").select(
        "ID_STORE",
        "StoreName",
        "LOC_SIZE_M2",
        "LOC_RENT_EUR_M2",
        "LOC_NEBENKOSTEN_EUR",
        per_m2.alias("TotalPerM2"),
        (F.col("LOC_SIZE_M2") * per_m2).alias("MonthlyRentCalculated"),
    )


def with_size(kpis: DataFrame, locations: DataFrame, default: int = DEFAULT_AREA) -> DataFrame:
    """Add the area of each store as `size_m2`; a store without a known area counts as 1 m².

    Of several rows of a store the last one counts, in the order of area, rent and side costs.
    """
    order = F.struct("LOC_SIZE_M2", "LOC_RENT_EUR_M2", "LOC_NEBENKOSTEN_EUR")
    areas = locations.groupBy(F.col("ID_STORE").alias("store_id")).agg(F.max(order)["LOC_SIZE_M2"].alias("size_m2"))
    return kpis.join(areas, "store_id", "left").withColumn("size_m2", F.coalesce("size_m2", F.lit(default)))


def areas_by_name(locations: DataFrame, registry: DataFrame, order: list[str], name: str = "StoreName") -> DataFrame:
    """The area of each registered store (`id`, `size_m2`) whose name occurs in the name of an area row, in any case.

    A row whose name holds several registered names counts for each of them. Of several rows of
    a store the last one in `order` counts, even if its area is unknown; rows that agree in
    `order` count by area. Registered stores with the same name get the same area.
    """
    rows = locations.select(F.lower(name).alias("text"), F.struct(*order, "LOC_SIZE_M2").alias("row"))
    stores = registry.select("id", F.lower("name").alias("part"))
    pairs = contained(rows, "text", stores, "part")
    last = rows.join(pairs, "text").groupBy("part").agg(F.max("row")["LOC_SIZE_M2"].alias("size_m2"))
    return stores.join(last, "part").select("id", "size_m2")


def with_size_by_name(
    kpis: DataFrame, locations: DataFrame, registry: DataFrame, order: list[str], name: str = "StoreName", default: int = DEFAULT_AREA
) -> DataFrame:
    """`with_size` where area rows name their store instead of giving its id: the name contains the registered one.

    The registry is matched once, not the rows of `kpis`, so the facts behind them are read once.
    """
    areas = areas_by_name(locations, registry, order, name).withColumnRenamed("id", "store_id")
    return kpis.join(areas, "store_id", "left").withColumn("size_m2", F.coalesce("size_m2", F.lit(default)))
