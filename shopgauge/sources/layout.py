"""Facts laid out for repeated use: tables bucketed by month and store, so that sums per month and store need no exchange.

For facts that many figures are computed from anew. A figure computed once, or from stored monthly sums, gains nothing:
its only exchange carries partial sums.
"""

from __future__ import annotations

import math
from functools import cached_property
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgauge.operators.costs import by_month_store

KEYS = ("MonthStart", "IdStore")
#: Rows that one bucket should hold, and Spark's own limit on their number.
ROWS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 100_000
#: Rows that one task should sort and write, and the number of tasks beyond which each gets more.
ROWS_PER_TASK = 1_000_000
MOST_TASKS = 100_000


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, least: int = 8) -> int:
    """A number of buckets that grows with the facts: each is read by one task."""
    return min(MOST_BUCKETS, max(least, math.ceil(rows / rows_per_bucket)))


class LaidOut:
    """The sources of a comparison with facts from bucketed tables; the small tables stay as they are.

    A month of a store lies in one bucket. Lines keep the category that the rules gave them when
    they were laid out. The tables are external: dropping them leaves the files.
    """

    def __init__(self, sources, prefix: str):
        self.stores, self.locations, self.registry = sources.stores, sources.locations, sources.registry
        self._spark: SparkSession = sources.stores.sparkSession
        self._prefix = prefix

    @cached_property
    def lines(self) -> DataFrame:
        return self._spark.table(f"{self._prefix}sales_lines")

    @cached_property
    def sales(self) -> DataFrame:
        """The lines under the names of the source; their dates are month starts."""
        return self.lines.selectExpr(
            "MonthStart AS ID_CALMONTH", "IdStore AS ID_STORE", "IdMaterial AS ID_MATERIAL", "MaterialDescription AS ProduktBeschreibung", "BenchmarkCategory",
            "RevenueEur AS RevenueEUR", "TransferCostEur AS TransferPriceEUR", "SalesPriceEur AS SalesPriceEUR", "Quantity AS SalesAmount",
        )

    @cached_property
    def costs(self) -> DataFrame:
        return self._spark.table(f"{self._prefix}cost_rows")

    def drop(self) -> None:
        """Take the tables out of the catalog."""
        for name in ("sales_lines", "cost_rows"):
            self._spark.sql(f"DROP TABLE IF EXISTS {self._prefix}{name}")


def dealt(frame: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """The rows of each bucket in as many tasks as their number asks for; no task has two buckets.

    `rows` has the number of rows for each month and store. A hash of the whole row deals a
    bucket to its tasks, so a month of a store can be in several, and a lost task is made again
    with the same rows; only equal rows stay together. The driver gets a number for each bucket.
    """
    bucket = F.pmod(F.hash(*KEYS), F.lit(count))  # as bucketBy has it
    found = {r["bucket"]: r["n"] for r in rows.groupBy(bucket.alias("bucket")).agg(F.sum("count").alias("n")).collect()}
    most = max(ROWS_PER_TASK, math.ceil(sum(found.values()) / MOST_TASKS))
    first = [0, *accumulate(max(1, math.ceil(found.get(b, 0) / most)) for b in range(count))]
    firsts = F.split(F.lit(",".join(map(str, first))), ",").cast("array<int>")
    begin, end = F.get(firsts, bucket), F.get(firsts, bucket + 1)
    return frame.repartitionById(first[-1], (begin + F.pmod(F.xxhash64(*frame.columns), end - begin)).cast("int"))


def lay_out(bench, folder: str, prefix: str, buckets: int | None = None) -> LaidOut:
    """Write the lines and costs of a benchmark as bucketed tables `{prefix}sales_lines` and `{prefix}cost_rows` in a shared folder.

    Without `buckets` their number follows from the row counts, for both tables the same, so
    that joins by month and store need no exchange either. A hot store is spread over its
    months; a month of a store is the finest unit that one task reads. Writing sorts the rows,
    so a bucket is written by several tasks, a file each, of some `ROWS_PER_TASK` rows.
    """
    frames = {"sales_lines": bench.lines, "cost_rows": by_month_store(bench.sources.costs, bench.preset.store_ids)}
    rows = {name: frame.groupBy(*KEYS).count().persist() for name, frame in frames.items()}
    count = buckets or buckets_for(max(n.agg(F.sum("count")).first()[0] or 0 for n in rows.values()))
    for name, frame in frames.items():
        writer = dealt(frame, rows[name], count).write.mode("overwrite").option("path", f"{folder.rstrip('/')}/{name}")
        writer.bucketBy(count, *KEYS).sortBy(*KEYS).saveAsTable(f"{prefix}{name}")
        rows[name].unpersist()
    return LaidOut(bench.sources, prefix)
