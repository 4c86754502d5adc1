"""Monthly sums in a shared folder, refreshed behind a manifest.

A refresh sums up the facts once, compares each month with what the manifest says about it, writes the months that
differ into a folder of their own, and then a new manifest: one file, whose appearance switches all tables at once.
Nothing is overwritten, so readers of the old state go on undisturbed, and a refresh that dies half way leaves the
old state in force. Months that no longer have rows are left out of the new manifest.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgauge.config import ALL_PERIODS
from shopgauge.functions.expressions import month_key

#: One row per table and month: where its rows are, how many, and their fingerprint.
MANIFEST = "name string, month string, fingerprint string, row_count long, batch string"
#: The month of rows without a date.
NO_MONTH = "none"


def fingerprint(columns: list[str]) -> Column:
    """A number of a group of rows that depends on every value of every row, but not on their order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


class MonthlySums:
    """The tables of sums in a folder; each has a column MonthStart. One refresh at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """The rows of the newest manifest; none before the first refresh."""
        every = self._manifests()
        if every is None:
            return self.spark.createDataFrame([], MANIFEST)
        return every.where((F.col("version") == self.version()) & F.col("name").isNotNull()).drop("version")

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first refresh."""
        every = self._manifests()
        return 0 if every is None else every.agg(F.max("version")).first()[0] or 0

    def _manifests(self) -> DataFrame | None:
        schema = T.StructType.fromDDL(MANIFEST).add("version", T.IntegerType())
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def refresh(self, tables: dict[str, DataFrame], period: str = ALL_PERIODS) -> dict[str, dict[str, list[str]]]:
        """Bring the folder up to date with the given tables; returns per table the months `written` and `removed`.

        With a period the tables hold that month only, and other months stay as they are. Every
        table is computed once; it is kept while its months are compared, and computed again
        only where an executor is lost meanwhile.
        """
        known = {(r["name"], r["month"]): r for r in self.manifest().collect()}  # a row per table and month
        batch, rows, changes = uuid.uuid4().hex, [], {}
        for name, table in tables.items():
            columns = table.columns
            sums = table.withColumn("Month", F.coalesce(month_key(F.col("MonthStart")), F.lit(NO_MONTH))).persist()
            try:
                found = sums.groupBy("Month").agg(fingerprint(columns).alias("fingerprint"), F.count("*").alias("n")).collect()
                old = {month: r for (of, month), r in known.items() if of == name}
                now = {r["Month"]: (name, r["Month"], r["fingerprint"], r["n"], batch) for r in found}
                kept = {m: tuple(r) for m, r in old.items() if m in now and (r["fingerprint"], r["row_count"]) == now[m][2:4]}
                written = sorted(now.keys() - kept.keys())
                if written:
                    changed = sums.where(F.col("Month").isin(written)).repartition("Month")
                    changed.write.partitionBy("Month").parquet(f"{self.folder}/{name}/Batch={batch}")
            finally:
                sums.unpersist()
            outside = {m: tuple(r) for m, r in old.items() if period not in (ALL_PERIODS, m)}
            rows += (outside | now | kept).values()
            changes[name] = {"written": written, "removed": sorted(old.keys() - now.keys() - outside.keys())}
        rows += [tuple(r) for (name, _), r in known.items() if name not in tables]
        if self.version() == 0 or any(c["written"] or c["removed"] for c in changes.values()):
            self._switch(rows)
        return changes

    def _switch(self, rows: list[tuple]) -> None:
        # a row without a table shows a version that has none; one file appears at once
        manifest = self.spark.createDataFrame([*rows, (None,) * 5], MANIFEST).coalesce(1)
        manifest.write.mode("append").parquet(f"{self.folder}/manifest/version={self.version() + 1}")

    def table(self, name: str, schema: T.StructType, period: str = ALL_PERIODS) -> DataFrame:
        """The rows of a table, or of one month of it; only folders that the manifest names are listed."""
        live = self.manifest().where(F.col("name") == name)
        live = live.where(F.col("month") == period) if period != ALL_PERIODS else live
        months: dict[str, list[str]] = {}
        for row in live.collect():
            months.setdefault(row["batch"], []).append(row["month"])
        if not months:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.folder}/{name}/Batch={batch}" for batch in sorted(months)]
        shape = T.StructType(list(schema.fields)).add("Batch", "string").add("Month", "string")
        rows = self.spark.read.schema(shape).option("basePath", f"{self.folder}/{name}").parquet(*folders)
        current = F.lit(False)
        for batch, of in sorted(months.items()):
            current = current | ((F.col("Batch") == batch) & F.col("Month").isin(sorted(of)))
        return rows.where(current).drop("Batch", "Month")
