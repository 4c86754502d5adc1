"""Reports on the export view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.functions.expressions import mean


def profitability_report(export: DataFrame) -> DataFrame:
    """Which store or group is more profitable: latest month first, then by name."""
    columns = ["Monat", "Filialgruppe", "UmsatzEur", "NettogewinnEur", "NettogewinnMargeProzent"]
    return export.select(columns).orderBy(F.col("Monat").desc(), "Filialgruppe")


def trend_report(export: DataFrame) -> DataFrame:
    """Revenue and net profit over time."""
    return export.select("Monat", "Filialgruppe", "UmsatzEur", "NettogewinnEur").orderBy("Monat", "Filialgruppe")


def avg_ratios(export: DataFrame) -> DataFrame:
    """Mean personnel share and mean operating ratio of each store or group."""
    return export.groupBy("Filialgruppe").agg(
        mean(F.col("PersonalkostenAnteilProzent")).alias("DurchschnittPersonalkostenAnteil"),
        mean(F.col("BetriebskostenQuoteProzent")).alias("DurchschnittBetriebskostenQuote"),
    )
