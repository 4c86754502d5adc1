"""Text forms of amounts, percentages and changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopgauge.config import TREND_ARROWS, TREND_LIMIT


def fixed(col: Column, digits: int) -> Column:
    """Fixed decimals without thousands separators, halves rounded to even."""
    return F.replace(F.format_number(col.cast("double"), digits), F.lit(","), F.lit(""))


def fmt_eur(col: Column) -> Column:
    """`x.x Mio €` from a million, `x Tsd €` from a thousand, else whole euros with commas."""
    value = col.cast("double")
    return (
        F.when(value >= 1_000_000, F.concat(fixed(value / 1_000_000, 1), F.lit(" Mio €")))
        .when(value >= 1_000, F.concat(fixed(value / 1_000, 0), F.lit(" Tsd €")))
        .otherwise(F.concat(F.format_number(value, 0), F.lit(" €")))
    )


def fmt_pct(col: Column) -> Column:
    return F.concat(fixed(col, 1), F.lit("%"))


def signed_pct(col: Column) -> Column:
    """Percent text with a leading plus for gains; zero and missing give no label."""
    return F.when(col > 0, F.concat(F.lit("+"), fmt_pct(col))).when(col < 0, fmt_pct(col))


def change_class(col: Column) -> Column:
    return F.when(col > 0, F.lit("positive")).when(col < 0, F.lit("negative")).when(col == 0, F.lit("neutral"))


def trend_band(col: Column, limit: float = TREND_LIMIT) -> Column:
    return F.when(col > limit, F.lit("up")).when(col < -limit, F.lit("down")).otherwise(F.lit("flat"))


def trend_arrow(col: Column, limit: float = TREND_LIMIT) -> Column:
    band = trend_band(col, limit)
    return (
        F.when(band == "up", F.lit(TREND_ARROWS["up"]))
        .when(band == "down", F.lit(TREND_ARROWS["down"]))
        .otherwise(F.lit(TREND_ARROWS["flat"]))
    )
