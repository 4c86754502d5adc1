"""Small tables that configure a comparison: category rules, cost buckets, registries, labels.

Everything here is plain driver-side data of fixed size; no value depends on the facts.
"""

from __future__ import annotations

from dataclasses import dataclass

ALL_PERIODS = "all"


@dataclass(frozen=True)
class CategoryRules:
    """Ordered LIKE rules, first hit wins; `classes` is ((category, (pattern, ...)), ...)."""

    classes: tuple[tuple[str, tuple[str, ...]], ...]
    fallback: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class CostBucket:
    """Cost categories that count into one output column, by equality or by prefix."""

    equals: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class CostBuckets:
    personnel: CostBucket
    operating: CostBucket
    procurement: CostBucket
    case_sensitive: bool = False


@dataclass(frozen=True)
class Preset:
    """One generation of the view stack."""

    rules: CategoryRules
    buckets: CostBuckets
    store_ids: tuple[int, ...] | None = None


# ---- Fixed values: product category rules -------------------------------------------------

RULES_V1 = CategoryRules(
    classes=(
        ("E-Bike", ("%E-Bike%", "%E-Trekking%")),
        ("MTB", ("%MTB%", "%Mountain%")),
        ("City/Trekking", ("%City%", "%Trekking%")),
        ("Kinder", ("%Kid%", "%Kinder%")),
    ),
    fallback="Sonstige",
)

RULES_V2 = CategoryRules(
    classes=(
        ("E-Trekking", ("%Grace%", "%JMS e-Bike%", "%S-Pedelec%", "%Pedelec%")),
        ("Kid Bikes", ("%Puky%", "%Cubie%", "%Mini Racer%", "%Leo%")),
        ("Mountain Bikes", ("%Copperhead%", "%Aim Disc%", "%Reaction%", "%Genius%")),
        ("Race Bikes", ("%Diesel%", "%Night Falcon%", "%Vulture%", "%Cervelo%")),
        ("Trekking Bikes", ("%Rixe%", "%Avenza%", "%KATHMANDU%", "%Trekking%")),
        ("City Bikes", ("%Corona%", "%PEGASUS%", "%Town Lite%", "%Travel City%")),
    ),
    fallback="City Bikes",
)

# ---- Fixed values: cost categories and buckets --------------------------------------------

SALARY = "Monthly Salary"
SOCIAL = "Monthly Social Costs"
COMMISSION = "Commission"
RENT = "Monthly Rent"
MARKETING = "Marketing Campaign"
PROCUREMENT = "Additional Procurement Costs"

BUCKETS_V1 = CostBuckets(
    personnel=CostBucket(equals=(SALARY, SOCIAL)),
    operating=CostBucket(equals=(RENT, MARKETING, COMMISSION)),
    procurement=CostBucket(equals=(PROCUREMENT,)),
)

BUCKETS_V2 = CostBuckets(
    personnel=CostBucket(equals=(SALARY, SOCIAL, COMMISSION)),
    operating=CostBucket(equals=(RENT, MARKETING)),
    procurement=CostBucket(prefixes=(PROCUREMENT,)),
)

# ---- Fixed values: stores, categories, groups, month labels -------------------------------

STORES = (
    (14, "Rosenheim", "ROS"),
    (5, "Freiburg im Breisgau", "FRE"),
    (3, "Karlsruhe", "KAR"),
)

CATEGORIES = (
    ("City Bikes", "CITY"),
    ("E-Trekking", "ETRK"),
    ("Kid Bikes", "KIDS"),
    ("Mountain Bikes", "MTB"),
    ("Race Bikes", "RACE"),
    ("Trekking Bikes", "TREK"),
)

STORE_IDS = (3, 5, 14)
SINGLE_STORE = (14, "Rosenheim")
MEMBER_STORES = ((3, 5), "Freiburg/Karlsruhe")
STORE_GROUPS = ((14, "Rosenheim"), (5, "Freiburg/Karlsruhe"), (3, "Freiburg/Karlsruhe"))

MONTH_LABELS = (
    (ALL_PERIODS, "Gesamtjahr 2024"),
    ("2024-01", "Januar 2024"),
    ("2024-02", "Februar 2024"),
    ("2024-03", "März 2024"),
    ("2024-04", "April 2024"),
    ("2024-05", "Mai 2024"),
    ("2024-06", "Juni 2024"),
    ("2024-07", "Juli 2024"),
    ("2024-08", "August 2024"),
    ("2024-09", "September 2024"),
    ("2024-10", "Oktober 2024"),
    ("2024-11", "November 2024"),
    ("2024-12", "Dezember 2024"),
)

# ---- Fixed values: thresholds, labels and message texts -----------------------------------

SCORE_BANDS = ((110.0, "Überdurchschnittlich"), (90.0, "Durchschnittlich"))
SCORE_LOWEST = "Unterdurchschnittlich"
EFFICIENCY_BANDS = ((15.0, "Sehr effizient"), (20.0, "Durchschnittlich"))
EFFICIENCY_WORST = "Optimierbar"
MEDALS = ("🥇", "🥈", "🥉")
TREND_ARROWS = {"up": "↗️", "down": "↘️", "flat": "➡️"}
TREND_LIMIT = 3.0
RADAR_MARGIN_FACTOR = 3
DEFAULT_AREA = 1

TEXT_MARGIN_AND_PROFIT = "%s führt bei Marge UND Gewinn"
TEXT_TOP_PROFIT = "%s hat den höchsten Gewinn"
TEXT_TOP_MARGIN = "%s hat die beste Marge"
TEXT_TOP_REVENUE = "%s hat den höchsten Umsatz, aber nicht den höchsten Gewinn"
TEXT_REVENUE_LEADER = "%s liegt %s%% über dem Durchschnitt"
TEXT_MARGIN_LEADER = "%s mit %s%% Nettomarge"
TEXT_RECOMMENDATION = "Best Practices aus %s auf andere Filialen übertragen"

PRESET_V1 = Preset(RULES_V1, BUCKETS_V1, STORE_IDS)
PRESET_V2 = Preset(RULES_V2, BUCKETS_V2, STORE_IDS)
