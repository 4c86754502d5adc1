"""The layers as SQL text, made from the rule and bucket tables of a preset, and as lasting views of a catalog.

A temporary view holds a plan of its session; a lasting one holds text, which any session and any SQL client can read
later. The text takes the same way through the data as the DataFrames: facts are summed up before they are joined, and
each fact table is read once per view.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from shopgauge.config import MEMBER_STORES, PRESET_V1, PRESET_V2, SINGLE_STORE, CategoryRules, CostBucket, Preset
from shopgauge.operators.costs import BUCKET_COLUMNS, POSITIONS
from shopgauge.plans.catalog import GENERATIONS, PREFIX

MONTH = "date_format({}, 'yyyy-MM')"


@dataclass(frozen=True)
class SourceNames:
    """Catalog names of the source tables or views."""

    sales: str
    costs: str
    salesorg: str


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(view: str) -> str:
    """A catalog name, each part of it quoted."""
    return ".".join(f"`{part}`" for part in view.split("."))


def category_case(column: str, rules: CategoryRules) -> str:
    """CASE over the ordered rules: the first class with a matching pattern, else the fallback."""
    fold = str if rules.case_sensitive else str.lower
    tested = column if rules.case_sensitive else f"lower({column})"
    arms = [f"WHEN {' OR '.join(f'{tested} LIKE {text(fold(p))}' for p in patterns)} THEN {text(label)}" for label, patterns in rules.classes]
    return f"CASE {' '.join(arms)} ELSE {text(rules.fallback)} END" if arms else text(rules.fallback)


def in_bucket(column: str, bucket: CostBucket, case_sensitive: bool) -> str:
    fold = str if case_sensitive else str.lower
    tested = column if case_sensitive else f"lower({column})"
    hits = [f"startswith({tested}, {text(fold(p))})" for p in bucket.prefixes]
    if bucket.equals:
        hits.append(f"{tested} IN ({', '.join(text(fold(e)) for e in bucket.equals)})")
    return f"coalesce({' OR '.join(hits)}, false)"


def _pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100 END"


def _ratios(revenue: str, profit: str, operating: str, personnel: str, costs: str, net: str) -> str:
    return ", ".join((
        f"{_pct(profit, revenue)} AS GrossProfitMarginPct", f"{_pct(operating, revenue)} AS OperatingCostRatioPct",
        f"{_pct(personnel, costs)} AS PersonnelCostRatioPct", f"{_pct(net, revenue)} AS NetProfitMarginPct",
    ))


RATIOS = _ratios("TotalRevenueEur", "TotalGrossProfitEur", "OperatingCostsEur", "PersonnelCostsEur", "TotalCostsEur", "NetProfitEur")
AMOUNTS = ("TotalRevenueEur", "TotalGrossProfitEur", "TotalCostsEur", "PersonnelCostsEur", "OperatingCostsEur", "NetProfitEur")
PERCENTS = ", ".join(f"CAST({a} AS DECIMAL(38,2)) AS {b}" for a, b in (
    ("GrossProfitMarginPct", "BruttogewinnMargeProzent"), ("OperatingCostRatioPct", "BetriebskostenQuoteProzent"),
    ("PersonnelCostRatioPct", "PersonalkostenAnteilProzent"), ("NetProfitMarginPct", "NettogewinnMargeProzent"),
))


class ViewTexts:
    """The statements of a generation over named sources."""

    def __init__(self, names: SourceNames, preset: Preset, prefix: str):
        self.names, self.preset, self.prefix = names, preset, prefix
        ids = preset.store_ids
        self.where = "" if ids is None else f"WHERE ID_STORE IN ({', '.join(map(str, ids))})"
        self.category = category_case("ProduktBeschreibung", preset.rules)

    def sales_std(self) -> str:
        return f"""
            SELECT {MONTH.format("ID_CALMONTH")} AS IdCalmonthStd, ID_STORE AS IdStore, STORE_LOCATION AS StoreName,
                   ID_MATERIAL AS IdMaterial, ProduktBeschreibung AS MaterialDescription, {self.category} AS BenchmarkCategory,
                   RevenueEUR AS RevenueEur, RevenueEUR - TransferPriceEUR AS GrossProfitEur, TransferPriceEUR AS TransferCostEur,
                   SalesPriceEUR AS SalesPriceEur, SalesAmount AS Quantity
            FROM {name(self.names.sales)} JOIN {name(self.names.salesorg)} ON ID_STORE = SALESORG_ID {self.where}"""

    def sales_agg(self) -> str:
        return f"""
            SELECT {MONTH.format("MonthStart")} AS IdCalmonthStd, IdStore, STORE_LOCATION AS StoreName, BenchmarkCategory,
                   TotalRevenueEur, TotalGrossProfitEur, TotalTransferCostEur, AvgSalesPriceEur, TotalQuantity
            FROM (SELECT trunc(ID_CALMONTH, 'MM') AS MonthStart, ID_STORE AS IdStore, {self.category} AS BenchmarkCategory,
                         sum(RevenueEUR) AS TotalRevenueEur, sum(RevenueEUR - TransferPriceEUR) AS TotalGrossProfitEur,
                         sum(TransferPriceEUR) AS TotalTransferCostEur,
                         CAST(round(sum(SalesPriceEUR) / nullif(count(SalesPriceEUR), 0), 4) AS DECIMAL(19,4)) AS AvgSalesPriceEur,
                         sum(SalesAmount) AS TotalQuantity
                  FROM {name(self.names.sales)} {self.where} GROUP BY 1, 2, 3)
            JOIN {name(self.names.salesorg)} ON IdStore = SALESORG_ID"""

    def _spent(self) -> str:
        """Costs per month, store and spelling, with the single positions beside the buckets."""
        buckets = (self.preset.buckets.personnel, self.preset.buckets.operating, self.preset.buckets.procurement)
        exact = self.preset.buckets.case_sensitive
        sums = [f"sum(CASE WHEN {in_bucket('Kostenkategorie', b, exact)} THEN WertEUR ELSE 0 END) AS {c}" for b, c in zip(buckets, BUCKET_COLUMNS, strict=True)]
        single = [f"sum(CASE WHEN {in_bucket('Kostenkategorie', CostBucket(equals=(wanted,)), exact)} THEN WertEUR END) AS {c}" for c, wanted in POSITIONS.items()]
        return f"""
            SELECT trunc(ID_CALMONTH, 'MM') AS MonthStart, ID_STORE AS IdStore, StoreName, sum(WertEUR) AS TotalCostsEur, {', '.join(sums + single)}
            FROM {name(self.names.costs)} {self.where} GROUP BY 1, 2, 3"""

    def costs_agg(self) -> str:
        return f"SELECT {MONTH.format('MonthStart')} AS IdCalmonthStd, IdStore, StoreName, TotalCostsEur, {', '.join(BUCKET_COLUMNS)} FROM ({self._spent()})"

    def costs_detail(self) -> str:
        return f"""
            SELECT {MONTH.format("MonthStart")} AS IdCalmonthStd, IdStore, StoreName, Kostenkategorie, KostenEur
            FROM (SELECT trunc(ID_CALMONTH, 'MM') AS MonthStart, ID_STORE AS IdStore, StoreName, Kostenkategorie, sum(WertEUR) AS KostenEur
                  FROM {name(self.names.costs)} {self.where} GROUP BY 1, 2, 3, 4)"""

    def _figures(self, *columns: str, each_spelling: bool = False) -> str:
        """A row per month, store and distinct set of cost sums; with `each_spelling` also per spelling, for its other columns."""
        spelling = "LATERAL VIEW explode(spellings) AS spelling" if each_spelling else ""
        wide = "".join(f", spelling.{c} AS {c}" for c in BUCKET_COLUMNS[2:]) if each_spelling else ""
        return f"""
            WITH sold AS (
              SELECT MonthStart, IdStore, STORE_LOCATION AS StoreName, revenue, profit
              FROM (SELECT trunc(ID_CALMONTH, 'MM') AS MonthStart, ID_STORE AS IdStore, sum(RevenueEUR) AS revenue, sum(RevenueEUR - TransferPriceEUR) AS profit
                    FROM {name(self.names.sales)} {self.where} GROUP BY 1, 2)
              JOIN {name(self.names.salesorg)} ON IdStore = SALESORG_ID
            ), spent AS ({self._spent()}
            ), gathered AS (
              SELECT MonthStart, IdStore, collect_list(struct(TotalCostsEur, {', '.join(BUCKET_COLUMNS)})) AS spellings,
                     {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in POSITIONS)}
              FROM spent GROUP BY MonthStart, IdStore
            ), sets AS (
              SELECT sold.*, spellings, {', '.join(POSITIONS)},
                     transform(spellings, s -> struct(s.TotalCostsEur, s.PersonnelCostsEur, s.OperatingCostsEur)) AS every
              FROM sold JOIN gathered USING (MonthStart, IdStore)
            ), counted AS (
              SELECT *, size(filter(every, s -> s <=> part)) AS times FROM sets LATERAL VIEW explode(array_distinct(every)) AS part
            ), figures AS (
              SELECT MonthStart, IdStore, StoreName, CAST(revenue * times AS DECIMAL(38,4)) AS TotalRevenueEur,
                     CAST(profit * times AS DECIMAL(38,4)) AS TotalGrossProfitEur, part.TotalCostsEur, part.PersonnelCostsEur, part.OperatingCostsEur,
                     CAST(profit * times AS DECIMAL(38,4)) - part.TotalCostsEur AS NetProfitEur, {', '.join(POSITIONS)}{wide}
              FROM counted {spelling}
            ), rated AS (SELECT *, {RATIOS} FROM figures)
            SELECT {', '.join(columns)} FROM rated"""

    def kpi(self) -> str:
        ratios = ("GrossProfitMarginPct", "OperatingCostRatioPct", "PersonnelCostRatioPct", "NetProfitMarginPct")
        return self._figures(f"{MONTH.format('MonthStart')} AS IdCalmonthStd", "IdStore", "StoreName", *AMOUNTS, *ratios)

    def export_v2(self) -> str:
        goods = "TotalRevenueEur - TotalGrossProfitEur"
        return self._figures(
            f"{MONTH.format('MonthStart')} AS Monat", "StoreName AS Filialgruppe", "IdStore", "round(TotalRevenueEur, 2) AS UmsatzEur",
            "round(TotalGrossProfitEur, 2) AS BruttogewinnEur", f"round({goods}, 2) AS WareneinsatzEur",
            f"round({goods} + OperatingCostsEur + PersonnelCostsEur + AdditionalProcurementCostsEur, 2) AS GesamtkostenEur",
            "round(PersonnelCostsEur, 2) AS PersonalkostenEur", "round(OperatingCostsEur, 2) AS BetriebskostenEur",
            "round(AdditionalProcurementCostsEur, 2) AS BeschaffungskostenEur", "round(NetProfitEur, 2) AS NettogewinnEur", PERCENTS,
            each_spelling=True,
        )

    def waterfall(self) -> str:
        return self._figures(
            f"{MONTH.format('MonthStart')} AS IdCalmonthStd", "IdStore", "StoreName", "TotalRevenueEur AS UmsatzEur",
            "TotalRevenueEur - TotalGrossProfitEur AS WareneinsatzEur", "TotalGrossProfitEur AS BruttogewinnEur",
            "PersonnelCostsEur AS PersonalkostenEur", *POSITIONS, "AdditionalProcurementCostsEur AS BeschaffungskostenEur",
            "NetProfitEur AS NettogewinnEur", each_spelling=True,
        )

    def store_comparison(self, single=SINGLE_STORE, members=MEMBER_STORES) -> str:
        (store, label), (ids, combined) = single, members
        groups = f"array(CASE WHEN IdStore = {store} THEN {text(label)} END, CASE WHEN IdStore IN ({', '.join(map(str, ids))}) THEN {text(combined)} END)"
        return f"""
            SELECT IdCalmonthStd, StoreGroup, {', '.join(AMOUNTS)}, {RATIOS}
            FROM (SELECT IdCalmonthStd, StoreGroup, {', '.join(f'sum({c}) AS {c}' for c in AMOUNTS)}
                  FROM (SELECT IdCalmonthStd, StoreGroup, {', '.join(AMOUNTS)},
                               CASE WHEN StoreGroup = {text(label)} THEN struct(StoreName, TotalCostsEur, PersonnelCostsEur, OperatingCostsEur) END AS own
                        FROM {name(self.prefix + 'kpi')} LATERAL VIEW explode(array_compact({groups})) AS StoreGroup)
                  GROUP BY IdCalmonthStd, StoreGroup, own)"""

    def export_v1(self) -> str:
        report = {"UmsatzEur": "TotalRevenueEur", "BruttogewinnEur": "TotalGrossProfitEur", "GesamtkostenEur": "TotalCostsEur",
                  "PersonalkostenEur": "PersonnelCostsEur", "BetriebskostenEur": "OperatingCostsEur", "NettogewinnEur": "NetProfitEur"}
        return f"""
            SELECT IdCalmonthStd AS Monat, StoreGroup AS Filialgruppe, {', '.join(f'round({c}, 2) AS {a}' for a, c in report.items())}, {PERCENTS}
            FROM {name(self.prefix + 'store_comparison')}"""


def view_texts(names: SourceNames, generation: str = "v2", preset: Preset | None = None, prefix: str = PREFIX) -> dict[str, str]:
    """The SELECT of each view of a generation by its short name, in an order in which they can be created."""
    if generation not in GENERATIONS:
        raise ValueError(f"generation must be one of {GENERATIONS}, not {generation!r}")
    texts = ViewTexts(names, preset or (PRESET_V1 if generation == "v1" else PRESET_V2), prefix)
    found = {"sales_std": texts.sales_std(), "sales_agg": texts.sales_agg(), "costs_agg": texts.costs_agg(), "kpi": texts.kpi()}
    if generation == "v1":
        return found | {"store_comparison": texts.store_comparison(), "export_monthly": texts.export_v1()}
    return found | {"export_monthly": texts.export_v2(), "costs_detail": texts.costs_detail(), "waterfall": texts.waterfall()}


def create_views(
    spark: SparkSession, names: SourceNames, generation: str = "v2", preset: Preset | None = None, prefix: str = PREFIX
) -> list[str]:
    """Create or replace the lasting views of a generation; returns their names.

    `prefix` may begin with a database (`reports.benchmark_`). The sources must be tables or
    lasting views themselves. Nothing is computed: a view is read when it is asked for.
    """
    created = []
    for short, select in view_texts(names, generation, preset, prefix).items():
        spark.sql(f"CREATE OR REPLACE VIEW {name(prefix + short)} AS {select}")
        created.append(prefix + short)
    return created
