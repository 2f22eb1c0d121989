"""Metric registry and alias vocabulary as dimension tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "id string, label string, unit string, is_non_gaap boolean, gaap_counterpart string, tags array<string>, kind string, "
    "base string, numerator string, denominator string, components array<string>, adjustments array<string>, position int"
)

@dataclass
class Metric:
    id: str
    label: str
    unit: str = "currency"
    is_non_gaap: bool = False
    gaap_counterpart: str | None = None
    tags: list[str] = field(default_factory=list)
    kind: str | None = None
    base: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    components: list[str] = field(default_factory=list)
    adjustments: list[str] = field(default_factory=list)


#: The metrics that are known from the start, in registration order.
METRICS_AT_START = [
    Metric("total_revenue", "Total revenue", tags=["us-gaap:Revenues", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax"]),
    Metric("revenue_growth_yoy", "Total revenue growth, YoY", "percent", kind="yoy_growth", base="total_revenue"),
    Metric("cost_of_revenue", "Cost of revenue", tags=["us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold"]),
    Metric("gross_profit", "Gross profit", tags=["us-gaap:GrossProfit"]),
    Metric("rnd_expense", "Research and development expense", tags=["us-gaap:ResearchAndDevelopmentExpense"]),
    Metric("sga_expense", "Selling, general and administrative expense", tags=["us-gaap:SellingGeneralAndAdministrativeExpense"]),
    Metric("total_costs_and_expenses", "Total operating costs and expenses", tags=["us-gaap:CostsAndExpenses", "us-gaap:OperatingExpenses", "us-gaap:BenefitsLossesAndExpenses"]),
    Metric("operating_income", "Earnings from operations", tags=["us-gaap:OperatingIncomeLoss"]),
    Metric("pretax_income", "Earnings before income taxes", tags=["us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "us-gaap:IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"]),
    Metric("income_tax_expense", "Provision for income taxes", tags=["us-gaap:IncomeTaxExpenseBenefit"]),
    Metric("net_income", "Net earnings", tags=["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"]),
    Metric("gaap_basic_eps", "GAAP basic EPS", tags=["us-gaap:EarningsPerShareBasic"]),
    Metric("basic_shares", "Weighted-average basic shares", "shares", tags=["us-gaap:WeightedAverageNumberOfSharesOutstandingBasic"]),
    Metric("diluted_shares", "Weighted-average diluted shares", "shares", tags=["us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding"]),
    Metric("total_assets", "Total assets", tags=["us-gaap:Assets"]),
    Metric("total_liabilities", "Total liabilities", tags=["us-gaap:Liabilities"]),
    Metric("stockholders_equity", "Shareholders' equity", tags=["us-gaap:StockholdersEquity", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    Metric("cash_and_equivalents", "Cash and cash equivalents", tags=["us-gaap:CashAndCashEquivalentsAtCarryingValue"]),
    Metric("long_term_debt", "Long-term debt", tags=["us-gaap:LongTermDebt", "us-gaap:LongTermDebtNoncurrent"]),
    Metric("investing_cash_flow", "Cash flows from investing activities", tags=["us-gaap:NetCashProvidedByUsedInInvestingActivities"]),
    Metric("financing_cash_flow", "Cash flows from financing activities", tags=["us-gaap:NetCashProvidedByUsedInFinancingActivities"]),
    Metric("capex", "Capital expenditures", tags=["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"]),
    Metric("dividends_paid", "Dividends paid", tags=["us-gaap:PaymentsOfDividends", "us-gaap:PaymentsOfDividendsCommonStock"]),
    Metric("premium_revenue", "Premium revenue", tags=["us-gaap:PremiumsEarnedNet"]),
    Metric("medical_costs", "Medical costs", tags=["us-gaap:PolicyholderBenefitsAndClaimsIncurredNet"]),
    Metric("medical_costs_payable", "Medical costs payable"),
    Metric("medical_care_ratio", "Medical care ratio", "percent", kind="ratio_pct", numerator="medical_costs", denominator="premium_revenue"),
    Metric("operating_cost_ratio", "Operating cost ratio", "percent"),
    Metric("return_on_equity", "Return on equity", "percent"),
    Metric("unitedhealthcare_revenue", "UnitedHealthcare revenue"),
    Metric("optum_revenue", "Optum revenue"),
    Metric("optum_health_revenue", "Optum Health revenue"),
    Metric("optum_insight_revenue", "Optum Insight revenue"),
    Metric("optum_rx_revenue", "Optum Rx revenue"),
    Metric("unitedhealthcare_operating_earnings", "UnitedHealthcare earnings from operations"),
    Metric("optum_operating_earnings", "Optum earnings from operations"),
    Metric("optum_health_operating_earnings", "Optum Health earnings from operations"),
    Metric("optum_insight_operating_earnings", "Optum Insight earnings from operations"),
    Metric("optum_rx_operating_earnings", "Optum Rx earnings from operations"),
    Metric("cloud_revenue", "Cloud segment revenue", tags=["mrdn:CloudSegmentRevenue"]),
    Metric("cloud_growth_yoy", "Cloud growth, YoY", "percent", kind="yoy_growth", base="cloud_revenue"),
    Metric("gaap_diluted_eps", "GAAP diluted EPS", tags=["us-gaap:EarningsPerShareDiluted"]),
    Metric("non_gaap_diluted_eps", "Non-GAAP diluted EPS", is_non_gaap=True, gaap_counterpart="gaap_diluted_eps", adjustments=["sbc_eps_adjustment", "intangibles_amort_eps_adjustment"]),
    Metric("sbc_eps_adjustment", "Stock-based compensation (per share)"),
    Metric("intangibles_amort_eps_adjustment", "Amortization of intangibles (per share)"),
    Metric("operating_cash_flow", "Operating cash flow", tags=["us-gaap:NetCashProvidedByUsedInOperatingActivities"]),
    Metric("share_repurchases", "Share repurchases", tags=["us-gaap:PaymentsForRepurchaseOfCommonStock"]),
    Metric("revenue_guidance", "Revenue guidance"),
    Metric("eps_guidance", "EPS guidance"),
    Metric("adjusted_eps_guidance", "Adjusted EPS guidance"),
    Metric("operating_margin_guidance", "Operating margin guidance", "percent"),
    Metric("operating_margin", "Operating margin", "percent"),
    Metric("operating_margin_change_bps", "Operating margin change", "basis_points", kind="delta_bps", base="operating_margin"),
]

#: Phrases for each metric besides its label.
PHRASES = {
    "total_revenue": ["total revenues", "total revenue", "total net revenue", "net revenue", "revenues", "revenue", "net sales", "total sales", "sales"],
    "cost_of_revenue": ["cost of revenue", "cost of sales", "cost of goods sold", "cost of products sold"],
    "gross_profit": ["gross profit"],
    "rnd_expense": ["research and development", "r&d expense"],
    "sga_expense": ["selling, general and administrative", "sg&a"],
    "total_costs_and_expenses": ["total operating costs and expenses", "total operating costs", "total costs and expenses", "total operating expenses"],
    "operating_income": ["earnings from operations", "income from operations", "operating income", "operating earnings"],
    "pretax_income": ["earnings before income taxes", "income before income taxes", "pre-tax income", "pretax income"],
    "income_tax_expense": ["provision for income taxes", "income tax provision"],
    "net_income": ["net earnings attributable", "net earnings", "net income attributable", "net income"],
    "gaap_basic_eps": ["basic earnings per share", "basic eps"],
    "gaap_diluted_eps": ["gaap diluted eps", "gaap eps", "gaap diluted earnings per share", "diluted eps", "diluted earnings per share", "earnings per share"],
    "non_gaap_diluted_eps": ["non-gaap diluted eps", "non gaap diluted eps", "adjusted diluted eps", "non-gaap eps", "adjusted eps", "non-gaap diluted earnings per share", "adjusted earnings per share", "adjusted net earnings per share"],
    "basic_shares": ["weighted-average basic shares", "basic weighted-average shares"],
    "diluted_shares": ["weighted-average diluted shares", "diluted weighted-average shares", "diluted shares outstanding"],
    "total_assets": ["total assets"],
    "total_liabilities": ["total liabilities"],
    "stockholders_equity": ["shareholders' equity", "stockholders' equity", "total equity"],
    "cash_and_equivalents": ["cash and cash equivalents", "cash and equivalents"],
    "long_term_debt": ["long-term debt"],
    "operating_cash_flow": ["cash flows from operations", "operating cash flow", "cash flow from operations", "cash provided by operating activities", "cash from operations", "cash flows from operating activities"],
    "investing_cash_flow": ["cash flows from investing activities", "cash used for investing activities"],
    "financing_cash_flow": ["cash flows from financing activities", "cash used for financing activities"],
    "capex": ["capital expenditures", "purchases of property, plant and equipment", "purchases of property and equipment", "capex"],
    "dividends_paid": ["cash dividends paid", "dividends paid"],
    "share_repurchases": ["share repurchases", "repurchases of common stock", "repurchase of common stock", "common stock repurchases", "repurchased", "stock buyback", "buyback"],
    "operating_margin": ["operating margin", "margin from operations"],
    "operating_margin_change_bps": ["operating margin expanded", "operating margin improved", "margin expansion", "basis points"],
    "medical_care_ratio": ["medical care ratio", "medical loss ratio", "care ratio"],
    "operating_cost_ratio": ["operating cost ratio"],
    "return_on_equity": ["return on equity"],
    "premium_revenue": ["premium revenues", "premium revenue", "premiums"],
    "medical_costs": ["medical costs", "medical cost trend"],
    "medical_costs_payable": ["medical costs payable"],
    "revenue_guidance": ["revenue in the range", "revenue guidance", "expects total revenue", "revenue outlook", "guidance"],
    "eps_guidance": ["eps guidance", "earnings per share guidance", "net earnings outlook", "eps outlook"],
    "adjusted_eps_guidance": ["adjusted eps guidance", "adjusted earnings per share guidance", "adjusted net earnings outlook"],
    "cloud_revenue": ["cloud segment revenue", "cloud revenue", "cloud segment", "cloud business"],
    "cloud_growth_yoy": ["cloud growth", "cloud segment revenue grew", "cloud revenue grew", "cloud"],
    "unitedhealthcare_revenue": ["revenues — unitedhealthcare", "unitedhealthcare revenue", "unitedhealthcare"],
    "optum_revenue": ["revenues — optum", "optum revenue", "total optum"],
    "optum_health_revenue": ["revenues — optum health", "optum health revenue", "optum health"],
    "optum_insight_revenue": ["revenues — optum insight", "optum insight revenue", "optum insight"],
    "optum_rx_revenue": ["revenues — optum rx", "optum rx revenue", "optum rx"],
    "unitedhealthcare_operating_earnings": ["earnings from operations — unitedhealthcare", "unitedhealthcare earnings from operations"],
    "optum_operating_earnings": ["earnings from operations — optum", "optum earnings from operations"],
    "optum_health_operating_earnings": ["earnings from operations — optum health", "optum health earnings from operations"],
    "optum_insight_operating_earnings": ["earnings from operations — optum insight", "optum insight earnings from operations"],
    "optum_rx_operating_earnings": ["earnings from operations — optum rx", "optum rx earnings from operations"],
}


def default_metrics() -> list[Metric]:
    return [replace(m) for m in METRICS_AT_START]


def default_aliases() -> dict[str, list[str]]:
    return {metric: list(phrases) for metric, phrases in PHRASES.items()}


def metrics_table(spark: SparkSession, metrics: Iterable[Metric] | None = None) -> DataFrame:
    """One row per metric; a later registration of an id replaces an earlier one."""
    known = {m.id: m for m in (default_metrics() if metrics is None else metrics)}
    rows = [(m.id, m.label, m.unit, m.is_non_gaap, m.gaap_counterpart, m.tags, m.kind, m.base, m.numerator, m.denominator, m.components, m.adjustments, i) for i, m in enumerate(known.values())]
    return spark.createDataFrame(rows, METRICS)


def tags_table(metrics: DataFrame) -> DataFrame:
    """``tag`` to metric and unit; the last registration wins."""
    each = metrics.select(F.explode("tags").alias("tag"), "id", "unit", "position")
    return each.groupBy("tag").agg(F.max_by("id", "position").alias("metric"), F.max_by("unit", "position").alias("unit"))


def extend_aliases(aliases: Mapping[str, list[str]], overrides: Mapping[str, Iterable[str]], known: Iterable[str], instead: bool = False) -> dict[str, list[str]]:
    """Phrases joined to (or put for) those there are, in order and once; metrics outside ``known`` are an error."""
    if odd := sorted(set(overrides) - set(known)):
        raise ValueError(f"unknown metrics: {', '.join(odd)}")
    out = {k: list(v) for k, v in aliases.items()}
    for metric, phrases in overrides.items():
        clean = [p.strip().lower() for p in phrases if p and p.strip()]
        out[metric] = list(dict.fromkeys(clean if instead else [*out.get(metric, []), *clean]))
    return {k: v for k, v in out.items() if v}


def aliases_table(spark: SparkSession, aliases: Mapping[str, list[str]] | None = None) -> DataFrame:
    rows = [(m, p) for m, ps in (default_aliases() if aliases is None else aliases).items() for p in ps]
    return spark.createDataFrame(rows, "metric string, phrase string")


def vocabulary(metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Phrases of each metric with its label, lower case, longest first."""
    every = aliases.select("metric", "phrase").union(metrics.select("id", F.lower("label"))).distinct()
    listed = every.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct((-F.length("phrase")).alias("n"), "phrase"))).alias("p"))
    return listed.select("metric", F.transform("p", lambda x: x["phrase"]).alias("phrases"))


def unknown_metrics(overlays: DataFrame, metrics: DataFrame) -> DataFrame:
    """Tenants' metric ids that no metric has."""
    return overlays.select("tenant_id", "metric").distinct().join(metrics.select(F.col("id").alias("metric")), "metric", "left_anti").select("tenant_id", "metric")


def overlaid_phrases(aliases: DataFrame, overlays: DataFrame, metrics: DataFrame, instead: bool = False) -> DataFrame:
    """Phrase lists as tenants have them: ``tenant_id``, ``metric``, ``phrases``; with a null tenant the lists that hold for all others.

    ``aliases`` have metric, pos and phrase, ``overlays`` tenant_id besides; ``pos`` orders a list. A tenant's phrases are lower-cased and trimmed, empty ones dropped, and joined to the
    default ones (or put for them) in order and once. Metrics that a tenant doesn't name stay as they are and aren't repeated for it; metrics that there aren't are left out
    (``unknown_metrics`` has them), and lists that come out empty too.
    """
    listed = lambda df, *by: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda p: p["phrase"]).alias("phrases"))
    default = listed(aliases, "metric").withColumnRenamed("phrases", "default")
    clean = overlays.withColumn("phrase", F.lower(F.regexp_replace(F.coalesce("phrase", F.lit("")), r"(?U)^\s+|\s+$", "")))
    own = listed(clean.join(metrics.select(F.col("id").alias("metric")), "metric", "left_semi"), "tenant_id", "metric")
    both = default.join(own, "metric", "full")
    none = F.array().cast("array<string>")
    kept = F.coalesce("default", none) if not instead else none
    merged = F.filter(F.array_distinct(F.concat(kept, F.coalesce("phrases", none))), lambda p: p != "")
    mine = both.filter("tenant_id IS NOT NULL").select("tenant_id", "metric", merged.alias("phrases"))
    shared = default.select(F.lit(None).cast("string").alias("tenant_id"), "metric", F.col("default").alias("phrases"))
    return mine.unionByName(shared).filter(F.size("phrases") > 0)


def phrases_for(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """The list of each wanted (tenant_id, metric): the tenant's own, else the one that holds for all, else an empty one."""
    own = lists.filter("tenant_id IS NOT NULL")
    shared = lists.filter("tenant_id IS NULL").select("metric", F.col("phrases").alias("default"))
    out = wanted.join(own, ["tenant_id", "metric"], "left").join(shared, "metric", "left")
    return out.select("tenant_id", "metric", F.coalesce("phrases", "default", F.array().cast("array<string>")).alias("phrases"))
