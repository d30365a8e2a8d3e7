"""Financial ratios over yearly statement measures.

The formulas follow the measures' own names.  Assumptions: the retained-profit return is taken as
the change of profit over retained profit; residual income charges the required return ``r`` on
last year's equity and its perpetual value is income over ``r``; the investment grade is the number
of thresholds a row passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import prior_period


@dataclass(frozen=True)
class Ratio:
    """``top`` over ``bottom`` (a plain sum where there is no bottom), as column arithmetic."""

    name: str
    top: str
    bottom: str | None = None

    def column(self) -> Column:
        top = F.expr(self.top)
        value = top if self.bottom is None else F.try_divide(top, F.expr(self.bottom))
        return value.alias(self.name)


REQUIRED_RETURN = 0.08

RATIOS: dict[str, list[Ratio]] = {
    "ratio_per_head": [
        Ratio("pay_per_head", "pay", "headcount * 10000"),
        Ratio("pay_to_revenue", "pay", "revenue"),
        Ratio("revenue_per_head", "revenue", "headcount * 10000"),
        Ratio("profit_per_head", "net_profit", "headcount * 10000"),
    ],
    "ratio_capital": [
        Ratio("net_assets_ratio", "equity", "total_assets"),
        Ratio("return_on_assets", "net_profit", "total_assets"),
        Ratio("dividend_payout", "dividends", "net_profit"),
    ],
    "ratio_cash": [
        Ratio("cash_to_profit", "operating_cash", "net_profit"),
        Ratio("receipts_to_revenue", "cash_receipts", "revenue"),
    ],
    "ratio_growth": [
        Ratio("revenue_growth", "revenue - prev_revenue", "prev_revenue"),
        Ratio("profit_growth", "net_profit - prev_net_profit", "prev_net_profit"),
        Ratio("adjusted_growth", "adjusted_profit - prev_adjusted_profit", "prev_adjusted_profit"),
        Ratio("cash_growth", "operating_cash - prev_operating_cash", "prev_operating_cash"),
        Ratio("equity_growth", "equity - prev_equity", "prev_equity"),
        Ratio("market_value_growth", "market_value - prev_market_value", "prev_market_value"),
    ],
    "ratio_fees": [
        Ratio("three_fees", "selling_fee + admin_fee + finance_fee"),
        Ratio("fees_to_revenue", "selling_fee + admin_fee + finance_fee", "revenue"),
        Ratio("all_fees_to_revenue", "fees", "revenue"),
        Ratio("wear_to_revenue", "depreciation + impairment", "revenue"),
    ],
    "ratio_tax": [
        Ratio("tax_rate", "tax", "profit_before_tax - investment_income"),
        Ratio("plain_tax_rate", "tax", "profit_before_tax"),
    ],
    "ratio_margins": [
        Ratio("operating_margin", "operating_profit", "revenue"),
        Ratio("gross_margin", "revenue - cost", "revenue"),
        Ratio("net_margin", "net_profit", "revenue"),
    ],
    "ratio_dupont": [
        Ratio("return_on_equity", "net_profit", "(equity + prev_equity) / 2"),
        Ratio("asset_turnover", "revenue", "(total_assets + prev_total_assets) / 2"),
        Ratio("equity_multiplier", "total_assets + prev_total_assets", "equity + prev_equity"),
    ],
    "ratio_retained": [Ratio("retained_return", "net_profit - prev_net_profit", "retained_profit")],
    "ratio_rnd": [
        Ratio("rnd_to_revenue", "development + research", "revenue"),
        Ratio("capitalised_share", "capitalised", "development + research"),
        Ratio("capitalised_change", "capitalised - prev_capitalised"),
    ],
    "ratio_per_share": [Ratio("profit_per_share", "net_profit", "shares"), Ratio("assets_per_share", "equity", "shares")],
    "ratio_assets": [
        Ratio("construction_to_fixed", "construction", "fixed_assets"),
        Ratio("production_capital", "fixed_assets + construction + intangible + investment_property"),
        Ratio("profit_to_production", "profit_before_tax", "fixed_assets + construction + intangible + investment_property"),
        Ratio("goodwill_to_revenue", "goodwill", "revenue"),
    ],
    "ratio_receivables": [
        Ratio("receivables_to_assets", "receivables", "total_assets"),
        Ratio("receivables_to_revenue", "receivables", "revenue"),
        Ratio("credit_position", "advance + payables", "prepaid + receivables"),
        Ratio("advance_to_receivables", "advance", "receivables"),
    ],
    "ratio_liquidity": [
        Ratio("current_ratio", "current_assets", "current_liabilities"),
        Ratio("quick_ratio", "current_assets - inventory", "current_liabilities"),
        Ratio("current_assets_to_liabilities", "current_assets", "total_liabilities"),
        Ratio("cash_to_debt", "cash", "short_debt + due_within_year"),
        Ratio("interest_debt", "short_debt + due_within_year"),
        Ratio("notes_increase", "notes - prev_notes"),
    ],
    "ratio_turnover": [
        Ratio("receivable_turnover", "revenue", "(receivables + prev_receivables) / 2"),
        Ratio("inventory_turnover", "cost", "(inventory + prev_inventory) / 2"),
    ],
    "ratio_working": [
        Ratio("profit_to_working", "operating_profit", "receivables + inventory + prepaid - advance - payables"),
        Ratio("revenue_to_working", "revenue", "receivables + inventory + prepaid - advance - payables"),
    ],
    "ratio_residual": [
        Ratio("restored_return", "operating_profit", "total_assets - current_liabilities"),
        Ratio("required_return", f"prev_equity * {REQUIRED_RETURN}"),
        Ratio("residual_income", "excess_profit"),
        Ratio("residual_growth", "excess_profit - prev_excess_profit", "prev_excess_profit"),
        Ratio("perpetual_value", "excess_profit", f"{REQUIRED_RETURN}"),
    ],
}

PRIOR_MEASURES = [
    "revenue", "net_profit", "adjusted_profit", "operating_cash", "equity", "total_assets", "receivables", "inventory",
    "capitalised", "notes", "market_value",
]


def with_prior(statement: DataFrame, keys: Sequence[str], period: str = "year") -> DataFrame:
    """Statement with last year's value of every measure some ratio compares with.

    ``excess_profit`` is what the profit leaves of the return required on last year's equity; it has a prior value of its own.
    """
    known = prior_period(statement, keys, period, PRIOR_MEASURES)
    known = known.withColumn("excess_profit", F.expr(f"net_profit - prev_equity * {REQUIRED_RETURN}"))
    return prior_period(known, keys, period, ["excess_profit"])


def ratios(statement: DataFrame, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Ratio columns of the named groups; ``statement`` comes from ``with_prior``."""
    return statement.select(*keys, *[r.column() for g in groups for r in RATIOS[g]])


def annualised_growth(statement: DataFrame, keys: Sequence[str], measures: Sequence[str], span: int) -> DataFrame:
    """Compound yearly growth over ``span`` years, where both ends exist and are positive, else NULL.

    The earlier end is found by an equi join on the shifted year.
    """
    earlier = statement.select(*keys, (F.col("year") + span).alias("year"), *[F.col(m).alias(f"_{m}") for m in measures])
    both = statement.join(earlier, [*keys, "year"], "left")
    columns = []
    for m in measures:
        now, then = F.col(m).cast("double"), F.col(f"_{m}").cast("double")
        columns.append(F.when((now > 0) & (then > 0), F.pow(now / then, F.lit(1.0 / span)) - 1).alias(f"{m}_growth"))
    return both.select(*keys, "year", *columns)


# Thresholds of the comprehensive report, as measure, operator, threshold, percentage.
THRESHOLDS = [
    ("pay_to_revenue", "lessThan", 0.15, True),
    ("net_assets_ratio", "greaterThan", 0.5, True),
    ("return_on_assets", "greaterThan", 0.1, True),
    ("dividend_payout", "greaterThan", 0.3, True),
    ("revenue_per_head", "greaterThan", 100.0, False),
    ("profit_per_head", "greaterThan", 15.0, False),
    ("cash_to_profit", "greaterThan", 1.0, False),
    ("revenue_growth", "greaterThan", 0.3, True),
    ("profit_growth", "", 0.3, True),
    ("adjusted_growth", "greaterThan", 0.3, True),
    ("cash_growth", "greaterThan", 0.3, True),
    ("tax_rate", "", 0.15, True),
    ("all_fees_to_revenue", "greaterThan", 0.3, True),
    ("wear_to_revenue", "lessThan", 0.05, True),
    ("operating_margin", "", 0.2, True),
    ("gross_margin", "greaterThan", 0.3, True),
    ("net_margin", "greaterThan", 0.2, True),
    ("return_on_equity", "greaterThan", 0.2, True),
    ("asset_turnover", "", 0.2, True),
    ("equity_growth", "", 0.2, True),
    ("rnd_to_revenue", "greaterThan", 0.08, True),
    ("capitalised_share", "greaterThan", 0.3, True),
    ("construction_to_fixed", "greaterThan", 0.3, True),
    ("profit_to_production", "greaterThan", 0.2, True),
    ("goodwill_to_revenue", "", 0.2, True),
    ("receivables_to_revenue", "greaterThan", 0.3, True),
    ("credit_position", "greaterThan", 1.0, False),
    ("advance_to_receivables", "", 1.0, False),
    ("current_ratio", "greaterThan", 2.0, False),
    ("quick_ratio", "greaterThan", 1.0, False),
    ("cash_to_debt", "greaterThan", 1.5, False),
    ("current_assets_to_liabilities", "greaterThan", 1.5, False),
    ("receipts_to_revenue", "greaterThan", 1.0, False),
    ("receivable_turnover", "greaterThan", 5.0, False),
    ("inventory_turnover", "", 2.0, False),
    ("profit_to_working", "", 1.0, False),
    ("revenue_to_working", "", 2.0, False),
    ("restored_return", "greaterThan", 0.2, True),
    ("annualised_profit_growth", "greaterThan", 0.3, True),
    ("annualised_market_value_growth", "greaterThan", 0.3, True),
    ("annualised_adjusted_growth", "greaterThan", 0.3, True),
    ("grade", "", 0.3, True),
]


def threshold_marks(
    table: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, float, bool]] = tuple(THRESHOLDS)
) -> DataFrame:
    """One row per key and measure with its mark and printed form.

    The rules are a short list carried inside each row's array of measures, so no join is needed.
    A measure without operator is never marked.
    """
    cells = [
        F.struct(
            F.lit(name).alias("measure"),
            F.col(name).cast("double").alias("value"),
            F.lit(operator).alias("operator"),
            F.lit(threshold).alias("threshold"),
            F.lit(percent).alias("percent"),
        )
        for name, operator, threshold, percent in rules
        if name in table.columns
    ]
    long = table.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    passed = F.when(F.col("operator") == "lessThan", F.col("value") < F.col("threshold")).when(
        F.col("operator") == "greaterThan", F.col("value") > F.col("threshold")
    )
    return long.withColumn("marked", F.coalesce(passed, F.lit(False)))


def grade_score(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of passed marks, the sort grade of the report."""
    return marks.groupBy(*keys).agg(F.count_if("marked").alias("grade"))
