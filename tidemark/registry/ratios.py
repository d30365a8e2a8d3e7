"""Ratio queries over proxy measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ratios as R
from tidemark.plans.ratio_job import build_ratio_tables
from tidemark.registry import job
from tidemark.registry.ctes import CTES, define
from tidemark.registry.present import present
from tidemark.session import shared_dir

# Stand-ins for statement measures, as shares of the measures the test tables hold.
STAND_INS = {
    "pay": "fees * 0.5",
    "cost": "revenue * 0.6",
    "selling_fee": "fees * 0.25",
    "admin_fee": "fees * 0.125",
    "finance_fee": "fees * 0.0625",
    "profit_before_tax": "revenue - fees",
    "net_profit": "revenue - fees - tax",
    "adjusted_profit": "revenue - fees - tax * 1.5",
    "operating_profit": "revenue * 0.4 - fees",
    "operating_cash": "revenue - receivables",
    "cash_receipts": "revenue - receivables * 0.5",
    "equity": "total_assets - inventory * 0.25",
    "dividends": "tax * 0.75",
    "depreciation": "inventory * 0.0625",
    "impairment": "receivables * 0.03125",
    "investment_income": "tax * 0.125",
    "retained_profit": "revenue - tax",
    "development": "fees * 0.1",
    "research": "fees * 0.2",
    "capitalised": "fees * 0.05",
    "shares": "headcount * 100",
    "construction": "inventory * 0.1",
    "fixed_assets": "total_assets * 0.5",
    "intangible": "total_assets * 0.05",
    "goodwill": "total_assets * 0.02",
    "advance": "receivables * 0.2",
    "payables": "inventory * 0.3",
    "prepaid": "inventory * 0.1",
    "current_assets": "receivables + inventory",
    "current_liabilities": "inventory * 0.8",
    "cash": "revenue * 0.1",
    "short_debt": "total_assets * 0.1",
    "long_debt": "total_assets * 0.15",
    "bonds": "total_assets * 0.05",
    "due_within_year": "long_debt * 0.2",
    "total_liabilities": "total_assets - equity",
    "investment_property": "total_assets * 0.03",
    "market_value": "shares * (net_profit * 0.001)",
    "notes": "receivables * 0.4",
}
BASE = ["revenue", "fees", "tax", "headcount", "receivables", "inventory", "total_assets"]

_base_sql = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in BASE)
_wide_sql = ", ".join(f"{e} AS {n}" for n, e in STAND_INS.items())
_prior_sql = ", ".join(f"CASE WHEN lag(year) OVER w = year - 1 THEN lag({m}) OVER w END AS prev_{m}" for m in R.PRIOR_MEASURES)

define("statement_wide", f"SELECT *, {_wide_sql} FROM (SELECT code, year, {_base_sql} FROM statement)")
_excess_sql = """
    SELECT *, CASE WHEN lag(year) OVER v = year - 1 THEN lag(excess_profit) OVER v END AS prev_excess_profit
    FROM (SELECT *, net_profit - 0.08 * prev_equity AS excess_profit FROM ({inner})) WINDOW v AS (PARTITION BY {keys} ORDER BY year)"""
define("ratio_base", _excess_sql.format(keys="code", inner=f"SELECT *, {_prior_sql} FROM statement_wide WINDOW w AS (PARTITION BY code ORDER BY year)"))
define(
    "statement_typed",
    CTES["statement"]
    .replace("SELECT code, year, CAST(sum(revenue)", "SELECT code, report_type, year, CAST(sum(revenue)")
    .replace("SELECT o_orderkey, lpad", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '年度报告' WHEN 'O' THEN "
             "'半年度报告' WHEN 'P' THEN '第三季度报告' END AS report_type, lpad")
    .replace("GROUP BY code, year", "GROUP BY code, report_type, year"),
)
define("ratio_base_typed", f"""
    SELECT *, {_prior_sql} FROM (SELECT *, {_wide_sql} FROM (SELECT code, report_type, year, {_base_sql} FROM statement_typed))
    WINDOW w AS (PARTITION BY code, report_type ORDER BY year)""")


# The same measures in SQL, written from their names and not from the formulas of the library.
HAND_SQL = {
    "ratio_per_head": """
        pay / nullif(10000 * headcount, 0) AS pay_per_head, pay / nullif(revenue, 0) AS pay_to_revenue,
        revenue / nullif(10000 * headcount, 0) AS revenue_per_head, net_profit / nullif(10000 * headcount, 0) AS profit_per_head""",
    "ratio_capital": """
        equity / nullif(total_assets, 0) AS net_assets_ratio, net_profit / nullif(total_assets, 0) AS return_on_assets,
        dividends / nullif(net_profit, 0) AS dividend_payout""",
    "ratio_cash": "operating_cash / nullif(net_profit, 0) AS cash_to_profit, cash_receipts / nullif(revenue, 0) AS receipts_to_revenue",
    "ratio_growth": """
        (revenue - prev_revenue) / nullif(prev_revenue, 0) AS revenue_growth,
        (net_profit - prev_net_profit) / nullif(prev_net_profit, 0) AS profit_growth,
        (adjusted_profit - prev_adjusted_profit) / nullif(prev_adjusted_profit, 0) AS adjusted_growth,
        (operating_cash - prev_operating_cash) / nullif(prev_operating_cash, 0) AS cash_growth,
        (equity - prev_equity) / nullif(prev_equity, 0) AS equity_growth,
        (market_value - prev_market_value) / nullif(prev_market_value, 0) AS market_value_growth""",
    "ratio_fees": """
        selling_fee + admin_fee + finance_fee AS three_fees, (selling_fee + admin_fee + finance_fee) / nullif(revenue, 0) AS fees_to_revenue,
        fees / nullif(revenue, 0) AS all_fees_to_revenue, (depreciation + impairment) / nullif(revenue, 0) AS wear_to_revenue""",
    "ratio_tax": """
        tax / nullif(profit_before_tax - investment_income, 0) AS tax_rate, tax / nullif(profit_before_tax, 0) AS plain_tax_rate""",
    "ratio_margins": """
        operating_profit / nullif(revenue, 0) AS operating_margin, (revenue - cost) / nullif(revenue, 0) AS gross_margin,
        net_profit / nullif(revenue, 0) AS net_margin""",
    "ratio_dupont": """
        net_profit / nullif((equity + prev_equity) / 2, 0) AS return_on_equity,
        revenue / nullif((total_assets + prev_total_assets) / 2, 0) AS asset_turnover,
        (total_assets + prev_total_assets) / nullif(equity + prev_equity, 0) AS equity_multiplier""",
    "ratio_retained": "(net_profit - prev_net_profit) / nullif(retained_profit, 0) AS retained_return",
    "ratio_rnd": """
        (development + research) / nullif(revenue, 0) AS rnd_to_revenue, capitalised / nullif(development + research, 0) AS capitalised_share,
        capitalised - prev_capitalised AS capitalised_change""",
    "ratio_per_share": "net_profit / nullif(shares, 0) AS profit_per_share, equity / nullif(shares, 0) AS assets_per_share",
    "ratio_assets": """
        construction / nullif(fixed_assets, 0) AS construction_to_fixed,
        fixed_assets + construction + intangible + investment_property AS production_capital,
        profit_before_tax / nullif(fixed_assets + construction + intangible + investment_property, 0) AS profit_to_production,
        goodwill / nullif(revenue, 0) AS goodwill_to_revenue""",
    "ratio_receivables": """
        receivables / nullif(total_assets, 0) AS receivables_to_assets, receivables / nullif(revenue, 0) AS receivables_to_revenue,
        (advance + payables) / nullif(prepaid + receivables, 0) AS credit_position, advance / nullif(receivables, 0) AS advance_to_receivables""",
    "ratio_liquidity": """
        current_assets / nullif(current_liabilities, 0) AS current_ratio, (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio,
        current_assets / nullif(total_liabilities, 0) AS current_assets_to_liabilities,
        cash / nullif(short_debt + due_within_year, 0) AS cash_to_debt, short_debt + due_within_year AS interest_debt,
        notes - prev_notes AS notes_increase""",
    "ratio_turnover": """
        revenue / nullif((receivables + prev_receivables) / 2, 0) AS receivable_turnover,
        cost / nullif((inventory + prev_inventory) / 2, 0) AS inventory_turnover""",
    "ratio_working": """
        operating_profit / nullif(receivables + inventory + prepaid - advance - payables, 0) AS profit_to_working,
        revenue / nullif(receivables + inventory + prepaid - advance - payables, 0) AS revenue_to_working""",
    "ratio_residual": """
        operating_profit / nullif(total_assets - current_liabilities, 0) AS restored_return, 0.08 * prev_equity AS required_return,
        net_profit - 0.08 * prev_equity AS residual_income,
        (excess_profit - prev_excess_profit) / nullif(prev_excess_profit, 0) AS residual_growth, (net_profit - 0.08 * prev_equity) / 0.08 AS perpetual_value""",
}


def wide(statement, *keys):
    doubles = statement.select(*keys, *[F.col(m).cast("double").alias(m) for m in BASE])
    return doubles.select("*", *[F.expr(e).alias(n) for n, e in STAND_INS.items()])


def base(c):
    return R.with_prior(wide(c.statement(), "code", "year"), ["code"])


def _register(group: str) -> None:
    @job(group, f"SELECT code, year, {HAND_SQL[group]} FROM ratio_base")
    def _run(c, group=group):
        return present(R.ratios(base(c), [group], ["code", "year"]))


for _group in R.RATIOS:
    _register(_group)


@job("annualised_growth", """
    SELECT n.code, n.year, round(CASE WHEN n.net_profit > 0 AND e.net_profit > 0 THEN pow(n.net_profit / e.net_profit, 1.0 / 3) - 1 END, 9) AS net_profit_growth,
           round(CASE WHEN n.total_assets > 0 AND e.total_assets > 0 THEN pow(n.total_assets / e.total_assets, 1.0 / 3) - 1 END, 9) AS total_assets_growth
    FROM statement_wide n LEFT JOIN statement_wide e ON e.code = n.code AND e.year = n.year - 3""")
def _annualised(c):
    df = R.annualised_growth(wide(c.statement(), "code", "year"), ["code"], ["net_profit", "total_assets"], 3)
    return present(
        df.select("code", "year", *[F.round(f"{m}_growth", 9).alias(f"{m}_growth") for m in ("net_profit", "total_assets")])
    )


GROUPS = [
    "ratio_per_head", "ratio_capital", "ratio_cash", "ratio_growth", "ratio_tax", "ratio_fees", "ratio_margins", "ratio_dupont", "ratio_rnd",
    "ratio_assets", "ratio_receivables", "ratio_liquidity", "ratio_turnover", "ratio_working", "ratio_residual",
]
define("marked_ratios", "SELECT code, year, " + ", ".join(HAND_SQL[g] for g in GROUPS) + " FROM ratio_base")
define("marks", """
    SELECT code, year, measure, value, percent, coalesce(passed, false) AS marked FROM (SELECT code, year, unnest([
        {'measure': 'pay_to_revenue', 'value': pay_to_revenue, 'passed': pay_to_revenue < 0.15, 'percent': true},
        {'measure': 'net_assets_ratio', 'value': net_assets_ratio, 'passed': net_assets_ratio > 0.5, 'percent': true},
        {'measure': 'return_on_assets', 'value': return_on_assets, 'passed': return_on_assets > 0.1, 'percent': true},
        {'measure': 'dividend_payout', 'value': dividend_payout, 'passed': dividend_payout > 0.3, 'percent': true},
        {'measure': 'revenue_per_head', 'value': revenue_per_head, 'passed': revenue_per_head > 100, 'percent': false},
        {'measure': 'profit_per_head', 'value': profit_per_head, 'passed': profit_per_head > 15, 'percent': false},
        {'measure': 'cash_to_profit', 'value': cash_to_profit, 'passed': cash_to_profit > 1, 'percent': false},
        {'measure': 'revenue_growth', 'value': revenue_growth, 'passed': revenue_growth > 0.3, 'percent': true},
        {'measure': 'profit_growth', 'value': profit_growth, 'passed': false, 'percent': true},
        {'measure': 'adjusted_growth', 'value': adjusted_growth, 'passed': adjusted_growth > 0.3, 'percent': true},
        {'measure': 'cash_growth', 'value': cash_growth, 'passed': cash_growth > 0.3, 'percent': true},
        {'measure': 'tax_rate', 'value': tax_rate, 'passed': false, 'percent': true},
        {'measure': 'all_fees_to_revenue', 'value': all_fees_to_revenue, 'passed': all_fees_to_revenue > 0.3, 'percent': true},
        {'measure': 'wear_to_revenue', 'value': wear_to_revenue, 'passed': wear_to_revenue < 0.05, 'percent': true},
        {'measure': 'operating_margin', 'value': operating_margin, 'passed': false, 'percent': true},
        {'measure': 'gross_margin', 'value': gross_margin, 'passed': gross_margin > 0.3, 'percent': true},
        {'measure': 'net_margin', 'value': net_margin, 'passed': net_margin > 0.2, 'percent': true},
        {'measure': 'return_on_equity', 'value': return_on_equity, 'passed': return_on_equity > 0.2, 'percent': true},
        {'measure': 'asset_turnover', 'value': asset_turnover, 'passed': false, 'percent': true},
        {'measure': 'equity_growth', 'value': equity_growth, 'passed': false, 'percent': true},
        {'measure': 'rnd_to_revenue', 'value': rnd_to_revenue, 'passed': rnd_to_revenue > 0.08, 'percent': true},
        {'measure': 'capitalised_share', 'value': capitalised_share, 'passed': capitalised_share > 0.3, 'percent': true},
        {'measure': 'construction_to_fixed', 'value': construction_to_fixed, 'passed': construction_to_fixed > 0.3, 'percent': true},
        {'measure': 'profit_to_production', 'value': profit_to_production, 'passed': profit_to_production > 0.2, 'percent': true},
        {'measure': 'goodwill_to_revenue', 'value': goodwill_to_revenue, 'passed': false, 'percent': true},
        {'measure': 'receivables_to_revenue', 'value': receivables_to_revenue, 'passed': receivables_to_revenue > 0.3, 'percent': true},
        {'measure': 'credit_position', 'value': credit_position, 'passed': credit_position > 1, 'percent': false},
        {'measure': 'advance_to_receivables', 'value': advance_to_receivables, 'passed': false, 'percent': false},
        {'measure': 'current_ratio', 'value': current_ratio, 'passed': current_ratio > 2, 'percent': false},
        {'measure': 'quick_ratio', 'value': quick_ratio, 'passed': quick_ratio > 1, 'percent': false},
        {'measure': 'cash_to_debt', 'value': cash_to_debt, 'passed': cash_to_debt > 1.5, 'percent': false},
        {'measure': 'current_assets_to_liabilities', 'value': current_assets_to_liabilities, 'passed': current_assets_to_liabilities > 1.5, 'percent': false},
        {'measure': 'receipts_to_revenue', 'value': receipts_to_revenue, 'passed': receipts_to_revenue > 1, 'percent': false},
        {'measure': 'receivable_turnover', 'value': receivable_turnover, 'passed': receivable_turnover > 5, 'percent': false},
        {'measure': 'inventory_turnover', 'value': inventory_turnover, 'passed': false, 'percent': false},
        {'measure': 'profit_to_working', 'value': profit_to_working, 'passed': false, 'percent': false},
        {'measure': 'revenue_to_working', 'value': revenue_to_working, 'passed': false, 'percent': false},
        {'measure': 'restored_return', 'value': restored_return, 'passed': restored_return > 0.2, 'percent': true}], recursive := true)
    FROM marked_ratios)""")


def marks(c):
    return R.threshold_marks(R.ratios(base(c), GROUPS, ["code", "year"]), ["code", "year"])


@job("threshold_marks", "SELECT code, year, measure, value, percent, marked FROM marks")
def _threshold(c):
    return present(marks(c), "code", "year", "measure", "value", "percent", "marked")


@job("grade_score", "SELECT code, year, count(*) FILTER (marked) AS grade FROM marks GROUP BY 1, 2")
def _grade(c):
    return present(R.grade_score(marks(c), ["code", "year"]))


@job("ratio_build", f"""
    SELECT code, report_type, year, {HAND_SQL["ratio_margins"]}, {HAND_SQL["ratio_growth"]}
    FROM ratio_base_typed WHERE report_type IN ('年度报告', '半年度报告')""")
def _build(c):
    statement = wide(c.statement(by_type=True), "code", "report_type", "year")
    path = shared_dir(c.spark, "ratio-tables")
    table = build_ratio_tables(statement, ["年度报告", "半年度报告"], ["ratio_margins", "ratio_growth"], path)
    return present(table)
