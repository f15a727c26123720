"""Ratios of the delivered statements at a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.fields import MONEY_FIELDS, RATIOS, SIGNALS
from quernstone.operators import statements
from quernstone.plans.delivery_sql import _STATEMENTS, _number, _plain
from quernstone.session import table

AS_OF = "2026-12-31"


def _three(spark: SparkSession, d: str) -> DataFrame:
    return statements.three_years(statements.load(table(spark, d, "statements")), F.lit(AS_OF).cast("date"))


def q_loaded(spark: SparkSession, d: str) -> DataFrame:
    x = statements.load(table(spark, d, "statements"))
    return x.select("statement_id", "ticker", "revision", (F.col("revenue") + 0.0).alias("revenue"), (F.col("cash") + 0.0).alias("cash"))


def q_ratios(spark: SparkSession, d: str) -> DataFrame:
    return statements.ratios(_three(spark, d)).select("ticker", "period_end", *[(F.round(m, 2 if m == "fcf" else 6) + 0.0).alias(m) for m in RATIOS])


def q_signals(spark: SparkSession, d: str) -> DataFrame:
    return statements.ratios(_three(spark, d)).select("ticker", *SIGNALS)


QUERIES = {"statements_loaded": q_loaded, "statement_ratios": q_ratios, "statement_signals": q_signals}


def _value(f: str) -> str:
    return f"({_plain(f)})"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


def _avg(a: str, b: str) -> str:
    return f"({a} / 2 + {b} / 2)"


_ISSUED = _number("(p->>'$.equity_issued')")
_LOADED = f"""{_STATEMENTS},
    loaded AS (SELECT s.statement_id, upper(trim(s.ticker)) AS ticker, s.period_end, s.available_at, p->>'$.currency' AS currency, CAST(coalesce({_value('revision_id')}, 0) AS BIGINT) AS revision, {_ISSUED} AS issued,
               {', '.join(f'{_value(f)} * {_value("unit_scale")} AS {f}' for f in MONEY_FIELDS)}
               FROM statements s JOIN parsed USING (statement_id) JOIN statement_reasons r ON r.row_id = s.statement_id WHERE r.reason IS NULL)"""
_KEPT = ("period_end", "currency", *MONEY_FIELDS)
_THREE = f"""{_LOADED},
    years AS (SELECT * FROM loaded WHERE period_end <= DATE '{AS_OF}' AND available_at <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY available_at DESC, revision DESC, statement_id) = 1),
    aligned AS (SELECT *, {', '.join(f'lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY period_end) AS {c}_{n}' for n in (1, 2) for c in _KEPT)} FROM years),
    three AS (SELECT * FROM aligned WHERE datediff('day', period_end_1, period_end) BETWEEN 350 AND 380 AND datediff('day', period_end_2, period_end_1) BETWEEN 350 AND 380
              AND currency = currency_1 AND currency_1 = currency_2 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) = 1),
    r0 AS (SELECT *, {_div('net_income', 'total_assets_1')} AS roa, CASE WHEN equity_parent > 0 AND equity_parent_1 > 0 THEN {_div('net_income_parent', _avg('equity_parent', 'equity_parent_1'))} END AS roe,
        {_div('revenue - cogs', 'revenue')} AS gross_margin, {_div('operating_cash_flow', 'net_income')} AS cash_conversion, {_div('core_income_parent', 'net_income_parent')} AS core_profit_share, operating_cash_flow - capex AS fcf,
        CASE WHEN revenue > 0 AND revenue_2 > 0 THEN exp((ln(revenue) - ln(revenue_2)) / 2) - 1 END AS revenue_cagr_2y,
        CASE WHEN core_income_parent > 0 AND core_income_parent_2 > 0 THEN exp((ln(core_income_parent) - ln(core_income_parent_2)) / 2) - 1 END AS core_profit_cagr_2y,
        {_div('total_debt - cash', 'operating_cash_flow')} AS net_debt_to_cfo, {_div('ebit', 'interest_expense')} AS interest_cover, {_div('current_assets', 'current_liabilities')} AS current_ratio,
        {_div('revenue', 'revenue_1')} - 1 AS revenue_growth_yoy, {_div('core_income_parent', 'core_income_parent_1')} - 1 AS core_profit_growth_yoy FROM three),
    ratios AS (SELECT *, roa > 0 AS positive_roa, {_div('operating_cash_flow', 'total_assets_1')} > 0 AS positive_cfo, roa > {_div('net_income_1', 'total_assets_2')} AS roa_improved, {_div('operating_cash_flow', 'total_assets_1')} > roa AS accruals_quality,
        {_div('long_term_debt', _avg('total_assets', 'total_assets_1'))} < {_div('long_term_debt_1', _avg('total_assets_1', 'total_assets_2'))} AS lower_leverage, current_ratio > {_div('current_assets_1', 'current_liabilities_1')} AS higher_current_ratio,
        issued = 0 AS no_equity_issuance, gross_margin > {_div('revenue_1 - cogs_1', 'revenue_1')} AS higher_gross_margin, {_div('revenue', 'total_assets_1')} > {_div('revenue_1', 'total_assets_2')} AS higher_asset_turnover FROM r0)"""

SQL = {
    "statements_loaded": f"WITH {_LOADED} SELECT statement_id, ticker, revision, revenue + 0.0 AS revenue, cash + 0.0 AS cash FROM loaded",
    "statement_ratios": f"WITH {_THREE} SELECT ticker, period_end, {', '.join(f'round({m}, {2 if m == "fcf" else 6}) + 0.0 AS {m}' for m in RATIOS)} FROM ratios",
    "statement_signals": f"WITH {_THREE} SELECT ticker, {', '.join(SIGNALS)} FROM ratios",
}
