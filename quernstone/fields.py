"""Names of the delivered columns and fields, and of what is computed from them: fixed values of the formats."""

from __future__ import annotations

#: Columns of a record of valuations, in order.
VALUATION_COLUMNS = (
    "ticker", "snapshot_date", "available_at", "revision_id", "market_cap", "currency", "unit_scale",
    "cap_scope", "fx_to_reporting", "fx_date", "fx_source_url", "source_url",
)
#: Fields that a statement must have.
STATEMENT_REQUIRED = (
    "ticker", "name", "market", "sector", "currency", "scope", "filing_id", "source_url", "period_start",
    "period_end", "available_at", "unit_scale",
)
#: Amounts of a statement.
MONEY_FIELDS = (
    "net_income", "net_income_parent", "core_income_parent", "operating_cash_flow", "total_assets",
    "equity_parent", "current_assets", "current_liabilities", "long_term_debt", "total_debt", "cash",
    "revenue", "cogs", "capex", "ebit", "interest_expense",
)
#: Days of a statement.
STATEMENT_DATES = (
    "period_start", "period_end", "available_at",
)
#: Ratios that a statement's years give by themselves.
RATIOS = (
    "roa", "roe", "gross_margin", "cash_conversion", "core_profit_share", "fcf", "revenue_cagr_2y",
    "core_profit_cagr_2y", "net_debt_to_cfo", "interest_cover", "current_ratio", "revenue_growth_yoy",
    "core_profit_growth_yoy",
)
#: All ratios, with the two on the issuer's value.
METRICS = (
    "roa", "roe", "gross_margin", "cash_conversion", "core_profit_share", "fcf", "core_earnings_yield",
    "fcf_yield", "revenue_cagr_2y", "core_profit_cagr_2y", "net_debt_to_cfo", "interest_cover",
    "current_ratio", "revenue_growth_yoy", "core_profit_growth_yoy",
)
#: Signs of health, each true, false or unknown.
SIGNALS = (
    "positive_roa", "positive_cfo", "roa_improved", "accruals_quality", "lower_leverage",
    "higher_current_ratio", "no_equity_issuance", "higher_gross_margin", "higher_asset_turnover",
)
