"""A hand-computed history of three years, and what must not change it."""

import datetime
import json
import math

from pyspark.sql import functions as F

from quernstone.operators import statements
from quernstone.operators.rejects import MONEY_FIELDS, STATEMENT_REQUIRED

YEARS = {
    "net_income": (10, 12, 20), "net_income_parent": (10, 12, 20), "core_income_parent": (9, 11, 18), "operating_cash_flow": (12, 16, 25), "total_assets": (100, 110, 120), "equity_parent": (50, 60, 70),
    "current_assets": (30, 40, 55), "current_liabilities": (20, 22, 25), "long_term_debt": (20, 18, 16), "total_debt": (30, 30, 30), "cash": (10, 10, 10), "revenue": (100, 125, 160), "cogs": (60, 70, 85),
    "capex": (5, 5, 5), "ebit": (15, 20, 30), "interest_expense": (2, 2, 2),
}
CUTOFF = "2026-05-01"


def payload(i, scale="1", **kw):
    base = {k: "x" for k in STATEMENT_REQUIRED} | {"period_start": f"{2023 + i}-01-01", "period_end": f"{2023 + i}-12-31", "available_at": f"{2024 + i}-03-01", "unit_scale": scale, "equity_issued": "0", "currency": "CNY"}
    return json.dumps(base | {f: YEARS[f][i] for f in MONEY_FIELDS} | kw)


def frame(spark, rows):
    return spark.createDataFrame(
        [(n, t, datetime.date(2023 + i, 12, 31), day or datetime.date(2024 + i, 3, 1), p) for n, (t, i, p, day) in enumerate(rows)],
        "statement_id bigint, ticker string, period_end date, available_at date, payload_json string")


def history(t="A", **kw):
    return [(t, i, payload(i, **kw), None) for i in range(3)]


def result(spark, rows):
    return {r.ticker: r for r in statements.ratios(statements.three_years(statements.load(frame(spark, rows)), F.lit(CUTOFF).cast("date"))).collect()}


def check(r):
    assert math.isclose(r.roa, 20 / 110) and math.isclose(r.roe, 20 / 65) and math.isclose(r.gross_margin, 75 / 160) and r.cash_conversion == 1.25 and r.core_profit_share == 0.9
    assert r.net_debt_to_cfo == 0.8 and r.interest_cover == 15 and math.isclose(r.revenue_cagr_2y, math.sqrt(1.6) - 1) and math.isclose(r.revenue_growth_yoy, 160 / 125 - 1)
    assert all(r[s] is True for s in statements.SIGNALS)


def test_hand_computed(spark):
    check(result(spark, history())["A"])


def test_units_order_repeats_and_the_future_do_not_matter(spark):
    later = [("a ", 2, payload(2, net_income=-999), datetime.date(2026, 6, 1)), ("A", 2, "broken", None)]
    rows = [*history(), *history(), *history("B", scale="10000"), *later][::-1]
    got = result(spark, rows)
    check(got["A"]), check(got["B"])
    assert got["B"].fcf == 20 * 10000


def test_later_version_holds(spark):
    got = result(spark, [*history(), ("A", 2, payload(2, net_income="-20"), datetime.date(2026, 4, 1))])
    assert got["A"].roa < 0 and got["A"].positive_roa is False and got["A"].cash_conversion is None


def test_unknowns_stay_unknown(spark):
    got = result(spark, history(operating_cash_flow="NA", equity_issued=""))["A"]
    assert got.cash_conversion is None and got.net_debt_to_cfo is None and got.fcf is None and got.positive_cfo is None and got.no_equity_issuance is None and got.roa is not None


def test_gaps_and_currencies(spark):
    assert result(spark, history()[:2]) == {}
    assert result(spark, [history()[0], history()[2]]) == {}
    assert result(spark, [*history()[:2], ("A", 2, payload(2, currency="HKD"), None)]) == {}
    assert result(spark, []) == {}
