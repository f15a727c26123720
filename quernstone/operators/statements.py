"""Annual statements as delivered: loaded, scaled, versions resolved, three years side by side, ratios and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.fields import MONEY_FIELDS, RATIOS, SIGNALS
from quernstone.functions import dates
from quernstone.functions import numeric as nm
from quernstone.operators import rejects, versions
from quernstone.operators.tickers import clean_ticker

#: Amounts of the last year that go with the ratios.
KEPT = ("core_income_parent", "interest_expense", "total_debt")


def load(df: DataFrame) -> DataFrame:
    """Typed rows of the payloads that load: ticker, days, currency, market, sector, revision, issued, and 16 amounts in single units.

    An amount whose text is unknown, or that overflows when scaled, is null;
    `overflow` tells the second from the first. A missing revision is 0.
    """
    failed = rejects.failures(rejects.parsed_objects(df, "statement_id", "payload_json"), "statements")
    m = F.from_json("payload_json", "map<string,string>")
    x = rejects.loadable(df, "statement_id", failed).withColumn("__m", m)
    value = lambda f: nm.number(F.col("__m")[f])
    return x.select(
        "statement_id", clean_ticker("ticker").alias("ticker"), "period_end", "available_at", F.col("__m")["currency"].alias("currency"),
        dates.strict_day(F.col("__m")["period_start"]).alias("period_start"), F.col("__m")["market"].alias("market"), F.col("__m")["sector"].alias("sector"),
        F.coalesce(value("revision_id"), F.lit(0.0)).cast("long").alias("revision"), value("equity_issued").alias("issued"),
        *[nm.finite(value(f) * value("unit_scale")).alias(f) for f in MONEY_FIELDS],
        reduce(lambda a, b: a | b, [value(f).isNotNull() & nm.finite(value(f) * value("unit_scale")).isNull() for f in MONEY_FIELDS]).alias("overflow"),
    )


def three_years(loaded: DataFrame, as_of: Column) -> DataFrame:
    """The newest visible year of each issuer with three consecutive ones in one currency, beside the two before it.

    A year's version is the one that became available last, then has the
    greatest revision, then the smallest id.
    """
    seen = versions.visible(loaded, as_of, own_day="period_end", pub_day="available_at")
    order = [F.col("available_at"), F.col("revision"), F.bitwise_not("statement_id")]
    year = versions.latest(seen, ["ticker", "period_end"], order, ["currency", "issued", *MONEY_FIELDS])
    t = versions.with_previous(year, ["ticker"], "period_end", ["period_end", "currency", *MONEY_FIELDS])
    follows = F.datediff("period_end", "period_end_1").between(350, 380) & F.datediff("period_end_1", "period_end_2").between(350, 380)
    t = t.where(follows & (F.col("currency") == F.col("currency_1")) & (F.col("currency_1") == F.col("currency_2")))
    return versions.latest(t, ["ticker"], [F.col("period_end")], [c for c in t.columns if c != "ticker"])


#: Why an issuer's last three years do not stand side by side, in the order of the checks.
HISTORY_FAULTS = ("overflow", "fewer_than_three_years", "period_length", "currency_changed", "classification_changed", "not_consecutive")


def history_faults(loaded: DataFrame, as_of: Column) -> DataFrame:
    """(ticker, years, period_end, fault) of every issuer with a visible year: the first fault of its last three years, null if there is none.

    Strict: each year lasts 350 to 380 days, both ends included, and begins on
    the day after the one before it ended; currency, market and sector stay.
    """
    seen = versions.visible(loaded, as_of, own_day="period_end", pub_day="available_at")
    order = [F.col("available_at"), F.col("revision"), F.bitwise_not("statement_id")]
    kept = ["period_start", "currency", "market", "sector", "overflow"]
    year = versions.latest(seen, ["ticker", "period_end"], order, kept)
    counts = year.groupBy("ticker").agg(F.count(F.lit(1)).alias("years"))
    t = versions.with_previous(year, ["ticker"], "period_end", ["period_end", *kept])
    last = versions.latest(t, ["ticker"], [F.col("period_end")], [c for c in t.columns if c != "ticker"]).join(counts, "ticker")
    every = lambda test: reduce(lambda a, b: a & b, [F.coalesce(test(s), F.lit(False)) for s in ("", "_1", "_2")])
    same = lambda c: F.coalesce((F.col(c) == F.col(f"{c}_1")) & (F.col(f"{c}_1") == F.col(f"{c}_2")), F.lit(False))
    follows = F.coalesce(dates.continues(F.col("period_start"), F.col("period_end_1")) & dates.continues(F.col("period_start_1"), F.col("period_end_2")), F.lit(False))
    fault = (
        F.when(F.col("years") < 3, "fewer_than_three_years").when(F.col("overflow") | F.col("overflow_1") | F.col("overflow_2"), "overflow")
        .when(~every(lambda s: dates.period_days(F.col(f"period_start{s}"), F.col(f"period_end{s}")).between(350, 380)), "period_length")
        .when(~same("currency"), "currency_changed").when(~(same("market") & same("sector")), "classification_changed").when(~follows, "not_consecutive")
    )
    return last.select("ticker", "years", "period_end", fault.alias("fault"))


def ratios(t: DataFrame) -> DataFrame:
    """(ticker, period_end, ratios, signals): null wherever an input is unknown or a denominator not positive."""
    v = F.col
    margin = lambda s: nm.divide(v(f"revenue{s}") - v(f"cogs{s}"), v(f"revenue{s}"))
    current = lambda s: nm.divide(v(f"current_assets{s}"), v(f"current_liabilities{s}"))
    leverage = lambda s, p: nm.divide(v(f"long_term_debt{s}"), nm.average(v(f"total_assets{s}"), v(f"total_assets{p}")))
    x = t.withColumns({
        "roa": nm.divide(v("net_income"), v("total_assets_1")),
        "roe": F.when((v("equity_parent") > 0) & (v("equity_parent_1") > 0), nm.divide(v("net_income_parent"), nm.average(v("equity_parent"), v("equity_parent_1")))),
        "gross_margin": margin(""), "cash_conversion": nm.divide(v("operating_cash_flow"), v("net_income")), "core_profit_share": nm.divide(v("core_income_parent"), v("net_income_parent")),
        "fcf": nm.difference(v("operating_cash_flow"), v("capex")), "revenue_cagr_2y": nm.cagr(v("revenue"), v("revenue_2")), "core_profit_cagr_2y": nm.cagr(v("core_income_parent"), v("core_income_parent_2")),
        "net_debt_to_cfo": nm.divide(v("total_debt") - v("cash"), v("operating_cash_flow")), "interest_cover": nm.divide(v("ebit"), v("interest_expense")), "current_ratio": current(""),
        "revenue_growth_yoy": nm.growth(v("revenue"), v("revenue_1")), "core_profit_growth_yoy": nm.growth(v("core_income_parent"), v("core_income_parent_1")),
        "__roa_1": nm.divide(v("net_income_1"), v("total_assets_2")), "__cfo": nm.divide(v("operating_cash_flow"), v("total_assets_1")),
    })
    turnover = nm.divide(v("revenue"), v("total_assets_1")) > nm.divide(v("revenue_1"), v("total_assets_2"))
    return x.withColumns({
        "positive_roa": v("roa") > 0, "positive_cfo": v("__cfo") > 0, "roa_improved": v("roa") > v("__roa_1"), "accruals_quality": v("__cfo") > v("roa"), "lower_leverage": leverage("", "_1") < leverage("_1", "_2"),
        "higher_current_ratio": v("current_ratio") > current("_1"), "no_equity_issuance": v("issued") == 0, "higher_gross_margin": v("gross_margin") > margin("_1"), "higher_asset_turnover": turnover,
    }).select("ticker", "period_end", "currency", *KEPT, *RATIOS, *SIGNALS)
