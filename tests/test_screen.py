"""The peer screen by hand: keys, caps, order of interest cover, midranks, histories, newest values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quernstone.functions import numeric
from quernstone.operators import screen, statements

NUMBERS = [m for parts in screen.BLOCKS.values() for m in parts]
FIELDS = "ticker string, market string, interest_expense double, total_debt double, " + ", ".join(f"{m} double" for m in NUMBERS)


def rows(spark, changes):
    """Issuers that differ in the stated ratios only."""
    base = {m: 0.1 for m in NUMBERS} | {"market": "A", "interest_expense": 1.0, "total_debt": 1.0}
    names = ["ticker", "market", "interest_expense", "total_debt", *NUMBERS]
    return spark.createDataFrame([tuple((base | {"ticker": f"T{i}"} | c)[n] for n in names) for i, c in enumerate(changes)], FIELDS)


def pct(spark, metric, values, **more):
    got = screen.scored(rows(spark, [{metric: v, **more} for v in values]), ["market"]).collect()
    return [r[f"{metric}_pct"] for r in sorted(got, key=lambda r: int(r.ticker[1:]))]


def test_rank_key_hides_noise_and_keeps_differences(spark):
    xs = [1.0, 1.0 + 2e-16, 0.1234567891, 0.1234567892, None, math.inf, -0.0, 123456789012345.0, 1e-300]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.rank_key(F.col("x"))).collect()]
    assert got[0] == got[1] == 1.0 and got[2] != got[3] and got[4] is None and got[5] == math.inf and str(got[6]) == "0.0"
    assert got[7] == 123456789012000.0 and got[8] == 1e-300


def test_percentiles(spark):
    assert pct(spark, "roe", [1.0, 2.0, 2.0, 3.0, 4.0]) == [0.0, 37.5, 37.5, 75.0, 100.0]
    assert pct(spark, "net_debt_to_cfo", [1.0, 2.0, 3.0, 4.0, 5.0]) == [100.0, 75.0, 50.0, 25.0, 0.0]
    assert pct(spark, "roe", [2.0] * 5) == [50.0] * 5
    assert pct(spark, "roe", [1.0, 2.0, 3.0, 4.0, None]) == [None] * 5  # too few peers
    assert pct(spark, "roe", [0.3, 0.1 + 0.2, 0.4, 0.5, 0.6])[:2] == [12.5, 12.5]  # equal but for noise


def test_caps_only_rank(spark):
    assert pct(spark, "cash_conversion", [1.0, 2.0, 9.0, 50.0, 1.5]) == [0.0, 75.0, 75.0, 75.0, 25.0]
    x = screen.scored(rows(spark, [{"cash_conversion": v} for v in (1.0, 2.0, 9.0, 50.0, 1.5)]), ["market"])
    assert max(r.cash_conversion for r in x.collect()) == 50.0


def test_free_of_debt_ranks_above_every_cover(spark):
    free = {"interest_expense": 0.0, "total_debt": 0.0, "interest_cover": None}
    changes = [{"interest_cover": 1.0}, {"interest_cover": 1e9}, {"interest_cover": 3.0}, free, free, {"interest_expense": 0.0, "total_debt": 5.0, "interest_cover": None}]
    got = {r.ticker: r for r in screen.scored(rows(spark, changes), ["market"]).collect()}
    assert [got[f"T{i}"].interest_cover_pct for i in range(6)] == [0.0, 50.0, 25.0, 87.5, 87.5, None]
    assert got["T3"].interest_cover is None and got["T3"].metric_coverage == 1.0 and got["T5"].metric_coverage < 1.0 and got["T5"].score is None


def test_blocks_and_score(spark):
    got = screen.scored(rows(spark, [{"roe": float(i)} for i in range(5)]), ["market"]).orderBy("ticker").collect()
    assert [r.quality for r in got] == pytest.approx([(i * 25 + 100) / 3 for i in range(5)])
    assert [r.score for r in got] == pytest.approx([0.4 * (i * 25 + 100) / 3 + 0.6 * 50 for i in range(5)]) and {r.peers for r in got} == {5}
    assert screen.scored(rows(spark, [{}] * 5).limit(0), ["market"]).count() == 0


def test_configuration():
    screen.validate(screen.WEIGHTS)
    for bad in ({**screen.WEIGHTS, "quality": 0.5}, {"quality": 1.0}, {**screen.WEIGHTS, "x": 0.0}, {**screen.WEIGHTS, "quality": 0.65, "value": -0.0 - 0.0, "growth": 0.2, "balance": float("nan")}):
        with pytest.raises(ValueError):
            screen.validate(bad)
    for least in (1, True, 2.5):
        with pytest.raises(ValueError):
            screen.validate(screen.WEIGHTS, least=least)


def test_newest_known(spark):
    d = datetime.date
    v = spark.createDataFrame([
        (1, " a", d(2024, 1, 1), d(2024, 1, 2), 1), (2, "A", d(2024, 1, 1), d(2024, 1, 2), 2), (3, "A", d(2024, 1, 1), d(2024, 1, 2), 2), (4, "A", d(2024, 3, 1), d(2024, 9, 9), 2),
        (5, "A", d(2024, 9, 1), d(2024, 2, 1), 2), (6, "A", None, d(2024, 2, 1), 2), (7, None, d(2024, 1, 1), d(2024, 1, 1), 1), (8, "B", d(2024, 1, 1), d(2024, 1, 1), None),
    ], "valuation_id bigint, ticker string, snapshot_date date, available_at date, revision_id bigint")
    got = {r.ticker: r.valuation_id for r in screen.newest_known(v, F.lit("2024-06-30").cast("date")).collect()}
    assert got == {"A": 2, "B": 8}


def test_yields_need_one_currency(spark):
    r = spark.createDataFrame([("A", "CNY", 5.0, 2.0), ("B", "CNY", 5.0, 2.0), ("C", "CNY", 5.0, 2.0)], "ticker string, currency string, core_income_parent double, fcf double")
    v = spark.createDataFrame([("A", 100.0, "CNY"), ("B", 100.0, "HKD")], "ticker string, cap double, cap_currency string")
    got = {x.ticker: (x.core_earnings_yield, x.fcf_yield) for x in screen.with_yields(r, v).collect()}
    assert got == {"A": (0.05, 0.02), "B": (None, None), "C": (None, None)}


def test_history_faults(spark):
    d = datetime.date
    schema = "statement_id bigint, ticker string, period_start date, period_end date, available_at date, revision bigint, currency string, market string, sector string, overflow boolean"
    year = lambda t, y, i, **c: tuple(({"id": i, "t": t, "s": d(y, 1, 1), "e": d(y, 12, 31), "a": d(y + 1, 3, 1), "r": 1, "c": "CNY", "m": "A", "x": "X", "o": False} | c).values())
    data, i = [], 0
    for t, changes in {"ok": ({}, {}, {}), "few": ({}, {}), "short": ({}, {"s": d(2021, 3, 1)}, {}), "money": ({}, {"c": "HKD"}, {}), "moved": ({"x": "Y"}, {}, {}), "gap": ({"e": d(2020, 12, 30)}, {}, {}), "big": ({}, {}, {"o": True})}.items():
        for n, c in enumerate(changes):
            i += 1
            data.append(year(t, 2020 + n, i, **c))
    got = {r.ticker: r.fault for r in statements.history_faults(spark.createDataFrame(data, schema), F.lit("2030-01-01").cast("date")).collect()}
    assert got == {"ok": None, "few": "fewer_than_three_years", "short": "period_length", "money": "currency_changed", "moved": "classification_changed", "gap": "not_consecutive", "big": "overflow"}
