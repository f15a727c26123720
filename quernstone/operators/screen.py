"""The peer screen: ratios beside the newest known value of the issuer, percentiles among peers, blocks, score.

Percentiles compare keys, not raw ratios: a key has 12 significant digits, so
that noise of a change of units parts no equals; two ratios are capped for
ranking alone; and an issuer without debt and interest ranks above every finite
interest cover. Reported ratios stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import numeric as nm
from quernstone.operators import peers, ranks, versions
from quernstone.operators.tickers import clean_ticker

#: The blocks and whether more is better, their weights, and the caps of ranking.
BLOCKS = {
    "quality": {"roe": True, "cash_conversion": True, "core_profit_share": True},
    "value": {"core_earnings_yield": True, "fcf_yield": True},
    "growth": {"revenue_cagr_2y": True, "core_profit_cagr_2y": True},
    "balance": {"net_debt_to_cfo": False, "interest_cover": True},
}
WEIGHTS = {"quality": 0.4, "value": 0.25, "growth": 0.2, "balance": 0.15}
CAPS = {"cash_conversion": 2.0, "core_profit_share": 1.0}
LEAST_PEERS = 5


def newest_known(valuations: DataFrame, as_of: Column) -> DataFrame:
    """One row of valuations per ticker: the newest one visible at the cutoff, whole. Null days are never visible.

    Order: snapshot day, publication day, revision (unknown below all), smallest id.
    """
    seen = versions.visible(valuations.withColumn("ticker", clean_ticker("ticker")), as_of, own_day="snapshot_date", pub_day="available_at")
    order = [F.col("snapshot_date"), F.col("available_at"), F.coalesce(F.col("revision_id").cast("long"), F.lit(-(2**63)).cast("long")), F.bitwise_not(F.col("valuation_id").cast("long"))]
    return versions.latest(seen.where("ticker is not null"), ["ticker"], order, [c for c in valuations.columns if c != "ticker"])


def with_yields(ratios: DataFrame, values: DataFrame) -> DataFrame:
    """Ratios beside `cap`, the issuer's value in the currency of its statements, and the two yields on it.

    values: (ticker, cap, cap_currency). A value in another currency than the
    statements counts as unknown.
    """
    x = ratios.join(values, "ticker", "left")
    cap = F.when(F.col("cap_currency") == F.col("currency"), F.col("cap"))
    return x.withColumn("cap", cap).withColumns({"core_earnings_yield": nm.divide(F.col("core_income_parent"), F.col("cap")), "fcf_yield": nm.divide(F.col("fcf"), F.col("cap"))}).drop("cap_currency")


def rank_keys() -> dict[str, Column]:
    """What the percentile of each ratio compares."""
    keys = {}
    for parts in BLOCKS.values():
        for m in parts:
            value = nm.capped(F.col(m), CAPS[m]) if m in CAPS else F.col(m)
            keys[f"{m}_key"] = nm.rank_key(value)
    # only for the order; no ratio becomes infinite
    free = (F.col("interest_expense") == 0) & (F.col("total_debt") == 0)
    keys["interest_cover_key"] = F.when(free, F.lit(float("inf"))).otherwise(keys["interest_cover_key"])
    return keys


def scored(metrics: DataFrame, cohort: Sequence[str], key: str = "ticker", *, weights: Mapping[str, float] = WEIGHTS, least: int = LEAST_PEERS) -> DataFrame:
    """metrics with {ratio}_pct, one column per block, score, peers and metric_coverage.

    A block is the mean of its percentiles and null unless all are known; the
    score is null unless every block with a weight is. An issuer free of debt
    and interest counts as covered for its interest.
    """
    keys = rank_keys()
    higher = {f"{m}_key": up for parts in BLOCKS.values() for m, up in parts.items()}
    x = ranks.midranks(metrics.withColumns(keys), key, cohort, higher, least=least)
    x = x.withColumns({f"{m}_pct": F.col(f"{m}_key_pct") for parts in BLOCKS.values() for m in parts}).drop(*[f"{k}_pct" for k in higher])
    x = x.withColumns({b: peers.block(*[f"{m}_pct" for m in parts]) for b, parts in BLOCKS.items()}).withColumn("score", peers.composite(weights))
    active = [m for b, parts in BLOCKS.items() if weights.get(b, 0) > 0 for m in parts]
    known = sum((F.col(f"{m}_key").isNotNull().cast("int") for m in active), F.lit(0))
    counts = metrics.groupBy(*cohort).agg(F.count(F.lit(1)).alias("peers"))
    return x.withColumn("metric_coverage", known / len(active)).drop(*higher).join(counts, list(cohort), "left")


def f_score(signals: Sequence[str]) -> dict[str, Column]:
    """f_score_lower_bound, f_score_known, and f_score where all signals are known."""
    passed = sum((F.coalesce(F.col(s).cast("int"), F.lit(0)) for s in signals), F.lit(0))
    known = sum((F.col(s).isNotNull().cast("int") for s in signals), F.lit(0))
    return {"f_score_lower_bound": passed, "f_score_known": known, "f_score": F.when(known == len(signals), passed)}


def validate(weights: Mapping[str, float], *, least: int = LEAST_PEERS) -> None:
    """Refuse unknown or missing blocks, weights that are negative or do not sum to 1, and too few peers."""
    if set(weights) != set(BLOCKS):
        raise ValueError(f"weights are needed for exactly {', '.join(BLOCKS)}")
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w < float("inf") for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights are finite, not negative, and sum to 1")
    if isinstance(least, bool) or not isinstance(least, int) or least < 2:
        raise ValueError("at least two peers are needed")
