"""The peer screen over delivered statements and valuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.fields import METRICS, SIGNALS
from quernstone.operators import screen, statements, units
from quernstone.operators.screen import BLOCKS, CAPS, LEAST_PEERS, WEIGHTS
from quernstone.operators.tickers import clean_ticker
from quernstone.plans.delivery_sql import _VALUED
from quernstone.plans.filings import _LOADED, _THREE, AS_OF
from quernstone.session import settled, table

_MONEY = {"fcf"}


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row per issuer with three years: ratios, signals, yields on its newest known value, market and sector."""
    as_of = F.lit(AS_OF).cast("date")
    companies = table(spark, d, "companies")
    r = statements.ratios(statements.three_years(statements.load(table(spark, d, "statements")), as_of))
    newest = screen.newest_known(table(spark, d, "valuations"), as_of)
    cap = units.by_rule(units.read_amounts(newest, companies, table(spark, d, "fx_rates"))).select("valuation_id", "amount", "reporting_currency")
    values = newest.select("valuation_id", "ticker", F.col("snapshot_date").alias("valued_on")).join(cap, "valuation_id").select("ticker", "valued_on", F.col("amount").alias("cap"), F.col("reporting_currency").alias("cap_currency"))
    c = companies.select(clean_ticker("ticker").alias("ticker"), "market", "sector").dropDuplicates(["ticker"])
    return screen.with_yields(r, values).join(c, "ticker", "left")


def _scored(spark: SparkSession, d: str, cohort: list[str]) -> DataFrame:
    # read for the percentiles, the counts and the answer
    return screen.scored(settled(_metrics(spark, d)), cohort)


def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("ticker", "market", "sector", "period_end", "valued_on", *[(F.round(m, 2 if m in _MONEY else 6) + 0.0).alias(m) for m in METRICS])


def _answer(x: DataFrame) -> DataFrame:
    return x.withColumns(screen.f_score(SIGNALS)).select(
        "ticker", "market", "sector", "peers", *[F.round(b, 4).alias(b) for b in BLOCKS], F.round("score", 4).alias("score"), F.round("metric_coverage", 6).alias("metric_coverage"), "f_score_lower_bound", "f_score_known", "f_score")


def q_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores among the issuers of one market and sector."""
    return _answer(_scored(spark, d, ["market", "sector"]))


def q_market(spark: SparkSession, d: str) -> DataFrame:
    """Scores among all issuers of one market."""
    return _answer(_scored(spark, d, ["market"]))


def q_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Issuers by market, then falling score, unknown scores last."""
    x = _answer(_scored(spark, d, ["market"]))
    return x.select("market", "ticker", "score").orderBy("market", F.desc_nulls_last("score"), "ticker")


def q_faults(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of each issuer's last three years, by the strict rule of consecutive days."""
    return statements.history_faults(statements.load(table(spark, d, "statements")), F.lit(AS_OF).cast("date"))


QUERIES = {"screen_metrics": q_metrics, "screen_scores": q_scores, "screen_market_scores": q_market, "screen_market_ranked": q_ranked, "history_faults": q_faults}

_METRICS_SQL = f"""{_THREE}, {_VALUED},
    newest AS (SELECT valuation_id, upper(trim(ticker)) AS ticker, snapshot_date FROM valuations WHERE snapshot_date <= DATE '{AS_OF}' AND available_at <= DATE '{AS_OF}'
               QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY snapshot_date DESC, available_at DESC, revision_id DESC NULLS LAST, valuation_id) = 1),
    priced AS (SELECT n.ticker, n.snapshot_date AS valued_on, v.amount, v.reporting FROM newest n JOIN valued v USING (valuation_id)),
    m0 AS (SELECT r.*, c.market, c.sector, p.valued_on, CASE WHEN p.reporting = r.currency THEN p.amount END AS cap FROM ratios r LEFT JOIN priced p ON p.ticker = r.ticker LEFT JOIN companies c ON upper(trim(c.ticker)) = r.ticker),
    m1 AS (SELECT *, CASE WHEN cap > 0 THEN core_income_parent / cap END AS core_earnings_yield, CASE WHEN cap > 0 THEN fcf / cap END AS fcf_yield FROM m0)"""


def _key_sql(m: str) -> str:
    value = f"least({m}, {CAPS[m]})" if m in CAPS else m
    key = f"CASE WHEN {m} IS NOT NULL THEN printf('%.11e', {value})::DOUBLE + 0.0 END"
    if m == "interest_cover":
        key = f"CASE WHEN interest_expense = 0 AND total_debt = 0 THEN 'inf'::DOUBLE ELSE {key} END"
    return f"{key} AS {m}_key"


def _pct_sql(m: str, higher: bool, cohort: str) -> str:
    k = f"{m}_key"
    part = f"PARTITION BY {cohort}, ({k} IS NOT NULL)"
    n, ties = f"count({k}) OVER ({part})", f"count({k}) OVER ({part}, {k})"
    percent = f"CASE WHEN {n} = {ties} THEN 50.0 ELSE (rank() OVER ({part} ORDER BY {k}) - 1 + ({ties} - 1) / 2.0) / ({n} - 1) * 100 END"
    return f"CASE WHEN {k} IS NOT NULL AND {n} >= {LEAST_PEERS} THEN {percent if higher else f'100 - {percent}'} END AS {m}_pct"


def _scores_sql(cohort: str) -> str:
    every = [(m, up) for parts in BLOCKS.values() for m, up in parts.items()]
    return f"""WITH {_METRICS_SQL},
    keyed AS (SELECT *, {', '.join(_key_sql(m) for m, _ in every)} FROM m1),
    pct AS (SELECT *, count(*) OVER (PARTITION BY {cohort}) AS peers, {', '.join(_pct_sql(m, up, cohort) for m, up in every)} FROM keyed),
    blocks AS (SELECT *, {', '.join(f"({' + '.join(f'{m}_pct' for m in parts)}) / {len(parts)} AS {b}" for b, parts in BLOCKS.items())} FROM pct),
    answer AS (SELECT ticker, market, sector, peers, {', '.join(f'round({b}, 4) AS {b}' for b in BLOCKS)}, round({' + '.join(f'{b} * {w}' for b, w in WEIGHTS.items())}, 4) AS score,
        round(({' + '.join(f'({m}_key IS NOT NULL)::INT' for m, _ in every)}) / {len(every)}.0::DOUBLE, 6) AS metric_coverage,
        CAST({' + '.join(f'coalesce({s}::INT, 0)' for s in SIGNALS)} AS INT) AS f_score_lower_bound, CAST({' + '.join(f'({s} IS NOT NULL)::INT' for s in SIGNALS)} AS INT) AS f_score_known,
        CASE WHEN {' AND '.join(f'{s} IS NOT NULL' for s in SIGNALS)} THEN CAST({' + '.join(f'coalesce({s}::INT, 0)' for s in SIGNALS)} AS INT) END AS f_score FROM blocks)"""


_TEXT = lambda f: f"json_extract_string(s.payload_json, '$.{f}')"
SQL = {
    "screen_metrics": f"WITH {_METRICS_SQL} SELECT ticker, market, sector, period_end, valued_on, {', '.join(f'round({m}, {2 if m in _MONEY else 6}) + 0.0 AS {m}' for m in METRICS)} FROM m1",
    "screen_scores": f"{_scores_sql('market, sector')} SELECT * FROM answer",
    "screen_market_scores": f"{_scores_sql('market')} SELECT * FROM answer",
    "screen_market_ranked": f"{_scores_sql('market')} SELECT market, ticker, score FROM answer ORDER BY market, score DESC NULLS LAST, ticker",
    "history_faults": f"""WITH {_LOADED},
        placed AS (SELECT l.ticker, l.statement_id, l.period_end, l.available_at, l.revision, l.currency, CAST({_TEXT('period_start')} AS DATE) AS period_start, {_TEXT('market')} AS market, {_TEXT('sector')} AS sector FROM loaded l JOIN statements s USING (statement_id)),
        year AS (SELECT * FROM placed WHERE period_end <= DATE '{AS_OF}' AND available_at <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY available_at DESC, revision DESC, statement_id) = 1),
        beside AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS years, {', '.join(f'lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY period_end) AS {c}_{n}' for n in (1, 2) for c in ('period_end', 'period_start', 'currency', 'market', 'sector'))} FROM year),
        last AS (SELECT * FROM beside QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) = 1)
        SELECT ticker, years, period_end, CASE WHEN years < 3 THEN 'fewer_than_three_years'
            WHEN NOT ({' AND '.join(f"period_end{s} - period_start{s} + 1 BETWEEN 350 AND 380" for s in ('', '_1', '_2'))}) THEN 'period_length'
            WHEN currency <> currency_1 OR currency_1 <> currency_2 THEN 'currency_changed' WHEN market <> market_1 OR market_1 <> market_2 OR sector <> sector_1 OR sector_1 <> sector_2 THEN 'classification_changed'
            WHEN period_start <> period_end_1 + 1 OR period_start_1 <> period_end_2 + 1 THEN 'not_consecutive' END AS fault FROM last""",
}
