"""Annual records per customer: versions of years side by side, ratios, signals, peers, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.fields import METRICS, SIGNALS
from quernstone.functions import numeric as nm
from quernstone.operators import evaluation, peers, ranks, versions
from quernstone.session import table

ITEMS = ("revenue", "cogs", "tax", "qty", "orders")
BLOCKS = {"quality": ("roe", "cash_conversion"), "growth": ("revenue_cagr_2y", "core_profit_cagr_2y"), "balance": ("net_debt_to_cfo", "interest_cover")}
WEIGHTS = {"quality": 0.5, "growth": 0.3, "balance": 0.2}
LOWER_IS_BETTER = {"net_debt_to_cfo"}


def years(spark: SparkSession, d: str) -> DataFrame:
    """(ck, yr, items): order lines summed in whole cents, so that sums do not depend on their order."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ck"), F.year("o_orderdate").alias("yr"))
    cents, pct = F.round(F.col("l_extendedprice") * 100).cast("long"), lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(spark, d, "lineitem").select("l_orderkey", (cents * (100 - pct("l_discount"))).alias("rev"), (cents * 60).alias("cost"), (cents * pct("l_tax")).alias("t"), F.col("l_quantity").cast("long").alias("q"))
    s = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("ck", "yr").agg(F.sum("rev").alias("rev"), F.sum("cost").alias("cost"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("orders"))
    return s.select("ck", "yr", (F.col("rev") / 10000.0).alias("revenue"), (F.col("cost") / 10000.0).alias("cogs"), (F.col("t") / 10000.0).alias("tax"), F.col("q").cast("double").alias("qty"), "orders")


YEARS_SQL = """
    lines AS (SELECT o.o_custkey AS ck, year(o.o_orderdate) AS yr, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS dc,
                     CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS q
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
    years AS (SELECT ck, yr, CAST(sum(c * (100 - dc)) AS DOUBLE) / 10000.0 AS revenue, CAST(sum(c * 60) AS DOUBLE) / 10000.0 AS cogs, CAST(sum(c * t) AS DOUBLE) / 10000.0 AS tax,
                     CAST(sum(q) AS DOUBLE) AS qty, count(*) AS orders FROM lines GROUP BY ck, yr),
    three AS (SELECT *, """ + ", ".join(f"lag({c}, {n}) OVER (PARTITION BY ck ORDER BY yr) AS {c}_{n}" for n in (1, 2) for c in ("yr", *ITEMS)) + " FROM years)"


def three_years(spark: SparkSession, d: str) -> DataFrame:
    return versions.with_previous(years(spark, d), ["ck"], "yr", ["yr", *ITEMS])


# Items of an annual record, written once for both engines: they are sums and products only.
_RECORD = {
    "ni": "revenue{s} - cogs{s} - 2 * tax{s}", "assets": "qty{s} * 1500", "equity": "qty{s} * 600 - tax{s}", "ca": "revenue{s} * 0.4", "cl": "cogs{s} * 0.3",
    "ltd": "qty{s} * 200 - tax{s}", "debt": "qty{s} * 300", "cash": "tax{s} * 3", "cfo": "revenue{s} * 0.25 - tax{s} * 3", "capex": "qty{s} * 40", "ebit": "revenue{s} - cogs{s}", "interest": "tax{s} * 0.5",
}


def _records() -> dict[str, str]:
    return {f"{n}{s}": e.format(s=s) for s in ("", "_1", "_2") for n, e in _RECORD.items()}


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with three consecutive years: metrics, signals and cohort of the last."""
    t = three_years(spark, d).where("yr = yr_1 + 1 and yr_1 = yr_2 + 1")
    t = versions.latest(t, ["ck"], [F.col("yr")], [c for c in t.columns if c != "ck"])
    t = t.withColumns({n: F.expr(e) for n, e in _records().items()})
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ck"), "c_nationkey", F.col("c_acctbal").alias("cap"), F.col("c_mktsegment").alias("segment"))
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    t = t.join(c, "ck").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    v = lambda x: F.col(x)
    core = {s: v(f"ni{s}") * 0.9 for s in ("", "_1", "_2")}
    m = {
        "roa": nm.divide(v("ni"), v("assets_1")), "roe": F.when((v("equity") > 0) & (v("equity_1") > 0), nm.divide(v("ni"), nm.average(v("equity"), v("equity_1")))),
        "gross_margin": nm.divide(v("revenue") - v("cogs"), v("revenue")), "cash_conversion": nm.divide(v("cfo"), v("ni")), "core_profit_share": nm.divide(core[""], v("ni")),
        "fcf": nm.difference(v("cfo"), v("capex")), "core_earnings_yield": nm.divide(core[""], v("cap")), "fcf_yield": nm.divide(v("cfo") - v("capex"), v("cap")),
        "revenue_cagr_2y": nm.cagr(v("revenue"), v("revenue_2")), "core_profit_cagr_2y": nm.cagr(core[""], core["_2"]), "net_debt_to_cfo": nm.divide(v("debt") - v("cash"), v("cfo")),
        "interest_cover": nm.divide(v("ebit"), v("interest")), "current_ratio": nm.divide(v("ca"), v("cl")), "revenue_growth_yoy": nm.growth(v("revenue"), v("revenue_1")),
        "core_profit_growth_yoy": nm.growth(core[""], core["_1"]),
    }
    h = {
        "cfo_assets": nm.divide(v("cfo"), v("assets_1")), "lev": nm.divide(v("ltd"), nm.average(v("assets"), v("assets_1"))), "lev_1": nm.divide(v("ltd_1"), nm.average(v("assets_1"), v("assets_2"))),
        "turn": nm.divide(v("revenue"), v("assets_1")), "turn_1": nm.divide(v("revenue_1"), v("assets_2")), "roa_1": nm.divide(v("ni_1"), v("assets_2")),
        "cr_1": nm.divide(v("ca_1"), v("cl_1")), "gm_1": nm.divide(v("revenue_1") - v("cogs_1"), v("revenue_1")),
    }
    x = t.select("ck", "yr", "region", "segment", "orders", *[e.alias(k) for k, e in {**m, **h}.items()])
    return x.withColumns({
        "positive_roa": v("roa") > 0, "positive_cfo": v("cfo_assets") > 0, "roa_improved": v("roa") > v("roa_1"), "accruals_quality": v("cfo_assets") > v("roa"), "lower_leverage": v("lev") < v("lev_1"),
        "higher_current_ratio": v("current_ratio") > v("cr_1"), "no_equity_issuance": F.when(v("orders") % 5 != 0, v("orders") % 2 == 0), "higher_gross_margin": v("gross_margin") > v("gm_1"),
        "higher_asset_turnover": v("turn") > v("turn_1"),
    })


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


def _avg(a: str, b: str) -> str:
    return f"({a} / 2 + {b} / 2)"


_METRIC_SQL = {
    "roa": _div("ni", "assets_1"), "roe": f"CASE WHEN equity > 0 AND equity_1 > 0 THEN {_div('ni', _avg('equity', 'equity_1'))} END", "gross_margin": _div("revenue - cogs", "revenue"),
    "cash_conversion": _div("cfo", "ni"), "core_profit_share": _div("ni * 0.9", "ni"), "fcf": "cfo - capex", "core_earnings_yield": _div("ni * 0.9", "cap"), "fcf_yield": _div("cfo - capex", "cap"),
    "revenue_cagr_2y": "CASE WHEN revenue > 0 AND revenue_2 > 0 THEN exp((ln(revenue) - ln(revenue_2)) / 2) - 1 END",
    "core_profit_cagr_2y": "CASE WHEN ni > 0 AND ni_2 > 0 THEN exp((ln(ni * 0.9) - ln(ni_2 * 0.9)) / 2) - 1 END", "net_debt_to_cfo": _div("debt - cash", "cfo"),
    "interest_cover": _div("ebit", "interest"), "current_ratio": _div("ca", "cl"), "revenue_growth_yoy": _div("revenue", "revenue_1") + " - 1", "core_profit_growth_yoy": _div("ni * 0.9", "ni_1 * 0.9") + " - 1",
    "cfo_assets": _div("cfo", "assets_1"), "lev": _div("ltd", _avg("assets", "assets_1")), "lev_1": _div("ltd_1", _avg("assets_1", "assets_2")), "turn": _div("revenue", "assets_1"),
    "turn_1": _div("revenue_1", "assets_2"), "roa_1": _div("ni_1", "assets_2"), "cr_1": _div("ca_1", "cl_1"), "gm_1": _div("revenue_1 - cogs_1", "revenue_1"),
}
_SIGNAL_SQL = {
    "positive_roa": "roa > 0", "positive_cfo": "cfo_assets > 0", "roa_improved": "roa > roa_1", "accruals_quality": "cfo_assets > roa", "lower_leverage": "lev < lev_1", "higher_current_ratio": "current_ratio > cr_1",
    "no_equity_issuance": "CASE WHEN orders % 5 <> 0 THEN orders % 2 = 0 END", "higher_gross_margin": "gross_margin > gm_1", "higher_asset_turnover": "turn > turn_1",
}
METRICS_SQL = f"""WITH {YEARS_SQL},
    last AS (SELECT * FROM three WHERE yr = yr_1 + 1 AND yr_1 = yr_2 + 1 QUALIFY row_number() OVER (PARTITION BY ck ORDER BY yr DESC) = 1),
    records AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _records().items())} FROM last),
    placed AS (SELECT records.*, c_acctbal AS cap, c_mktsegment AS segment, r_name AS region FROM records JOIN customer ON ck = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    m0 AS (SELECT ck, yr, region, segment, orders, {', '.join(f'{e} AS {n}' for n, e in _METRIC_SQL.items())} FROM placed),
    metrics AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SIGNAL_SQL.items())} FROM m0)"""


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("ck", "yr", *[_r(m, 2 if m == "fcf" else 6) for m in METRICS])


def q_signals(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("ck", *SIGNALS)


def q_f_score(spark: SparkSession, d: str) -> DataFrame:
    passed = sum((F.coalesce(F.col(s).cast("int"), F.lit(0)) for s in SIGNALS), F.lit(0))
    known = sum((F.col(s).isNotNull().cast("int") for s in SIGNALS), F.lit(0))
    x = metrics(spark, d).select("ck", passed.alias("lower_bound"), known.alias("known"))
    return x.withColumn("f_score", F.when(F.col("known") == len(SIGNALS), F.col("lower_bound")))


def q_history(spark: SparkSession, d: str) -> DataFrame:
    """Years of a customer that do not follow the year before them."""
    return three_years(spark, d).where("yr_1 is not null and yr <> yr_1 + 1").select("ck", "yr", F.col("yr_1").alias("previous"))


_COHORT = ["region", "segment"]


def _blocks(df: DataFrame) -> DataFrame:
    measures = sorted({m for ms in BLOCKS.values() for m in ms})
    # noise in the last places must not part equal values
    df = ranks.midranks(df.withColumns({m: nm.rank_key(F.col(m)) for m in measures}), "ck", _COHORT, {m: m not in LOWER_IS_BETTER for m in measures})
    return df.withColumns({b: peers.block(*[f"{m}_pct" for m in ms]) for b, ms in BLOCKS.items()}).withColumn("score", peers.composite(WEIGHTS))


def _pct_sql(m: str) -> str:
    known = f"({m} IS NOT NULL)"
    part = f"PARTITION BY region, segment, {known}"
    n, ties = f"count({m}) OVER ({part})", f"count({m}) OVER ({part}, {m})"
    percent = f"CASE WHEN {n} = {ties} THEN 50.0 ELSE (rank() OVER ({part} ORDER BY {m}) - 1 + ({ties} - 1) / 2.0) / ({n} - 1) * 100 END"
    percent = f"100 - {percent}" if m in LOWER_IS_BETTER else percent
    return f"CASE WHEN {known} AND {n} >= 5 THEN {percent} END AS {m}_pct"


_RANKED = sorted({m for ms in BLOCKS.values() for m in ms})
BLOCKS_SQL = f"""{METRICS_SQL},
    keyed AS (SELECT * REPLACE ({', '.join(f"printf('%.11e', {m})::DOUBLE + 0.0 AS {m}" for m in _RANKED)}) FROM metrics),
    pct AS (SELECT *, {', '.join(map(_pct_sql, _RANKED))} FROM keyed),
    blocks AS (SELECT *, {', '.join(f"({' + '.join(f'{m}_pct' for m in ms)}) / {len(ms)} AS {b}" for b, ms in BLOCKS.items())} FROM pct),
    scored AS (SELECT *, {' + '.join(f'{b} * {w}' for b, w in WEIGHTS.items())} AS score FROM blocks)"""


def q_midrank(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(metrics(spark, d)).select("ck", *[_r(f"{m}_pct", 4) for m in _RANKED])


def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(metrics(spark, d)).select("ck", *[_r(b, 4) for b in BLOCKS], _r("score", 4))


def q_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(metrics(spark, d)).select("ck", "region", "segment", _r("score", 4)).orderBy("region", "segment", F.desc_nulls_last("score"), "ck")


def q_peer_count(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).groupBy(*_COHORT).agg(F.count(F.lit(1)).alias("peers"), F.count("roe").alias("with_roe"))


def q_outliers(spark: SparkSession, d: str) -> DataFrame:
    return peers.mad_outlier(metrics(spark, d), _COHORT, "roe", limit=3.0).select("ck", "roe_outlier")


def q_quantiles(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).select(*_COHORT, "roe")
    q = ranks.quantiles(m, _COHORT, ["roe"], (0.25, 0.5, 0.75, 0.95))
    cohorts = m.select(*_COHORT).distinct().withColumn("__g", ranks.group_key(_COHORT))
    return cohorts.join(q, "__g", "left").select(*_COHORT, *[F.round(F.col("roe_q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75", "q95"))])


def q_metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    known = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    return metrics(spark, d).select("ck", F.round(known / len(METRICS), 6).alias("coverage"))


def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).select("region", F.round("roe", 9).alias("a"), F.round("revenue_cagr_2y", 9).alias("b"))
    return evaluation.spearman(m, ["region"], "a", "b").select("region", "n", F.round("rho", 6).alias("rho"))


def configurations(spark: SparkSession) -> DataFrame:
    """The grid: weight profiles by gates, one row each; a fixed number of rows."""
    profiles = spark.createDataFrame([("base", 0.5, 0.3, 0.2), ("quality", 0.7, 0.2, 0.1), ("growth", 0.2, 0.6, 0.2), ("balance", 0.2, 0.2, 0.6)], "profile string, wq double, wg double, wb double")
    gates = spark.createDataFrame([(a, float(b), c) for a in (0.0, 0.02, 0.05) for b in (2, 4) for c in (50.0, 65.0)], "min_roe double, max_debt double, min_score double")
    return profiles.crossJoin(gates)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration over one screen: percentiles do not depend on gates or weights."""
    b = _blocks(metrics(spark, d)).select("ck", "roe", "net_debt_to_cfo", *BLOCKS)
    score = F.col("quality") * F.col("wq") + F.col("growth") * F.col("wg") + F.col("balance") * F.col("wb")
    x = b.crossJoin(F.broadcast(configurations(spark))).withColumn("s", F.round(score, 6))
    return x.withColumn("chosen", F.coalesce((F.col("roe") >= F.col("min_roe")) & (F.col("net_debt_to_cfo") <= F.col("max_debt")) & (F.col("s") >= F.col("min_score")), F.lit(False)))


_CONFIG = ["profile", "min_roe", "max_debt", "min_score"]


def q_grid(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).groupBy(*_CONFIG).agg(F.count_if("chosen").alias("chosen"), F.round(F.avg(F.when(F.col("chosen"), F.col("s"))), 4).alias("mean_score"))


def q_grid_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared over joint choices of each configuration and the base one, counted per customer, not in lists."""
    x = _evaluated(spark, d).where("chosen").select("ck", *_CONFIG)
    base = x.where("profile = 'base' and min_roe = 0.0 and max_debt = 4.0 and min_score = 50.0").select("ck", F.lit(1).alias("in_base"))
    counts = x.join(base, "ck", "left").groupBy(*_CONFIG).agg(F.count(F.lit(1)).alias("n"), F.count("in_base").alias("shared"))
    total = base.agg(F.count(F.lit(1)).alias("base"))
    return counts.crossJoin(F.broadcast(total)).select(*_CONFIG, F.round(F.try_divide("shared", F.col("n") + F.col("base") - F.col("shared")), 6).alias("jaccard"))


def q_config_distance(spark: SparkSession, d: str) -> DataFrame:
    """The ten configurations nearest to the base one: weight change plus relative gate change."""
    c = configurations(spark)
    dist = F.abs(F.col("wq") - 0.5) + F.abs(F.col("wg") - 0.3) + F.abs(F.col("wb") - 0.2) + F.abs(F.col("min_roe") - 0.02) / 0.05 + F.abs(F.col("max_debt") - 4) / 4 + F.abs(F.col("min_score") - 65) / 65
    return c.select(*_CONFIG, F.round(dist, 6).alias("distance")).orderBy("distance", *_CONFIG).limit(10)


_GRID_SQL = """(SELECT * FROM (VALUES ('base', 0.5, 0.3, 0.2), ('quality', 0.7, 0.2, 0.1), ('growth', 0.2, 0.6, 0.2), ('balance', 0.2, 0.2, 0.6)) p(profile, wq, wg, wb),
        (VALUES (0.0), (0.02), (0.05)) a(min_roe), (VALUES (2.0), (4.0)) b(max_debt), (VALUES (50.0), (65.0)) c(min_score))"""
_GRID_CAST = f"(SELECT profile, wq::DOUBLE AS wq, wg::DOUBLE AS wg, wb::DOUBLE AS wb, min_roe::DOUBLE AS min_roe, max_debt::DOUBLE AS max_debt, min_score::DOUBLE AS min_score FROM {_GRID_SQL})"
_EVALUATED_SQL = f"""{BLOCKS_SQL},
    tried AS (SELECT ck, roe, net_debt_to_cfo, g.*, round(quality * wq + growth * wg + balance * wb, 6) AS s FROM scored, {_GRID_CAST} g),
    chosen AS (SELECT *, coalesce(roe >= min_roe AND net_debt_to_cfo <= max_debt AND s >= min_score, false) AS chosen FROM tried)"""

QUERIES = {
    "metrics_15": q_metrics, "signals_9": q_signals, "f_score_rollup": q_f_score, "history_continuity": q_history, "midrank_percentile": q_midrank, "block_scores": q_blocks, "screen_ranked": q_ranked,
    "peer_count": q_peer_count, "mad_outliers": q_outliers, "cohort_quantiles": q_quantiles, "metric_coverage": q_metric_coverage, "spearman_rank": q_spearman, "config_grid_eval": q_grid,
    "config_grid_overlap": q_grid_overlap, "config_distance_topk": q_config_distance,
}

SQL = {
    "metrics_15": f"{METRICS_SQL} SELECT ck, yr, {', '.join(f'round({m}, {2 if m == 'fcf' else 6}) AS {m}' for m in METRICS)} FROM metrics",
    "signals_9": f"{METRICS_SQL} SELECT ck, {', '.join(SIGNALS)} FROM metrics",
    "f_score_rollup": f"""{METRICS_SQL}, f AS (SELECT ck, CAST({' + '.join(f'coalesce({s}::INT, 0)' for s in SIGNALS)} AS INT) AS lower_bound, CAST({' + '.join(f'({s} IS NOT NULL)::INT' for s in SIGNALS)} AS INT) AS known FROM metrics)
        SELECT *, CASE WHEN known = 9 THEN lower_bound END AS f_score FROM f""",
    "history_continuity": f"WITH {YEARS_SQL} SELECT ck, yr, yr_1 AS previous FROM three WHERE yr_1 IS NOT NULL AND yr <> yr_1 + 1",
    "midrank_percentile": f"{BLOCKS_SQL} SELECT ck, {', '.join(f'round({m}_pct, 4) AS {m}_pct' for m in _RANKED)} FROM scored",
    "block_scores": f"{BLOCKS_SQL} SELECT ck, {', '.join(f'round({b}, 4) AS {b}' for b in BLOCKS)}, round(score, 4) AS score FROM scored",
    "screen_ranked": f"{BLOCKS_SQL} SELECT ck, region, segment, round(score, 4) AS score FROM scored ORDER BY region, segment, score DESC NULLS LAST, ck",
    "peer_count": f"{METRICS_SQL} SELECT region, segment, count(*) AS peers, count(roe) AS with_roe FROM metrics GROUP BY region, segment",
    "mad_outliers": f"""{METRICS_SQL}, a AS (SELECT *, median(roe) OVER (PARTITION BY region, segment) AS med, count(roe) OVER (PARTITION BY region, segment) AS n FROM metrics),
        b AS (SELECT *, abs(roe - med) AS gap FROM a), c AS (SELECT *, median(gap) OVER (PARTITION BY region, segment) AS mad FROM b)
        SELECT ck, CASE WHEN n >= 5 AND mad > 0 THEN gap / (mad * 1.4826) > 3.0 END AS roe_outlier FROM c""",
    "cohort_quantiles": f"{METRICS_SQL} SELECT region, segment, round(quantile_cont(roe, 0.25), 6) AS q25, round(quantile_cont(roe, 0.5), 6) AS q50, round(quantile_cont(roe, 0.75), 6) AS q75, round(quantile_cont(roe, 0.95), 6) AS q95 FROM metrics GROUP BY region, segment",
    "metric_coverage": f"{METRICS_SQL} SELECT ck, round(({' + '.join(f'({m} IS NOT NULL)::INT' for m in METRICS)}) / 15.0::DOUBLE, 6) AS coverage FROM metrics",
    "spearman_rank": f"""{METRICS_SQL}, v AS (SELECT region, round(roe, 9) AS a, round(revenue_cagr_2y, 9) AS b FROM metrics WHERE roe IS NOT NULL AND revenue_cagr_2y IS NOT NULL),
        r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY a) + (count(*) OVER (PARTITION BY region, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY region ORDER BY b) + (count(*) OVER (PARTITION BY region, b) - 1) / 2.0 AS rb FROM v)
        SELECT region, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY region""",
    "config_grid_eval": f"{_EVALUATED_SQL} SELECT profile, min_roe, max_debt, min_score, count(*) FILTER (chosen) AS chosen, round(avg(s) FILTER (chosen), 4) AS mean_score FROM chosen GROUP BY profile, min_roe, max_debt, min_score",
    "config_grid_overlap": f"""{_EVALUATED_SQL}, base AS (SELECT ck FROM chosen WHERE chosen AND profile = 'base' AND min_roe = 0.0 AND max_debt = 4.0 AND min_score = 50.0),
        k AS (SELECT profile, min_roe, max_debt, min_score, count(*) AS n, count(base.ck) AS shared FROM chosen LEFT JOIN base ON chosen.ck = base.ck WHERE chosen GROUP BY profile, min_roe, max_debt, min_score)
        SELECT profile, min_roe, max_debt, min_score, round(shared::DOUBLE / (n + (SELECT count(*) FROM base) - shared), 6) AS jaccard FROM k""",
    "config_distance_topk": f"""SELECT profile, min_roe, max_debt, min_score,
        round(abs(wq - 0.5) + abs(wg - 0.3) + abs(wb - 0.2) + abs(min_roe - 0.02) / 0.05 + abs(max_debt - 4) / 4 + abs(min_score - 65) / 65, 6) AS distance FROM {_GRID_CAST} ORDER BY distance, profile, min_roe, max_debt, min_score LIMIT 10""",
}
