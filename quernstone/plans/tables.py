"""Smaller operations on the delivered tables: configurations, outcomes, sets, records, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import chunks, spaces, statements, versions
from quernstone.operators.screen import BLOCKS
from quernstone.operators.tickers import clean_ticker
from quernstone.plans import screens, texts, years
from quernstone.plans.filings import _LOADED
from quernstone.session import table

_GATES = ("min_roe", "min_cash_conversion", "max_net_debt_to_cfo", "min_score")


def _space(spark: SparkSession) -> DataFrame:
    """The default space as a table: a fixed number of rows."""
    rows = [(i, *(c["weights"][b] for b in BLOCKS), *(float(c[g]) for g in _GATES), round(spaces.distance(c), 9)) for i, c in enumerate(spaces.configurations(spaces.default_space()))]
    return spark.createDataFrame(rows, "config int, " + ", ".join(f"w_{b} double" for b in BLOCKS) + ", " + ", ".join(f"{g} double" for g in _GATES) + ", distance double")


def q_space(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration of the default space on the delivered screen: how many issuers it chooses, and their mean score."""
    x = screens._scored(spark, d, ["market"]).select("ticker", "roe", "cash_conversion", "net_debt_to_cfo", *BLOCKS)
    s = sum((F.col(b) * F.col(f"w_{b}") for b in BLOCKS), F.lit(0.0))
    tried = x.crossJoin(F.broadcast(_space(spark))).withColumn("s", F.round(s, 6))
    ok = (F.col("roe") >= F.col("min_roe")) & (F.col("cash_conversion") >= F.col("min_cash_conversion")) & (F.col("net_debt_to_cfo") <= F.col("max_net_debt_to_cfo")) & (F.col("s") >= F.col("min_score"))
    g = tried.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("config", "distance").agg(F.count_if("ok").alias("chosen"), F.round(F.avg(F.when(F.col("ok"), F.col("s"))), 4).alias("mean_score"))
    return g.select("config", F.round("distance", 6).alias("distance"), "chosen", "mean_score")


def q_next_year(spark: SparkSession, d: str) -> DataFrame:
    """Each year beside the outcome of the next one: growth of revenue from this year to that."""
    y = years.years(spark, d).select("ck", "yr", "revenue")
    after = y.select("ck", (F.col("yr") - 1).alias("yr"), F.col("revenue").alias("next_revenue"))
    return y.join(after, ["ck", "yr"]).select("ck", "yr", F.round(F.when(F.col("revenue") > 0, F.col("next_revenue") / F.col("revenue") - 1), 6).alias("growth"))


def q_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each document id in order of the file, with the number of rows that repeat it and of other contents under it."""
    t = table(spark, d, "theme_documents").where("document_id is not null")
    content = F.md5(F.to_json(F.struct("ticker", "available_at", "page_num", "page_label", "text", "title"), {"ignoreNullFields": "false"}))
    x = t.select("document_id", "theme_row_id", content.alias("c"))
    g = x.groupBy("document_id").agg(F.min("theme_row_id").alias("theme_row_id"), F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return g.select("document_id", "theme_row_id", F.col("n").alias("rows_held"), (F.col("lo") != F.col("hi")).alias("conflicting"))


def q_sets(spark: SparkSession, d: str) -> DataFrame:
    """What the results of each query hold: sorted sets of issuers and states, as arrays and as text."""
    r = table(spark, d, "production_retrieval_results").withColumn("t", clean_ticker("ticker"))
    g = r.groupBy("query_id").agg(F.array_sort(F.collect_set("claim_status")).alias("states"), F.array_sort(F.collect_set("t")).alias("tickers"))
    return g.select("query_id", F.array_join("states", "|").alias("states"), F.size("tickers").alias("n"), F.array_join(F.slice("tickers", 1, 3), "|").alias("first_three"), F.element_at("tickers", -1).alias("last"))


def q_records(spark: SparkSession, d: str) -> DataFrame:
    """Companies as keyed blocks: a map of fields, looked up with a default, and the old name kept among the aliases."""
    c = table(spark, d, "companies")
    m = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("market", "sector", "scope")]))
    kept = F.when(F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")), F.col("aliases")).otherwise(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))
    x = c.select("ticker", m.alias("m"), kept.alias("kept"))
    return x.select("ticker", F.coalesce(F.col("m")["sector"], F.lit("unknown")).alias("sector"), F.coalesce(F.try_element_at("m", F.lit("board")), F.lit("none")).alias("board"), F.array_join("kept", "|").alias("names"))


#: Relations that the amounts of one statement must keep, where all of them are known.
IDENTITIES = {
    "debt_within_total": "long_term_debt <= total_debt", "cash_within_current": "cash <= current_assets", "current_within_total": "current_assets <= total_assets", "equity_within_total": "equity_parent <= total_assets",
    "assets_positive": "total_assets > 0", "revenue_positive": "revenue > 0", "costs_not_negative": "cogs >= 0 AND capex >= 0 AND interest_expense >= 0", "gross_profit_above_ebit": "revenue - cogs >= ebit",
}


def q_identities(spark: SparkSession, d: str) -> DataFrame:
    """(statement, check) of every relation that the amounts of a statement break; an unknown amount breaks none."""
    x = statements.load(table(spark, d, "statements"))
    broken = F.filter(F.array(*[F.when(~F.expr(e), F.lit(n)) for n, e in IDENTITIES.items()]), lambda c: c.isNotNull())
    return x.select("statement_id", F.explode(broken).alias("check"))


def q_directory(spark: SparkSession, d: str) -> DataFrame:
    """Companies, and how many of them have documents, valuations and statements, by market and sector."""
    c = table(spark, d, "companies").select(clean_ticker("ticker").alias("ticker"), "market", "sector")
    for t in ("documents", "valuations", "statements"):
        has = table(spark, d, t).select(clean_ticker("ticker").alias("ticker")).where("ticker is not null").distinct().withColumn(t, F.lit(1))
        c = c.join(has, "ticker", "left")
    return c.groupBy("market", "sector").agg(F.count(F.lit(1)).alias("companies"), *[F.count(t).alias(f"with_{t}") for t in ("documents", "valuations", "statements")])


def q_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Issuers of the documents against the list of companies: the first reason why one is no member."""
    c = table(spark, d, "companies").select(clean_ticker("ticker").alias("ticker"), "market", "universe_as_of")
    t = table(spark, d, "documents").select(clean_ticker("ticker").alias("ticker"), "available_at").where("ticker is not null and ticker <> ''").groupBy("ticker").agg(F.min("available_at").alias("first_seen"))
    x = t.join(c.withColumn("listed", F.lit(True)), "ticker", "left")
    reason = F.when(F.col("listed").isNull(), "missing").when(~F.col("ticker").rlike(r"\.X[A-Z]$"), "no_security").when(F.col("universe_as_of") < F.col("first_seen"), "list_predates")
    return x.select("ticker", "first_seen", reason.alias("reason"))


THEMES = {"cooling": ["liquid cooling", "液冷", "液冷机柜"], "machine tools": ["五轴机床", "five-axis mills", "machine tool"], "optical fibre": ["光纤", "fiber filters", "glasfaser"]}


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The ten best fixed chunks of each query, expanded by themes and held to its literal demands."""
    found = chunks.chunks(texts._docs(spark, d), "doc_id", "text", "ticker")
    best = chunks.bm25_chunks(found, texts._asked(spark, d), "query_id", "query", THEMES, k=10)
    return best.select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"), "bm25_rank")


def q_first_versions(spark: SparkSession, d: str) -> DataFrame:
    """The first statement of each issuer and period, whatever came later."""
    s = table(spark, d, "statements").withColumn("ticker", clean_ticker("ticker")).where("available_at is not null and ticker is not null")
    f = versions.first_seen(s, ["ticker", "period_end"], [F.col("available_at"), F.col("statement_id")], ["statement_id", "available_at"])
    return f.select("ticker", "period_end", "statement_id", "available_at", "copies")


QUERIES = {
    "config_space": q_space, "next_year_outcome": q_next_year, "first_rows": q_first_rows, "result_sets": q_sets, "company_records": q_records, "accounting_identities": q_identities, "directory_coverage": q_directory,
    "memberships": q_memberships, "chunk_bm25_topk": q_chunks, "first_versions": q_first_versions,
}

_VALUES = ", ".join(str((i, *(float(c["weights"][b]) for b in BLOCKS), *(float(c[g]) for g in _GATES), round(spaces.distance(c), 9))) for i, c in enumerate(spaces.configurations(spaces.default_space())))
_COLUMNS = ", ".join(["config", *(f"w_{b}" for b in BLOCKS), *_GATES, "distance"])
_FLOATS = ", ".join([*(f"w_{b}::DOUBLE AS w_{b}" for b in BLOCKS), *(f"{g}::DOUBLE AS {g}" for g in _GATES)])
_HAS = "(SELECT DISTINCT upper(trim(ticker)) AS t FROM {0})"
SQL = {
    "config_space": f"""{screens._scores_sql('market')}, space AS (SELECT config, distance::DOUBLE AS distance, {_FLOATS} FROM (VALUES {_VALUES}) v({_COLUMNS})),
        tried AS (SELECT config, distance, roe >= min_roe AND cash_conversion >= min_cash_conversion AND net_debt_to_cfo <= max_net_debt_to_cfo AND s >= min_score AS ok, s
                  FROM (SELECT *, round({' + '.join(f'{b} * w_{b}' for b in BLOCKS)}, 6) AS s FROM blocks, space))
        SELECT config, round(distance, 6) AS distance, count(*) FILTER (ok) AS chosen, round(avg(s) FILTER (ok), 4) AS mean_score FROM tried GROUP BY config, distance""",
    "next_year_outcome": f"WITH {years.YEARS_SQL} SELECT a.ck, a.yr, round(CASE WHEN a.revenue > 0 THEN b.revenue / a.revenue - 1 END, 6) AS growth FROM years a JOIN years b ON a.ck = b.ck AND b.yr = a.yr + 1",
    "first_rows": """SELECT document_id, min(theme_row_id) AS theme_row_id, count(*) AS rows_held, count(DISTINCT (ticker, available_at, page_num, page_label, text, title)) > 1 AS conflicting
        FROM theme_documents WHERE document_id IS NOT NULL GROUP BY document_id""",
    "result_sets": """WITH g AS (SELECT query_id, list_sort(list_distinct(list(claim_status) FILTER (claim_status IS NOT NULL))) AS s, list_sort(list_distinct(list(upper(trim(ticker))) FILTER (ticker IS NOT NULL))) AS t FROM production_retrieval_results GROUP BY query_id)
        SELECT query_id, coalesce(array_to_string(s, '|'), '') AS states, CAST(coalesce(len(t), 0) AS INT) AS n, coalesce(array_to_string(t[1:3], '|'), '') AS first_three, t[-1] AS last FROM g""",
    "company_records": """SELECT ticker, coalesce(sector, 'unknown') AS sector, 'none' AS board, array_to_string(CASE WHEN list_contains(coalesce(aliases, []), name) THEN aliases ELSE list_append(coalesce(aliases, []), name) END, '|') AS names FROM companies""",
    "accounting_identities": f"WITH {_LOADED} " + " UNION ALL ".join(f"SELECT statement_id, '{n}' AS \"check\" FROM loaded WHERE NOT ({e})" for n, e in IDENTITIES.items()),
    "directory_coverage": f"""SELECT market, sector, count(*) AS companies, count(a.t) AS with_documents, count(b.t) AS with_valuations, count(s.t) AS with_statements FROM companies c LEFT JOIN {_HAS.format('documents')} a ON a.t = upper(trim(c.ticker))
        LEFT JOIN {_HAS.format('valuations')} b ON b.t = upper(trim(c.ticker)) LEFT JOIN {_HAS.format('statements')} s ON s.t = upper(trim(c.ticker)) GROUP BY market, sector""",
    "memberships": r"""WITH t AS (SELECT upper(trim(ticker)) AS ticker, min(available_at) AS first_seen FROM documents WHERE trim(ticker) <> '' GROUP BY 1)
        SELECT t.ticker, first_seen, CASE WHEN c.ticker IS NULL THEN 'missing' WHEN NOT regexp_matches(t.ticker, '\.X[A-Z]$') THEN 'no_security' WHEN universe_as_of < first_seen THEN 'list_predates' END AS reason FROM t LEFT JOIN companies c ON upper(trim(c.ticker)) = t.ticker""",
    "first_versions": """SELECT upper(trim(ticker)) AS ticker, period_end, arg_min(statement_id, (available_at, statement_id)) AS statement_id, min(available_at) AS available_at, count(*) AS copies
        FROM statements WHERE available_at IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2""",
}
