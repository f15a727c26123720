"""Versions, identities, coverage and field rules on the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import dates, numeric, text
from quernstone.operators import coverage, rejects, units, versions
from quernstone.operators.tickers import clean_ticker
from quernstone.plans.delivery_sql import _AMOUNTS, _RECORDS, _UNIT_VALUE
from quernstone.session import table

AS_OF = "2025-06-30"
_KEY = ["ticker", "snapshot_date"]
_TICKER_SQL = "upper(trim(ticker))"


def _valuations(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "valuations").withColumn("ticker", clean_ticker("ticker"))
    return versions.visible(v, F.lit(AS_OF).cast("date"), own_day="snapshot_date", pub_day="available_at")


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").withColumn("ticker", clean_ticker("ticker"))


_VISIBLE_SQL = f"visible AS (SELECT * REPLACE ({_TICKER_SQL} AS ticker) FROM valuations WHERE snapshot_date <= DATE '{AS_OF}' AND available_at <= DATE '{AS_OF}')"


def q_latest(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("available_at"), F.col("revision_id"), F.bitwise_not("valuation_id")]
    return versions.latest(_valuations(spark, d), _KEY, order, ["valuation_id", "revision_id"])


def q_conflicts(spark: SparkSession, d: str) -> DataFrame:
    key = [*_KEY, "available_at", "revision_id"]
    return versions.conflicts(_valuations(spark, d), key, ["provider", "market_cap", "currency"])


def q_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every company beside its newest visible valuation, if any."""
    order = [F.col("snapshot_date"), F.col("available_at"), F.col("revision_id"), F.bitwise_not("valuation_id")]
    newest = versions.latest(_valuations(spark, d), ["ticker"], order, ["snapshot_date", "valuation_id"])
    return _companies(spark, d).select("ticker", "market").join(newest, "ticker", "left").withColumn("age_days", dates.age_days(F.lit(AS_OF).cast("date"), F.col("snapshot_date")))


def q_asof_events(spark: SparkSession, d: str) -> DataFrame:
    """Per user and kind, the newest event value at the cutoff."""
    e = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return versions.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"])


def q_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each ticker and folded text, with its number of copies."""
    x = table(spark, d, "documents").where("text is not null").select(clean_ticker("ticker").alias("ticker"), "available_at", "doc_id", F.md5(text.fold(F.col("text"))).alias("content"))
    order = [F.coalesce("available_at", F.lit("9999-12-31").cast("date")), F.col("doc_id")]
    return versions.first_seen(x, ["ticker", "content"], order, ["doc_id"]).select("ticker", "doc_id", "copies")


def q_dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    """Repeated theme rows: rows of equal document, page and text, and how many texts they hold."""
    t = table(spark, d, "theme_documents")
    return t.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.md5("text")).alias("n_texts")).where("n_rows > 1")


def q_number(spark: SparkSession, d: str) -> DataFrame:
    """Plain numbers among the delivered amounts: value, or fault."""
    m = F.col("market_cap")
    return table(spark, d, "valuations").select("valuation_id", (numeric.number(m) + 0.0).alias("value"), numeric.number_fault(m).alias("fault"))


def q_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in millions by their own unit, or else the stated one, and the delivered rate; null where one of them is unknown."""
    x = rejects.with_amount(table(spark, d, "valuations"), "market_cap")
    x = x.withColumn("number", F.when(~rejects.is_unknown(F.col("market_cap")), F.col("number")))
    unit = F.coalesce(units.unit_value(F.col("unit_word")), F.col("unit_scale"))
    return x.select("valuation_id", (F.round(numeric.finite(F.col("number") * unit * F.col("fx_to_reporting")) / 1e6, 2) + 0.0).alias("millions"))


def q_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the window of ninety days before the newest document of their ticker."""
    x = table(spark, d, "documents").where("ticker is not null and available_at is not null").select("doc_id", clean_ticker("ticker").alias("ticker"), "available_at")
    newest = x.groupBy("ticker").agg(F.max("available_at").alias("newest"))
    return x.join(newest, "ticker").where("available_at between date_sub(newest, 90) and newest").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("newest").alias("newest"))


def q_semi(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", clean_ticker("ticker").alias("ticker"))
    return x.join(_companies(spark, d).select("ticker"), "ticker", "left_semi").select("doc_id")


def q_without_company(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", clean_ticker("ticker").alias("ticker"))
    return x.join(_companies(spark, d).select("ticker"), "ticker", "left_anti").select("doc_id")


def q_companies_missing(spark: SparkSession, d: str) -> DataFrame:
    return coverage.missing(_companies(spark, d), table(spark, d, "documents").select(clean_ticker("ticker").alias("ticker")), "ticker")


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = {"documents": "documents", "valuations": "valuations", "statements": "statements", "theme_documents": "theme_documents"}
    parts = [coverage.coverage_ratio(_companies(spark, d), table(spark, d, t).select(clean_ticker("ticker").alias("ticker")), "ticker").select(F.lit(t).alias("tbl"), "expected", "covered", F.round("ratio", 6).alias("ratio")) for t in covered]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_RULES = ("null_text", "blank_text", "no_ticker", "no_day", "late_day", "bad_hash")


def q_exclusions(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "null_text": F.col("text").isNull(), "blank_text": F.trim(F.regexp_replace("text", r"[\r\n\t]", " ")) == "", "no_ticker": F.col("ticker").isNull(), "no_day": F.col("available_at").isNull(),
        "late_day": F.col("available_at") > F.lit(AS_OF).cast("date"), "bad_hash": ~F.col("source_sha256").rlike("^[0-9a-f]{64}$"),
    }
    return coverage.exclusion_counts(table(spark, d, "documents"), rules)


def q_fields(spark: SparkSession, d: str) -> DataFrame:
    return coverage.field_coverage(table(spark, d, "valuations"), ["unit_scale", "fx_to_reporting", "revision_id"])


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Runs, tickers and days of statements against those of valuations, both ways, repeats counted."""
    s = table(spark, d, "statements").select("run_id", clean_ticker("ticker").alias("ticker"))
    v = table(spark, d, "valuations").select("run_id", clean_ticker("ticker").alias("ticker"))
    return coverage.reconcile(s, v).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def q_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines, as exact decimals."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("lines"))
    return coverage.within(o, lines, ["o_orderkey"], "o_totalprice", "lines", 100_000.0).groupBy("agrees").agg(F.count(F.lit(1)).alias("n"))


def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The most severe claim status of each query."""
    order = ["direct_business", "upstream_or_downstream", "planned", "uncertain", "negated"]
    return coverage.rollup_status(table(spark, d, "production_retrieval_results"), "query_id", "claim_status", order)


def q_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "valuations").select("valuation_id", text.url_ok(F.col("source_url")).alias("ok"))


def q_days(spark: SparkSession, d: str) -> DataFrame:
    """Strict days among the snapshot days of the records that can be cut into cells, and their age."""
    x = rejects.parsed_records(table(spark, d, "raw_records"), "record_id", "raw_line")
    cell = F.get(F.filter("cells", lambda c: c["column_name"] == "snapshot_date"), F.lit(0))["value"]
    day = dates.strict_day(F.col("cell"))
    return x.select(F.col("row_id").alias("record_id"), cell.alias("cell")).select("record_id", day.alias("day"), dates.age_days(F.lit(AS_OF).cast("date"), day).alias("age"))


def q_market_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("observed_at is not null").groupBy(dates.market_day(F.col("observed_at")).alias("market_day")).agg(F.count(F.lit(1)).alias("n"))


def q_late(spark: SparkSession, d: str) -> DataFrame:
    """Effective day of a document: the later of publication and observation; and the delay."""
    seen = F.to_date("observed_at")
    return table(spark, d, "documents").select("doc_id", dates.latest_of(F.col("available_at"), seen).alias("effective"), F.datediff(seen, "available_at").alias("delay"))


def q_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed ids of theme rows."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table(spark, d, "theme_documents").select("theme_row_id", F.sha2(F.concat_ws("|", part("document_id"), part("source_url"), part("text")), 256).alias("content_id"))


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind."""
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


QUERIES = {
    "versions_latest": q_latest, "version_conflicts": q_conflicts, "company_latest_valuation": q_latest_snapshot, "asof_latest_value": q_asof_events, "exact_duplicates": q_first_seen, "repeated_documents": q_dedupe_keys,
    "number_parse": q_number, "valuation_fx": q_scaled, "date_window_join": q_ranges, "doc_semi_join": q_semi, "docs_without_company": q_without_company, "companies_without_docs": q_companies_missing,
    "company_coverage": q_coverage, "exclusion_counters": q_exclusions, "field_coverage": q_fields, "export_reconcile": q_reconcile, "tolerance_join": q_tolerance, "status_rollup": q_rollup,
    "url_validity": q_urls, "strict_dates": q_days, "market_day": q_market_day, "effective_day": q_late, "content_ids": q_ids, "event_windows": q_windows,
}

_COVER_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, count(*) AS expected, count(x.ticker) AS covered, round(count(x.ticker) / count(*)::DOUBLE, 6) AS ratio FROM companies c LEFT JOIN (SELECT DISTINCT {_TICKER_SQL} AS ticker FROM {t}) x ON upper(trim(c.ticker)) = x.ticker"
    for t in ("documents", "valuations", "statements", "theme_documents")
)
_PLAIN = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_NUM_SQL = f"CASE WHEN regexp_matches(trim(market_cap), {_PLAIN}) AND isfinite(try_cast(trim(market_cap) AS DOUBLE)) THEN try_cast(trim(market_cap) AS DOUBLE) END"

SQL = {
    "versions_latest": f"WITH {_VISIBLE_SQL} SELECT ticker, snapshot_date, valuation_id, revision_id FROM visible QUALIFY row_number() OVER (PARTITION BY ticker, snapshot_date ORDER BY available_at DESC, revision_id DESC, valuation_id) = 1",
    "version_conflicts": f"""WITH {_VISIBLE_SQL} SELECT ticker, snapshot_date, available_at, revision_id, count(*) AS versions FROM visible GROUP BY ticker, snapshot_date, available_at, revision_id
        HAVING count(DISTINCT (provider, coalesce(market_cap, chr(1)), coalesce(currency, chr(1)))) > 1""",
    "company_latest_valuation": f"""WITH {_VISIBLE_SQL}, newest AS (SELECT ticker, snapshot_date, valuation_id FROM visible QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date DESC, available_at DESC, revision_id DESC, valuation_id) = 1)
        SELECT upper(trim(c.ticker)) AS ticker, market, snapshot_date, valuation_id, datediff('day', snapshot_date, DATE '{AS_OF}') AS age_days FROM companies c LEFT JOIN newest n ON upper(trim(c.ticker)) = n.ticker""",
    "asof_latest_value": "SELECT user_id, event_type, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "repeated_documents": "SELECT document_id, count(*) AS n_rows, count(DISTINCT md5(text)) AS n_texts FROM theme_documents GROUP BY document_id HAVING count(*) > 1",
    "number_parse": f"SELECT valuation_id, ({_NUM_SQL}) + 0.0 AS value, coalesce(market_cap IS NOT NULL AND trim(market_cap) NOT IN ('', 'NA', 'N/A', 'null') AND ({_NUM_SQL}) IS NULL, false) AS fault FROM valuations",
    "valuation_fx": f"WITH {_AMOUNTS} SELECT v.valuation_id, round(a.number * coalesce({_UNIT_VALUE}, v.unit_scale) * v.fx_to_reporting / 1e6, 2) + 0.0 AS millions FROM valuations v LEFT JOIN amounts a ON a.valuation_id = v.valuation_id",
    "date_window_join": f"""WITH x AS (SELECT {_TICKER_SQL} AS ticker, available_at, max(available_at) OVER (PARTITION BY {_TICKER_SQL}) AS newest FROM documents WHERE ticker IS NOT NULL AND available_at IS NOT NULL)
        SELECT ticker, count(*) AS n, max(newest) AS newest FROM x WHERE available_at >= newest - 90 GROUP BY ticker""",
    "doc_semi_join": f"SELECT doc_id FROM documents WHERE {_TICKER_SQL} IN (SELECT {_TICKER_SQL} FROM companies)",
    "docs_without_company": f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE upper(trim(c.ticker)) = upper(trim(d.ticker)))",
    "companies_without_docs": f"SELECT DISTINCT {_TICKER_SQL} AS ticker FROM companies c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE upper(trim(c.ticker)) = upper(trim(d.ticker)))",
    "company_coverage": _COVER_SQL,
    "exclusion_counters": f"""SELECT CASE WHEN text IS NULL THEN 'null_text' WHEN trim(regexp_replace(text, '[\\r\\n\\t]', ' ', 'g'), ' ') = '' THEN 'blank_text' WHEN ticker IS NULL THEN 'no_ticker' WHEN available_at IS NULL THEN 'no_day'
        WHEN available_at > DATE '{AS_OF}' THEN 'late_day' WHEN NOT regexp_matches(source_sha256, '^[0-9a-f]{{64}}$') THEN 'bad_hash' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "field_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) FILTER ({c} = 0) AS zero FROM valuations" for c in ("unit_scale", "fx_to_reporting", "revision_id")),
    "export_reconcile": f"""WITH s AS (SELECT run_id, {_TICKER_SQL} AS ticker FROM statements), v AS (SELECT run_id, {_TICKER_SQL} AS ticker FROM valuations)
        SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM v) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM s) HAVING count(*) > 0""",
    "tolerance_join": """WITH t AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS lines FROM lineitem GROUP BY 1)
        SELECT abs(CAST(o_totalprice AS DECIMAL(28,6)) - CAST(lines AS DECIMAL(28,6))) <= 100000 AS agrees, count(*) AS n FROM orders LEFT JOIN t ON o_orderkey = k GROUP BY 1""",
    "status_rollup": """WITH o AS (SELECT query_id, list_position(['direct_business', 'upstream_or_downstream', 'planned', 'uncertain', 'negated'], claim_status) AS l FROM production_retrieval_results)
        SELECT query_id, ['direct_business', 'upstream_or_downstream', 'planned', 'uncertain', 'negated'][max(l)] AS status FROM o GROUP BY query_id""",
    "url_validity": "SELECT valuation_id, coalesce(regexp_matches(source_url, '^(?i:https?)://[^\\s/?#]+([/?#]\\S*)?$'), false) AS ok FROM valuations",
    "strict_dates": f"""WITH {_RECORDS}, x AS (SELECT record_id, CASE WHEN quoted AND len(cells) = 12 THEN snapshot_date END AS cell FROM record_cells), y AS (SELECT record_id, CASE WHEN regexp_matches(cell, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(cell AS DATE) END AS day FROM x)
        SELECT record_id, day, datediff('day', day, DATE '{AS_OF}') AS age FROM y""",
    "market_day": "SELECT CAST(observed_at + INTERVAL 8 HOUR AS DATE) AS market_day, count(*) AS n FROM documents WHERE observed_at IS NOT NULL GROUP BY 1",
    "effective_day": "SELECT doc_id, greatest(available_at, CAST(observed_at AS DATE)) AS effective, datediff('day', available_at, CAST(observed_at AS DATE)) AS delay FROM documents",
    "content_ids": "SELECT theme_row_id, sha256(concat_ws('|', coalesce(document_id, ''), coalesce(source_url, ''), coalesce(text, ''))) AS content_id FROM theme_documents",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
