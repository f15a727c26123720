"""Evaluation of rankings and classes, anomalies, sentences, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import sentences as st
from quernstone.functions import text as tx
from quernstone.operators import anomaly, chunks, coverage, evaluation, gates, models, passages, vectors
from quernstone.operators.tickers import clean_ticker
from quernstone.plans import texts, years
from quernstone.session import scratch, settled, table
from quernstone.streaming import upserts

TOP = 5
GRADES = {"direct_business": 2, "upstream_or_downstream": 1, "planned": 0, "uncertain": 0, "negated": 0}


def _grades(spark: SparkSession, d: str) -> DataFrame:
    g = F.element_at(F.create_map(*[F.lit(x) for p in GRADES.items() for x in p]), F.col("claim_status"))
    r = table(spark, d, "production_retrieval_results").where("claim_status is not null")
    return r.groupBy("query_id", "doc_id").agg(F.max(g).alias("grade"))


def q_bounds(spark: SparkSession, d: str) -> DataFrame:
    ranked = vectors.top_ranked(texts._bm25(spark, d).withColumn("score", F.round("score", 8)), "query_id", "doc_id", "score", k=50).select("query_id", "doc_id", "rank")
    items = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("items"))
    universe = texts._asked(spark, d).select("query_id").crossJoin(F.broadcast(items))
    b = evaluation.ranking_bounds(ranked, _grades(spark, d), universe, "query_id", "doc_id", k=TOP, maximum=2)
    return b.select("query_id", *[F.round(c, 6).alias(c) for c in b.columns if c != "query_id"])


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    """Language as stated, and as the script of the text suggests."""
    t = F.col("text")
    guess = F.when(t.rlike("[一-鿿]"), "zh").when(t.rlike("[а-я]"), "ru").when(t.rlike("[äöüß]"), "de").when(t.rlike("[éèàç]"), "fr").when(t.rlike("[a-z]"), "en")
    return table(spark, d, "documents").select("doc_id", "lang", guess.alias("guess"), "source", "n_chars")


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_guessed(spark, d), "lang", "guess")


def q_classes(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.class_report(_guessed(spark, d), "lang", "guess")
    return r.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def q_macro(spark: SparkSession, d: str) -> DataFrame:
    x = _guessed(spark, d)
    whole = evaluation.macro_mean(x, "source", "n_chars").select(F.lit("all").alias("rows_used"), F.round("macro", 4).alias("macro"))
    known = evaluation.macro_mean(x.where("n_chars is not null"), "source", "n_chars").select(F.lit("known").alias("rows_used"), F.round("macro", 4).alias("macro"))
    return whole.unionByName(known)


def q_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Words that title and text of a theme row share."""
    w = lambda c: F.array_distinct(tx.words(tx.fold(F.coalesce(F.col(c), F.lit("")))))
    return table(spark, d, "theme_documents").select("theme_row_id", F.round(evaluation.jaccard(w("title"), w("text")), 6).alias("jaccard"))


def q_anomalies(spark: SparkSession, d: str) -> DataFrame:
    m = years.metrics(spark, d).select("ck", "region", "segment", "roe", "cash_conversion", "revenue_cagr_2y", "gross_margin")
    return anomaly.residuals(m, ["region", "segment"], "ck", ["roe", "cash_conversion", "revenue_cagr_2y", "gross_margin"])


def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    return st.sentences(table(spark, d, "documents"), "doc_id", "text")


def q_stream(spark: SparkSession, d: str) -> DataFrame:
    """Newest event per user and kind, drained from a stream of the events."""
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    key, order, keep = ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"]
    events = table(spark, d, "events")
    upserts.upsert_latest(upserts.stream_parquet(spark, f"{d}/events.parquet*", events.schema), folder, key, order, keep, ["ts"])
    return upserts.read_latest(spark, folder, key, order, keep)


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(texts._docs(spark, d), "doc_id", "text", "ticker", "available_at")


def q_units(spark: SparkSession, d: str) -> DataFrame:
    """Passages per issuer: all, and distinct ones."""
    return _passages(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("unit").alias("units"))


def q_passage_search(spark: SparkSession, d: str) -> DataFrame:
    found = passages.search(_passages(spark, d), "ticker", "doc_id", "available_at", texts._asked(spark, d), "query_id", "query")
    return found.select("query_id", "ticker", "place", "unit", F.round("score", 6).alias("score"), "versions", "newest")


def _latent(spark: SparkSession, d: str) -> models.LatentEncoder:
    t = table(spark, d, "documents").where("text is not null and text <> ''")
    return models.LatentEncoder.fit([r.text for r in models.sample(t, "doc_id", ["text"], models.LATENT_SAMPLE)])


def q_encoded(spark: SparkSession, d: str) -> DataFrame:
    """The ten titles nearest to each catalog title, by latent vectors of distinct texts."""
    model = _latent(spark, d)
    e = models.encode_distinct(table(spark, d, "theme_documents"), "title", model)
    q = models.encode_distinct(table(spark, d, "title_catalog"), "title", model).select(F.col("text_key").alias("query_key"), F.col("embedding").alias("asked"))
    return vectors.cosine_topk(e, "text_key", "embedding", q, "query_key", "asked", k=10).select("query_key", "text_key", F.round("score", 5).alias("score"), "rank")


def _reranker(spark: SparkSession, d: str) -> models.TrainedReranker:
    """Trained on the excerpts that were judged for a query: those on its business against the others."""
    r = table(spark, d, "production_retrieval_results").where("claim_status is not null and exact_excerpt is not null and query is not null")
    judged = models.sample(r.withColumn("good", F.col("claim_status").isin("direct_business", "upstream_or_downstream")), "result_id", ["query", "exact_excerpt", "good"], models.RERANK_SAMPLE)
    return models.TrainedReranker.fit(_latent(spark, d), [(x.query, x.exact_excerpt, x.good) for x in judged])


def q_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best documents of each query, ordered again by the reranker; the ten best stay."""
    top = vectors.top_ranked(texts._bm25(spark, d).withColumn("score", F.round("score", 8)), "query_id", "doc_id", "score", k=50)
    with_text = top.join(texts._docs(spark, d).select("doc_id", "text"), "doc_id").join(texts._asked(spark, d), "query_id")
    r = models.rerank(with_text, "query_id", "query", "doc_id", "text", _reranker(spark, d))
    return vectors.top_ranked(r.withColumn("score", F.round("rerank_score", 8)), "query_id", "doc_id", "score", k=10).select("query_id", "doc_id", "rank")


def q_four_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ten best fixed chunks of each query by fusion and reranking, beside all four scores."""
    found = settled(chunks.chunks(texts._docs(spark, d), "doc_id", "text", "ticker"))
    asked, reranker = texts._asked(spark, d), _reranker(spark, d)
    bm25 = chunks.bm25_chunks(found, asked, "query_id", "query", {}, k=50)
    e = models.encode_distinct(found, "chunk", reranker.encoder)
    q = models.encode_distinct(asked, "query", reranker.encoder).join(asked.select("query_id", F.md5("query").alias("text_key")), "text_key").select("query_id", F.col("embedding").alias("asked"))
    near = vectors.cosine_topk(e, "text_key", "embedding", q, "query_id", "asked", k=50).select("query_id", "text_key", "score")
    held = near.join(found.select("chunk_id", F.md5("chunk").alias("text_key")), "text_key")
    dense = vectors.top_ranked(held.withColumnRenamed("score", "dense_cosine"), "query_id", "chunk_id", "dense_cosine", k=50).select("query_id", "chunk_id", "dense_cosine", F.col("rank").alias("dense_rank"))
    lists = bm25.select("query_id", "chunk_id", F.col("bm25_rank").alias("rank")).unionByName(dense.select("query_id", "chunk_id", F.col("dense_rank").alias("rank")))
    first = vectors.top_ranked(vectors.reciprocal_rank_fusion(lists, "query_id", "chunk_id", "rank").withColumn("score", F.round("score", 12)), "query_id", "chunk_id", "score", k=50)
    texts_of = first.select("query_id", "chunk_id").join(found.select("chunk_id", "chunk"), "chunk_id").join(asked, "query_id")
    scores = models.rerank(texts_of, "query_id", "query", "chunk_id", "chunk", reranker).withColumnRenamed("rerank_score", "reranker_score")
    r = chunks.four_scores(found, bm25, dense, scores, "query_id", k=10)
    return r.select("query_id", "rank", "chunk_id", "doc_id", "ticker", "char_start", *[F.round(c, 6).alias(c) for c in ("score", "bm25_score", "dense_cosine", "rrf_score", "reranker_score")])


def q_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether coverage, completeness and freshness of a delivery suffice."""
    c = table(spark, d, "companies").select(clean_ticker("ticker").alias("ticker"))
    of = lambda t: coverage.coverage_ratio(c, table(spark, d, t).select(clean_ticker("ticker").alias("ticker")), "ticker")
    x = table(spark, d, "documents")
    g = gates.gates({
        "document_coverage": (of("documents"), "ratio", ">=", 0.5), "valuation_coverage": (of("valuations"), "ratio", ">=", 0.9), "hashed_documents": (x.agg((F.count("source_sha256") / F.count(F.lit(1))).alias("v")), "v", ">=", 0.75),
        "unknown_texts": (x.agg(F.count_if(F.col("text").isNull()).alias("v")), "v", "<=", 1000), "newest_day_age": (x.agg(F.datediff(F.lit("2027-01-01").cast("date"), F.max("available_at")).alias("v")), "v", "<=", 365),
    })
    return g.select("check", F.round("value", 6).alias("value"), "bound", "passed")


def q_binary(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of the ten best documents per query against the positively judged ones."""
    top = vectors.top_ranked(texts._bm25(spark, d).withColumn("score", F.round("score", 8)), "query_id", "doc_id", "score", k=10).select("query_id", "doc_id", F.lit(True).alias("found"))
    good = _grades(spark, d).where("grade > 0").select("query_id", "doc_id", F.lit(True).alias("good"))
    j = top.join(good, ["query_id", "doc_id"], "full")
    return j.groupBy("query_id").agg(F.count_if(F.col("found") & F.col("good")).alias("tp"), F.count_if(F.col("found") & F.col("good").isNull()).alias("fp"), F.count_if(F.col("found").isNull()).alias("fn"))


QUERIES = {
    "passage_units": q_units, "passage_search": q_passage_search, "encoded_titles_topk": q_encoded, "rerank_topk": q_reranked, "chunk_four_scores": q_four_scores, "readiness_checks": q_gates, "binary_retrieval": q_binary,
    "ir_metrics_bounds": q_bounds, "confusion_matrix": q_confusion, "class_report": q_classes, "macro_average": q_macro, "jaccard_overlap": q_jaccard, "pca_anomalies": q_anomalies, "sentences": q_sentences,
    "stream_versions_latest": q_stream,
}

_GUESS = "CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[а-я]') THEN 'ru' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèàç]') THEN 'fr' WHEN regexp_matches(text, '[a-z]') THEN 'en' END"
_GUESSED = f"guessed AS (SELECT doc_id, lang, {_GUESS} AS guess, source, n_chars FROM documents)"
_GRADE = "CASE claim_status WHEN 'direct_business' THEN 2 WHEN 'upstream_or_downstream' THEN 1 ELSE 0 END"
_WORDSET = "list_distinct(regexp_extract_all(" + texts._FOLD + ", '[a-z0-9]+'))"

_COVERED = "(SELECT count(x.t) / count(*)::DOUBLE FROM (SELECT DISTINCT upper(trim(ticker)) AS t FROM companies) c LEFT JOIN (SELECT DISTINCT upper(trim(ticker)) AS t FROM {0}) x ON c.t = x.t)"
SQL = {
    "readiness_checks": f"""WITH v AS (SELECT * FROM (VALUES ('document_coverage', {_COVERED.format('documents')}, 0.5::DOUBLE, true), ('valuation_coverage', {_COVERED.format('valuations')}, 0.9, true),
        ('hashed_documents', (SELECT count(source_sha256) / count(*)::DOUBLE FROM documents), 0.75, true), ('unknown_texts', (SELECT count(*) FILTER (text IS NULL)::DOUBLE FROM documents), 1000, false),
        ('newest_day_age', (SELECT datediff('day', max(available_at), DATE '2027-01-01')::DOUBLE FROM documents), 365, false)) t("check", value, bound, up))
        SELECT "check", round(value, 6) AS value, bound, coalesce(CASE WHEN up THEN value >= bound ELSE value <= bound END, false) AS passed FROM v""",
    "binary_retrieval": f"""WITH {texts._BM25}, f AS (SELECT query_id, doc_id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) <= 10),
        g AS (SELECT query_id, doc_id FROM production_retrieval_results WHERE claim_status IS NOT NULL GROUP BY query_id, doc_id HAVING max({_GRADE}) > 0),
        j AS (SELECT coalesce(f.query_id, g.query_id) AS query_id, f.doc_id AS fd, g.doc_id AS gd FROM f FULL JOIN g ON f.query_id = g.query_id AND f.doc_id = g.doc_id)
        SELECT query_id, count(*) FILTER (fd IS NOT NULL AND gd IS NOT NULL) AS tp, count(*) FILTER (gd IS NULL) AS fp, count(*) FILTER (fd IS NULL) AS fn FROM j GROUP BY query_id""",
    "ir_metrics_bounds": f"""WITH {texts._BM25}, ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50),
        g AS (SELECT query_id, doc_id, max({_GRADE}) AS grade FROM production_retrieval_results WHERE claim_status IS NOT NULL GROUP BY query_id, doc_id),
        j AS (SELECT r.*, grade FROM ranked r LEFT JOIN g USING (query_id, doc_id)),
        a AS (SELECT query_id, count(*) FILTER (rank <= {TOP} AND grade >= 1) AS p, count(*) FILTER (rank <= {TOP} AND grade IS NULL) AS u,
                     sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) FILTER (rank <= {TOP}) AS lo, sum((pow(2, coalesce(grade, 2)) - 1) / log2(rank + 1)) FILTER (rank <= {TOP}) AS hi,
                     min(rank) FILTER (grade >= 1) AS fg, min(rank) FILTER (grade >= 1 OR grade IS NULL) AS fp FROM j GROUP BY query_id),
        k AS (SELECT query_id, count(*) AS judged, count(*) FILTER (grade >= 1) AS r, list(grade ORDER BY grade DESC) AS grades FROM g GROUP BY query_id),
        q AS (SELECT DISTINCT query_id FROM production_retrieval_results),
        x AS (SELECT q.query_id, coalesce(judged, 0) AS judged, coalesce(r, 0) AS r, (SELECT count(*) FROM documents) - coalesce(judged, 0) AS o, coalesce(grades, []) AS grades,
                     coalesce(p, 0) AS p, coalesce(u, 0) AS u, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, fg, fp FROM q LEFT JOIN k USING (query_id) LEFT JOIN a USING (query_id)),
        y AS (SELECT *, coalesce(list_sum([(pow(2, grades[i]) - 1) / log2(i + 1) FOR i IN range(1, 1 + least({TOP}, len(grades)))]), 0) AS ilo,
                     list_sum([(pow(2, CASE WHEN i <= o THEN 2 ELSE coalesce(grades[i - o], 0) END) - 1) / log2(i + 1) FOR i IN range(1, {TOP} + 1)]) AS ihi FROM x)
        SELECT query_id, round(p / {TOP}::DOUBLE, 6) AS precision_lo, round((p + u) / {TOP}::DOUBLE, 6) AS precision_hi,
               round(CASE WHEN r + o > 0 THEN CASE WHEN r + o - u > 0 THEN p / (r + o - u)::DOUBLE ELSE 1 END END, 6) AS recall_lo, round(CASE WHEN r + o > 0 THEN CASE WHEN r + u > 0 THEN (p + u) / (r + u)::DOUBLE ELSE 0 END END, 6) AS recall_hi,
               round(CASE WHEN ihi > 0 THEN lo / ihi END, 6) AS ndcg_lo, round(CASE WHEN ihi = 0 THEN NULL WHEN ilo > 0 THEN least(1, hi / ilo) WHEN hi > 0 THEN 1 ELSE 0 END, 6) AS ndcg_hi,
               round(CASE WHEN r + o > 0 THEN coalesce(1.0 / fg::DOUBLE, 0) END, 6) AS mrr_lo, round(CASE WHEN r + o > 0 THEN coalesce(1.0 / fp::DOUBLE, 0) END, 6) AS mrr_hi FROM y""",
    "confusion_matrix": f"WITH {_GUESSED} SELECT lang, guess, count(*) AS n FROM guessed GROUP BY lang, guess",
    "class_report": f"""WITH {_GUESSED}, l AS (SELECT lang AS label FROM guessed UNION SELECT guess FROM guessed),
        c AS (SELECT l.label, (SELECT count(*) FROM guessed WHERE lang IS NOT DISTINCT FROM l.label) AS support, (SELECT count(*) FROM guessed WHERE guess IS NOT DISTINCT FROM l.label) AS named,
                     (SELECT count(*) FROM guessed WHERE lang IS NOT DISTINCT FROM l.label AND guess IS NOT DISTINCT FROM l.label) AS hit FROM l)
        SELECT label, support, round(CASE WHEN named > 0 THEN hit / named::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END, 6) AS recall, round(2 * hit / (support + named)::DOUBLE, 6) AS f1 FROM c""",
    "macro_average": """WITH g AS (SELECT source, CASE WHEN count(n_chars) = count(*) THEN avg(n_chars) END AS m, avg(n_chars) AS k FROM documents GROUP BY source)
        SELECT 'all' AS rows_used, round(CASE WHEN count(m) = count(*) THEN avg(m) END, 4) AS macro FROM g UNION ALL SELECT 'known', round(avg(k), 4) FROM g WHERE k IS NOT NULL""",
    "jaccard_overlap": f"""WITH w AS (SELECT theme_row_id, {_WORDSET.format(c="coalesce(title, '')")} AS a, {_WORDSET.format(c="coalesce(text, '')")} AS b FROM theme_documents)
        SELECT theme_row_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END, 6) AS jaccard FROM w""",
    "sentences": """WITH cut AS (SELECT doc_id, text, regexp_replace(text, '([。！？!?；;]+|\\n@ONE*\\n|[A-Za-z0-9]\\.(?:@ONE|$))', '\\1' || chr(1), 'g') AS marked FROM documents WHERE text IS NOT NULL),
        parts AS (SELECT doc_id, unnest(string_split(marked, chr(1))) AS part, generate_subscripts(string_split(marked, chr(1)), 1) AS no FROM cut),
        placed AS (SELECT doc_id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, no FROM parts),
        shown AS (SELECT doc_id, start + length(part) - length(regexp_replace(part, '^' || '@SPACE', '')) AS a, start + length(regexp_replace(part, '@SPACE' || '$', '')) AS b, no FROM placed WHERE regexp_replace(part, '@SPACE', '', 'g') <> '')
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INT) AS sentence_no, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end FROM shown""".replace("@SPACE", texts._SPACE).replace("@ONE", texts._SPACE[:-1]),
    "stream_versions_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
