"""Terms, chunks, lexical and dense retrieval, fusion, near-duplicates, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.operators import lexical, vectors
from quernstone.operators.tickers import clean_ticker
from quernstone.session import spread, table

TOPICS = {
    "capacity": ["capacity expansion", "扩产", "kapazität"], "orders": ["order book", "在手订单"], "energy": ["energy retrofit", "单位能耗", "rénovation énergétique"],
    "quality": ["defect rate", "不良率"], "people": ["headcount", "研发团队"], "risk": ["impairment", "存货跌价", "forwards"],
}
TOP = 10
#: Every vector whose id is divisible by this is a query.
QUERY_EVERY = 50


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", clean_ticker("ticker").alias("ticker"), "available_at"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "production_retrieval_results").select("query_id", "query").distinct()


def q_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.length(tx.fold(F.col("text"))).alias("n"), F.size(tx.words(tx.fold(F.col("text")))).alias("n_words"))


def q_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode_outer(tx.words(tx.fold(F.col("text")))).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode_outer(tx.bigrams(tx.fold(F.col("text")))).alias("pair")).where("pair is not null").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.explode_outer(tx.fixed_chunks(F.col("text"))).alias("c")).where("c is not null")
    return c.select("doc_id", "c.chunk_no", "c.char_start", F.md5("c.chunk").alias("chunk_md5"))


def q_postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(_docs(spark, d), "doc_id", "text")


def q_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return q_postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_docs(spark, d), "doc_id", "text", _asked(spark, d), "query_id", "query")


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def q_bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_ranked(_bm25(spark, d).withColumn("score", F.round("score", 8)), "query_id", "doc_id", "score", k=TOP).select("query_id", "doc_id", "rank")


def q_bm25_company(spark: SparkSession, d: str) -> DataFrame:
    """A company's score is that of its best document, never a sum."""
    s = _bm25(spark, d).join(_docs(spark, d).select("doc_id", "ticker"), "doc_id").where("ticker is not null")
    return s.groupBy("query_id", "ticker").agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("hits"))


def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The five best hits of each query and company, ties by newest day, then id."""
    s = _bm25(spark, d).withColumn("score", F.round("score", 8)).join(_docs(spark, d).select("doc_id", "ticker", "available_at"), "doc_id").where("ticker is not null")
    w = Window.partitionBy("query_id", "ticker").orderBy(F.desc("score"), F.desc_nulls_last("available_at"), "doc_id")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", "ticker", "place", "doc_id")


def q_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.tfidf(_docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total"))


def q_tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    v = lexical.tfidf(docs, "doc_id", "text")
    df = lexical.document_frequency(lexical.placed_postings(docs, "doc_id", "text"))
    asked = _asked(spark, d).select("query_id", F.explode(tx.terms(F.col("query"))).alias("term"))
    return lexical.tfidf_search(v, "doc_id", asked, "query_id", df, docs.count()).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def q_near(spark: SparkSession, d: str) -> DataFrame:
    n = lexical.near_duplicates(_docs(spark, d), "doc_id", "text", "ticker", ["available_at"])
    return n.select("doc_id", "match", F.round("similarity", 6).alias("similarity"))


def q_topics(spark: SparkSession, d: str) -> DataFrame:
    return lexical.topic_hits(_docs(spark, d), "doc_id", "text", TOPICS)


def q_excerpts(spark: SparkSession, d: str) -> DataFrame:
    hits = q_topics(spark, d).groupBy("doc_id").agg(F.min("position").alias("position"))
    x = _docs(spark, d).select("doc_id", tx.fold(F.col("text")).alias("t")).join(hits, "doc_id")
    return x.select("doc_id", F.md5(tx.excerpt(F.col("t"), F.col("position"))).alias("excerpt_md5"))


def q_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name both a quarter and a year as whole words."""
    t = tx.fold(F.col("text"))
    return _docs(spark, d).where(lexical.has_all(t, ["q3", "2023"])).select("doc_id")


def q_csv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.csv_safe(F.col("text"))).alias("cell_md5"))


def q_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the titles: what they show."""
    t = table(spark, d, "theme_documents").where("title is not null")
    page = F.concat(F.lit("<html><head><style>b{x:1}</style><script>var a = '<b>';</script></head><body><!-- note --><h1>"), F.col("title"), F.lit("</h1><p>A &amp; B&nbsp;&lt;c&gt;</p></body></html>"))
    return t.select("theme_row_id", F.md5(tx.visible_html(page)).alias("shown_md5"))


def q_contains(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts found in their document when blanks do not count."""
    r = table(spark, d, "production_retrieval_results").select("result_id", "doc_id", "exact_excerpt")
    x = r.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return x.select("result_id", F.contains(tx.compact(F.col("text")), tx.compact(F.col("exact_excerpt"))).alias("found"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return vectors.cosine_topk(e, "vec_id", "embedding", q, "query_id", "asked", k=TOP)


def q_dense(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of documents per query: by lexical score, and by delivered relevance."""
    lexical_ = vectors.top_ranked(_bm25(spark, d).withColumn("score", F.round("score", 8)), "query_id", "doc_id", "score", k=100).select("query_id", "doc_id", "rank")
    given = table(spark, d, "production_retrieval_results").where("relevance_score is not null").groupBy("query_id", "doc_id").agg(F.max("relevance_score").alias("score"))
    return lexical_.unionByName(vectors.top_ranked(given, "query_id", "doc_id", "score", k=100).select("query_id", "doc_id", "rank"))


def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    return vectors.reciprocal_rank_fusion(_rankings(spark, d), "query_id", "doc_id", "rank").select("query_id", "doc_id", F.round("score", 8).alias("score"))


QUERIES = {
    "norm_text": q_fold, "tokens_words": q_words, "tokens_bigrams": q_bigrams, "fixed_chunks": q_chunks, "postings": q_postings, "doc_freq": q_doc_freq, "bm25_search": q_bm25, "bm25_topk": q_bm25_top,
    "bm25_company_max": q_bm25_company, "evidence_topk": q_evidence, "tfidf_weights": q_tfidf, "tfidf_search": q_tfidf_search, "near_duplicates": q_near, "topic_hits": q_topics, "excerpts": q_excerpts,
    "qualifier_filter": q_qualifiers, "csv_escape": q_csv, "html_clean": q_html, "compact_contains": q_contains, "dense_cosine_topk": q_dense, "rrf_fusion": q_rrf,
}

_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_FOLD = "trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '" + _SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_WORDS = "regexp_extract_all({t}, '[a-z0-9]+')"
_PAIRS = "flatten([CASE WHEN length(r) = 1 THEN [r] ELSE [substr(r, i, 2) FOR i IN range(1, length(r))] END FOR r IN regexp_extract_all({t}, '[㐀-䶿一-鿿]+')])"


def _terms_sql(c: str) -> str:
    t = _FOLD.format(c=c)
    return f"list_concat({_WORDS.format(t=t)}, {_PAIRS.format(t=t)})"


_POST = f"""docs AS (SELECT doc_id, upper(trim(ticker)) AS ticker, available_at, text, {_terms_sql('text')} AS terms FROM documents),
    sized AS (SELECT doc_id, coalesce(len(terms), 0) AS length FROM docs), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM sized),
    post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY doc_id, term), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_ASKED = f"asked AS (SELECT DISTINCT query_id, unnest(list_distinct({_terms_sql('query')})) AS term FROM (SELECT DISTINCT query_id, query FROM production_retrieval_results))"
_BM25 = f"""{_POST}, {_ASKED},
    bm AS (SELECT a.query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))) AS score
           FROM asked a JOIN post p ON a.term = p.term JOIN freq f ON f.term = p.term JOIN sized s ON s.doc_id = p.doc_id, stats GROUP BY a.query_id, p.doc_id)"""
_TFIDF = f"""{_POST}, w0 AS (SELECT p.doc_id, p.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM post p JOIN freq f ON f.term = p.term, stats),
    weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""
_TOPIC_ROWS = ", ".join(f"('{t}', '{k}')" for t, ks in TOPICS.items() for k in ks)
_TOPIC_SQL = f"""folded AS (SELECT doc_id, {_FOLD.format(c='text')} AS t FROM documents), hits AS (SELECT doc_id, topic, keyword, instr(t, keyword) - 1 AS position FROM folded, (VALUES {_TOPIC_ROWS}) k(topic, keyword) WHERE instr(t, keyword) > 0),
    firsts AS (SELECT doc_id, topic, keyword, position FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, topic ORDER BY position, keyword) = 1)"""

SQL = {
    "norm_text": f"SELECT doc_id, length({_FOLD.format(c='text')}) AS n, len({_WORDS.format(t=_FOLD.format(c='text'))}) AS n_words FROM documents WHERE text IS NOT NULL",
    "tokens_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format(t=_FOLD.format(c='text'))}) AS word FROM documents) GROUP BY word",
    "tokens_bigrams": f"SELECT pair, count(*) AS n FROM (SELECT unnest({_PAIRS.format(t=_FOLD.format(c='text'))}) AS pair FROM documents) GROUP BY pair",
    "fixed_chunks": """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 80) / 400.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)
        SELECT doc_id, i AS chunk_no, i * 400 AS char_start, md5(substr(text, i * 400 + 1, 480)) AS chunk_md5 FROM c WHERE trim(substr(text, i * 400 + 1, 480), ' ') <> ''""",
    "postings": f"WITH {_POST} SELECT doc_id, term, tf FROM post",
    "doc_freq": f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "bm25_search": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm QUALIFY rank <= {TOP}",
    "bm25_company_max": f"WITH {_BM25} SELECT query_id, ticker, round(max(score), 6) AS score, count(*) AS hits FROM bm JOIN docs USING (doc_id) WHERE ticker IS NOT NULL GROUP BY query_id, ticker",
    "evidence_topk": f"""WITH {_BM25} SELECT query_id, ticker, row_number() OVER (PARTITION BY query_id, ticker ORDER BY round(score, 8) DESC, available_at DESC NULLS LAST, doc_id) AS place, doc_id
        FROM bm JOIN docs USING (doc_id) WHERE ticker IS NOT NULL QUALIFY place <= 5""",
    "tfidf_weights": f"WITH {_TFIDF} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS top_weight, round(sum(weight), 4) AS total FROM weights GROUP BY doc_id",
    "tfidf_search": f"""WITH {_TFIDF}, q0 AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_terms_sql('query')}) AS term FROM (SELECT DISTINCT query_id, query FROM production_retrieval_results)) GROUP BY query_id, term),
        q1 AS (SELECT query_id, q0.term, (1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1) AS w FROM q0 LEFT JOIN freq f ON f.term = q0.term, stats), q2 AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM q1)
        SELECT query_id, doc_id, round(sum(weight * qw), 6) AS score FROM weights JOIN q2 USING (term) GROUP BY query_id, doc_id""",
    "near_duplicates": f"""WITH {_TFIDF.replace('FROM documents)', 'FROM documents WHERE ticker IS NOT NULL)', 1)},
        w AS (SELECT weights.*, ticker, (coalesce(available_at, DATE '0001-01-01'), doc_id) AS place FROM weights JOIN docs USING (doc_id)),
        pairs AS (SELECT a.doc_id, b.doc_id AS match, b.place, round(least(sum(a.weight * b.weight), 1.0), 9) AS similarity FROM w a JOIN w b ON a.ticker = b.ticker AND a.term = b.term AND b.place < a.place GROUP BY a.doc_id, b.doc_id, b.place)
        SELECT doc_id, match, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.9 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, place) = 1""",
    "compact_contains": f"""SELECT result_id, contains(regexp_replace(text, '{_SPACE}', '', 'g'), regexp_replace(exact_excerpt, '{_SPACE}', '', 'g')) AS found FROM production_retrieval_results JOIN documents USING (doc_id)""",
    "exact_duplicates": f"""WITH x AS (SELECT upper(trim(ticker)) AS ticker, doc_id, available_at, {_FOLD.format(c='text')} AS t FROM documents WHERE text IS NOT NULL)
        SELECT ticker, arg_min(doc_id, (coalesce(available_at, DATE '9999-12-31'), doc_id)) AS doc_id, count(*) AS copies FROM x GROUP BY ticker, t""",
    "topic_hits": f"WITH {_TOPIC_SQL} SELECT * FROM firsts",
    "excerpts": f"""WITH {_TOPIC_SQL}, p AS (SELECT doc_id, min(position) AS position FROM firsts GROUP BY doc_id), s AS (SELECT doc_id, t, greatest(position - 250, 0) AS b FROM p JOIN folded USING (doc_id))
        SELECT doc_id, md5(CASE WHEN length(t) <= 1000 THEN t WHEN b + 1000 >= length(t) THEN CASE WHEN length(t) > 1000 THEN '…' ELSE '' END || right(t, 1000)
            ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || substr(t, b + 1, 1000) || '…' END) AS excerpt_md5 FROM s""",
    "qualifier_filter": f"WITH f AS (SELECT doc_id, {_FOLD.format(c='text')} AS t FROM documents) SELECT doc_id FROM f WHERE regexp_matches(t, '(^|[^a-z0-9])q3([^a-z0-9]|$)') AND regexp_matches(t, '(^|[^a-z0-9])2023([^a-z0-9]|$)')",
    "csv_escape": "SELECT doc_id, md5(CASE WHEN text IS NULL THEN '' WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END) AS cell_md5 FROM documents",
    "html_clean": f"SELECT theme_row_id, md5(trim(regexp_replace(title || ' A & B <c>', '{_SPACE}', ' ', 'g'))) AS shown_md5 FROM theme_documents WHERE title IS NOT NULL",
    "dense_cosine_topk": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % {QUERY_EVERY} = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 12) AS score FROM q, embeddings)
        SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {TOP}""",
    "rrf_fusion": f"""WITH {_BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100),
        g AS (SELECT query_id, doc_id, max(relevance_score) AS score FROM production_retrieval_results WHERE relevance_score IS NOT NULL GROUP BY query_id, doc_id),
        b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g QUALIFY rank <= 100)
        SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc_id""",
}
