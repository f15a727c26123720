"""Retrieval of fixed chunks: one lexical unit per issuer and text, ranked chunks beside all their scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import matching
from quernstone.functions import text as tx
from quernstone.operators import lexical, vectors


def chunks(df: DataFrame, doc: str, text: str, issuer: str, *keep: str, size: int = 480, overlap: int = 80) -> DataFrame:
    """(chunk_id, doc, issuer, kept columns, chunk_no, char_start, chunk, shown, unit) of every text with an issuer.

    shown is the chunk as it is compared; unit is a digest of issuer and shown,
    so that a text that comes in many documents of an issuer is counted once.
    """
    x = df.where(F.col(issuer).isNotNull() & F.col(text).isNotNull())
    c = x.select(doc, issuer, *keep, F.explode_outer(tx.fixed_chunks(F.col(text), size, overlap)).alias("c")).where("c is not null").select(doc, issuer, *keep, "c.*")
    c = c.withColumn("shown", matching.matched(F.col("chunk"))["shown"]).withColumn("chunk_id", F.concat_ws("#", F.col(doc).cast("string"), F.col("chunk_no").cast("string")))
    return c.withColumn("unit", F.md5(F.concat_ws("\u0001", F.col(issuer), F.col("shown"))))


def expanded(queries: DataFrame, query: str, query_text: str, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """(query, words, needed): the text of all terms of a query, and what it must be met with literally."""
    q = queries.select(query, F.col(query_text).cast("string").alias("__q"))
    fields = f"`{query}` {q.schema[0].dataType.simpleString()}, words string, needed array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            words = [tx.normal(" \n ".join(matching.expand(t, dictionary)[0])) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), pa.array([matching.qualifiers(t) for t in texts], pa.list_(pa.string()))], names=[query, "words", "needed"])

    return q.mapInArrow(run, fields)


def bm25_chunks(found: DataFrame, queries: DataFrame, query: str, query_text: str, dictionary: Mapping[str, Sequence[str]], *, k: int) -> DataFrame:
    """(query, chunk_id, bm25_score, bm25_rank): the k best chunks of each query that hold all it demands; ties by id.

    found: chunks(). Statistics count units; every chunk of a unit has its score.
    """
    asked = expanded(queries, query, query_text, dictionary)
    units = found.groupBy("unit").agg(F.first("shown").alias("shown"))
    scores = lexical.bm25(units, "unit", "shown", asked, query, "words").where("score > 0")
    x = found.select("chunk_id", "unit", "shown").join(scores, "unit").join(asked.select(query, "needed"), query)
    guarded = lambda q: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), q, F.lit(r"\E(?![A-Za-z0-9])"))
    x = x.where(F.forall("needed", lambda q: F.rlike(F.col("shown"), guarded(q))))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return x.withColumn("bm25_rank", F.row_number().over(w)).where(F.col("bm25_rank") <= k).select(query, "chunk_id", F.col("score").alias("bm25_score"), "bm25_rank")


def four_scores(found: DataFrame, bm25: DataFrame, dense: DataFrame, reranked: DataFrame | None, query: str, *, k: int, rrf_k: int = 60) -> DataFrame:
    """(query, rank, chunk attributes, score, bm25_score, dense_cosine, rrf_score, reranker_score) of the k best chunks of each query.

    bm25: bm25_chunks(); dense: (query, chunk_id, dense_cosine, dense_rank);
    reranked: (query, chunk_id, reranker_score) or None. The order is that of
    the reranker where there is one, else that of the fusion; a score that a
    chunk does not have is null.
    """
    lists = bm25.select(query, "chunk_id", F.col("bm25_rank").alias("rank")).unionByName(dense.select(query, "chunk_id", F.col("dense_rank").alias("rank")))
    fused = vectors.reciprocal_rank_fusion(lists, query, "chunk_id", "rank", k=rrf_k).withColumnRenamed("score", "rrf_score")
    x = fused.join(bm25.drop("bm25_rank"), [query, "chunk_id"], "left").join(dense.drop("dense_rank"), [query, "chunk_id"], "left")
    if reranked is None:
        x = x.withColumn("reranker_score", F.lit(None).cast("double")).withColumn("score", F.col("rrf_score"))
    else:
        x = x.join(reranked, [query, "chunk_id"]).withColumn("score", F.col("reranker_score"))
    top = vectors.top_ranked(x.withColumn("__s", F.round("score", 12)), query, "chunk_id", "__s", k=k).drop("__s")
    return top.join(found.drop("shown", "unit"), "chunk_id", "left")
