"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import abuse, encode, packing, pieces, visible
from quernstone.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.improper_pieces(table(spark, d, "production_retrieval_results"), table(spark, d, "documents"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "documents"), "doc_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    documents = visible.alike_pairs(visible.form_keys(table(spark, d, "documents"), "doc_id", "text"))
    rows = visible.form_keys(table(spark, d, "theme_documents"), "theme_row_id", "title")
    catalog = visible.form_keys(table(spark, d, "title_catalog"), "title_id", "title")
    titles = visible.alike_titles(rows, catalog)
    return documents.select(F.lit("documents").alias("tbl"), "key_a", "key_b").unionByName(
        titles.select(F.lit("theme_documents").alias("tbl"), "key_a", "key_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return visible.forms(table(spark, d, "documents"), "doc_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_gaps(spark: SparkSession, d: str) -> DataFrame:
    return packing.gaps(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_column(table(spark, d, "documents"), "doc_id", "text").where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_column(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d), "source")


QUERIES = {
    q.__name__: q
    for q in (p1_found, p1_pieces, p3_found, p3_forms, p6_ids, p7_containers, p7_gaps, p8_found, p8_scores, p8_source_rates)
}
