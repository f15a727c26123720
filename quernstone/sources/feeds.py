"""Paged feeds, security directories, disclosure lists and document manifests, from captured data.

Nothing here opens a connection: every function starts from rows or files that
were captured before, so that a replay gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import dates, text
from quernstone.operators.coverage import first_reason


def paged(df: DataFrame, feed: str, page: str, body: str, row_schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of captured pages.

    A body is {"page": n, "pages": n, "total": n, "rows": [...]}. Faults, one
    row per feed and kind: 'invalid_json', 'page_mismatch' (a page says it is
    another), 'total_drift' (pages disagree on totals), 'missing_pages',
    'row_count' (rows and total differ). Rows of faulty feeds come out too.
    """
    schema = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("pages", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("rows", T.ArrayType(row_schema))])
    p = df.select(F.col(feed).alias("feed"), F.col(page).cast("int").alias("page_no"), F.from_json(body, schema).alias("b"))
    per = p.groupBy("feed").agg(
        F.count_if(F.col("b.page").isNull()).alias("bad"), F.count_if(F.col("b.page") != F.col("page_no")).alias("other"), F.count_distinct("b.total", "b.pages").alias("versions"),
        F.count_distinct("page_no").alias("seen"), F.max("b.pages").alias("pages"), F.max("b.total").alias("total"), F.sum(F.coalesce(F.size("b.rows"), F.lit(0))).alias("n"),
    )
    kinds = {"invalid_json": F.col("bad") > 0, "page_mismatch": F.col("other") > 0, "total_drift": F.col("versions") > 1, "missing_pages": F.col("seen") != F.col("pages"), "row_count": F.col("n") != F.col("total")}
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(k)) for k, rule in kinds.items()]), lambda k: k.isNotNull())
    return p.select("feed", "page_no", F.explode("b.rows").alias("r")).select("feed", "page_no", "r.*"), per.select("feed", F.explode(found).alias("fault"))


def securities(df: DataFrame, code: str, name: str, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """df with ticker, market, security_type and reason.

    rules: (pattern of the code, suffix of the ticker, market, type), the first
    that fits holds. reason names why a row is no security: 'no_name',
    'unknown_code' or 'repeated_code' (a ticker with several names).
    """
    bare = F.trim(F.col(code).cast("string"))
    pick = lambda f: F.coalesce(*[F.when(bare.rlike(r[0]), f(r)) for r in rules])
    x = df.withColumns({"ticker": pick(lambda r: F.concat(bare, F.lit(r[1]))), "market": pick(lambda r: F.lit(r[2])), "security_type": pick(lambda r: F.lit(r[3]))})
    names = x.where("ticker is not null").groupBy("ticker").agg((F.min(F.trim(name)) != F.max(F.trim(name))).alias("__many"))
    y = x.join(names, "ticker", "left")
    rules_ = {"no_name": F.coalesce(F.trim(F.col(name)) == "", F.lit(True)), "unknown_code": F.col("ticker").isNull(), "repeated_code": F.col("__many")}
    return y.withColumn("reason", first_reason(rules_)).drop("__many")


def disclosures(df: DataFrame, provider: str, record_id: str, title: str, released_millis: str, first_day: Column, last_day: Column, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """df with document_id, available_at (the market's day), source_type and reason.

    kinds: (pattern of the title, type), the first that fits; other titles are
    'announcement'. reason: 'no_identity', 'no_release' or 'outside_window'.
    """
    day = dates.day_of_millis(F.col(released_millis))
    kind = F.coalesce(*[F.when(F.col(title).rlike(p), F.lit(k)) for p, k in kinds], F.lit("announcement"))
    x = df.withColumns({"document_id": F.concat_ws("-", F.when(F.length(F.trim(F.col(provider))) > 0, F.col(provider)), F.col(record_id).cast("string")), "available_at": day, "source_type": kind})
    rules = {"no_identity": F.col(provider).isNull() | F.col(record_id).isNull(), "no_release": F.col("available_at").isNull(), "outside_window": ~F.col("available_at").between(first_day, last_day)}
    return x.withColumn("reason", first_reason(rules))


MANIFEST = "ticker string, available_at string, source_url string, source_type string, local_path string, source_sha256 string"


def manifest_pages(spark: SparkSession, manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries of a manifest beside the pages of their files, with document_id and reason.

    pages are those of sources.pages.text_pages; an entry names its file by the
    end of its path. reason: 'missing_fields', 'invalid_available_at',
    'invalid_source_url', 'no_file', 'hash_mismatch', or that of the file. The
    id is a digest of what identifies a document, so that a replay gives it again.
    """
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    x = manifest.join(pages.withColumn("__file", file), F.col("local_path") == F.col("__file"), "left")
    identity = F.concat_ws("\n", F.upper("ticker"), "available_at", "source_url", "sha256")
    rules = {
        "missing_fields": F.col("ticker").isNull() | F.col("source_type").isNull() | F.col("local_path").isNull(), "invalid_available_at": dates.strict_day(F.col("available_at")).isNull(),
        "invalid_source_url": ~text.url_ok(F.col("source_url"), allow_user=False), "no_file": F.col("__file").isNull(), "hash_mismatch": F.col("source_sha256").isNotNull() & (F.lower("source_sha256") != F.col("sha256")),
    }
    reason = F.coalesce(first_reason(rules), F.col("reason"))
    return x.select(F.when(reason.isNull(), F.sha2(identity, 256)).alias("document_id"), *manifest.columns, "page_num", F.when(reason.isNull(), F.col("text")).alias("text"), "sha256", reason.alias("reject_reason"))
