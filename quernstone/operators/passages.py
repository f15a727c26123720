"""Passage retrieval: sentences scored once per distinct text, shown with every dated version.

Corpus statistics count distinct passages of an issuer; a passage that several
documents repeat is one unit, and each document that holds it stays as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import sentences
from quernstone.functions import text as tx
from quernstone.operators import lexical


def passages(df: DataFrame, doc: str, text: str, issuer: str, *keep: str) -> DataFrame:
    """(doc, issuer, kept columns, char_start, char_end, excerpt, norm, unit): the sentences of every document, long ones in windows.

    Units serve all queries alike, so that windows go in strides and not around
    the hits of one. norm is the excerpt in normal form, unit a digest of the issuer and it.
    Documents without an issuer or text have none. Excerpts are cut where the
    text is read, without a shuffle.
    """
    head = df.select(doc, issuer, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema)
    names = [*head.columns, "char_start", "char_end", "excerpt", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [(i, x, y) for i, t in enumerate(texts) for a, e in sentences.spans(t) for x, y in sentences.windows(a, e, []) if not t[x:y].isspace()]
                owner = pa.array([i for i, _, _ in found], pa.int64())
                cut = [texts[i][x:y] for i, x, y in found]
                yield pa.RecordBatch.from_arrays([
                    *[c.take(owner) for c in part.columns[:-1]], pa.array([x for _, x, _ in found], pa.int64()), pa.array([y for _, _, y in found], pa.int64()),
                    pa.array(cut, pa.string()), pa.array(map(tx.normal, cut), pa.string()),
                ], names=names)

    known = df.where(F.col(text).isNotNull() & F.col(issuer).isNotNull()).select(doc, issuer, *keep, F.col(text).cast("string").alias("__text"))
    x = known.mapInArrow(run, f"{fields}, char_start bigint, char_end bigint, excerpt string, norm string")
    return x.withColumn("unit", F.md5(F.concat_ws("\u0001", F.col(issuer), F.col("norm"))))


def search(found: DataFrame, issuer: str, doc: str, day: str, queries: DataFrame, query: str, query_text: str, *, per_issuer: int = 5) -> DataFrame:
    """(query, issuer, place, unit, score, versions, newest): the best units of each issuer and query.

    Ties go to the newest version, then to the smallest unit. An issuer's score
    is that of its first unit, never a sum.
    """
    units = found.groupBy("unit").agg(F.first(issuer).alias(issuer), F.first("norm").alias("norm"), F.count_distinct(doc).alias("versions"), F.max(day).alias("newest"))
    asked = queries.withColumn(query_text, tx.norm(F.col(query_text)))
    scored = lexical.bm25(units, "unit", "norm", asked, query, query_text).join(units.drop("norm"), "unit")
    w = Window.partitionBy(query, issuer).orderBy(F.desc(F.round("score", 8)), F.desc_nulls_last("newest"), "unit")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_issuer).select(query, issuer, "place", "unit", "score", "versions", "newest")
