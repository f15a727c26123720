"""Exact dense retrieval and fusion of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import plan_bytes, settled, shuffle_partitions

#: Numbers in one block of vectors; blocks, not vectors, meet each other.
BLOCK_NUMBERS = 65_536
#: Size of the queries' files, or of the written table of their blocks, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _blocks(df: DataFrame, key: str, embedding: str, tag: str) -> DataFrame:
    """Rows of (keys, numbers): unit vectors in blocks, without a shuffle. Null, empty and zero vectors are left out."""
    key_type = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1)
            dims = np.unique(pc.list_value_length(values).to_numpy(zero_copy_only=False))
            for dim in dims:
                pick = np.flatnonzero(pc.list_value_length(values).to_numpy(zero_copy_only=False) == dim)
                m = values.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), int(dim))
                size = np.linalg.norm(m, axis=1)
                pick, m = pick[size > 0], m[size > 0] / size[size > 0][:, None]
                step = max(1, BLOCK_NUMBERS // int(dim))
                for lo in range(0, len(pick), step):
                    keys = b.column(0).take(pa.array(pick[lo : lo + step]))
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), one(keys), one(pa.array(m[lo : lo + step].ravel()))], names=[f"{tag}_dim", f"{tag}_keys", f"{tag}_numbers"])

    usable = df.where(F.col(key).isNotNull() & (F.size(embedding) > 0)).select(key, embedding)
    return usable.mapInArrow(cut, f"{tag}_dim int, {tag}_keys array<{key_type}>, {tag}_numbers array<double>")


def cosine_topk(vectors: DataFrame, vec: str, embedding: str, queries: DataFrame, query: str, query_embedding: str, *, k: int) -> DataFrame:
    """(query, vec, score, rank): the k vectors nearest to each query by cosine, ties by id. Exact.

    A stated query set against all rows, in blocks: blocks of queries meet
    blocks of vectors of equal dimension, each meeting is one matrix product,
    and only the k best of a block go on. Null, empty and zero vectors have no
    score.
    """
    types = [queries.schema[query].dataType.simpleString(), vectors.schema[vec].dataType.simpleString()]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                ids, asked = b.column(1)[i].values, b.column(3)[i].values
                m, q = (b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (2, 4))
                s = np.round(q @ m.T, 12)
                rows, cols = [], []
                for j in range(len(s)):
                    floor = np.partition(s[j], -min(k, s.shape[1]))[-min(k, s.shape[1])]
                    at = np.flatnonzero(s[j] >= floor)
                    rows.append(np.full(len(at), j)), cols.append(at)
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(r)), ids.take(pa.array(c)), pa.array(s[r, c])], names=[query, vec, "score"])

    v, q, few = _blocks(vectors, vec, embedding, "v"), _blocks(queries, query, query_embedding, "q"), 0 < plan_bytes(queries) <= BROADCAST_BYTES
    if not few:
        q = settled(q)
        few = 0 < plan_bytes(q) <= BROADCAST_BYTES
    if few:
        # their files show that the queries are few: they go to the vectors, which stay where they are read
        met = v.join(F.broadcast(q), F.col("v_dim") == F.col("q_dim"))
    else:
        # one dimension is one key: vector blocks are spread over all tasks, and each task gets all query blocks
        n = shuffle_partitions(vectors.sparkSession)
        met = v.withColumn("v_salt", F.pmod(F.xxhash64("v_keys"), F.lit(n)).cast("int")).join(
            q.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), (F.col("v_dim") == F.col("q_dim")) & (F.col("v_salt") == F.col("q_salt")))
    met = met.select("v_dim", "v_keys", "v_numbers", "q_keys", "q_numbers")
    return top_ranked(met.mapInArrow(best, f"`{query}` {types[0]}, `{vec}` {types[1]}, score double"), query, vec, "score", k=k)


def reciprocal_rank_fusion(rankings: DataFrame, query: str, item: str, rank: str, *, k: int = 60) -> DataFrame:
    """(query, item, score): sum of 1/(k + rank) over the lists that hold the item."""
    return rankings.groupBy(query, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def top_ranked(df: DataFrame, query: str, item: str, score: str, *, k: int) -> DataFrame:
    """df with the rank of each row by falling score, ties by item; the k first of each query."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
