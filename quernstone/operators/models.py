"""Encoders and rerankers that are handed in.

A model is any object with `encode(texts) -> rows of numbers` or
`rerank(query, texts) -> numbers`; it is pickled to the workers and called
with batches. LatentEncoder and TrainedReranker are trained here; HashEncoder
and OverlapReranker have no weights and serve as baselines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import normal

BATCH = 256
#: Bounds of the samples that models are fitted to.
LATENT_SAMPLE = 4_000
RERANK_SAMPLE = 4_000


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


class HashEncoder:
    """Counts of character trigrams, dealt to a fixed number of places by a checksum; unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            t = t.casefold()
            at = [zlib.crc32(t[k : k + 3].encode("utf-8", "surrogatepass")) % self.dim for k in range(max(1, len(t) - 2))]
            out[i] = np.bincount(at, minlength=self.dim)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class OverlapReranker:
    """Share of the query's character pairs that a text holds."""

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        pairs = {query[i : i + 2].casefold() for i in range(len(query) - 1)}
        return [sum(p in t.casefold() for p in pairs) / max(1, len(pairs)) for t in texts]


def _features(texts: Sequence[str], width: int) -> np.ndarray:
    """Damped counts of words and of pairs of neighbouring characters, dealt to `width` places by a checksum."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        t = normal(t)
        found = [*t.split(), *(t[k : k + 2] for k in range(len(t) - 1))]
        at = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % width for x in found]
        out[i] = np.log1p(np.bincount(at, minlength=width))
    return out


class LatentEncoder:
    """Latent semantic vectors: features weighted by rarity, projected on the main directions of the texts it was fitted to.

    It is fitted on the driver to a bounded sample (`LATENT_SAMPLE` texts); encoding is a matrix product.
    """

    def __init__(self, rarity: np.ndarray, directions: np.ndarray):
        self.rarity, self.directions = rarity, directions

    @staticmethod
    def fit(texts: Sequence[str], *, width: int = 2048, dim: int = 64) -> LatentEncoder:
        x = _features(texts, width)
        rarity = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x *= rarity
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        top = np.argsort(values)[::-1][:dim]
        v = vectors[:, top]
        # a direction and its opposite are one: the larger part is made positive
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
        return LatentEncoder(rarity, v.astype(np.float32))

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        v = (_features(texts, len(self.rarity)) * self.rarity) @ self.directions
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(size > 0, size, 1)


class TrainedReranker:
    """The chance that a text answers a query, by logistic regression on how they meet.

    Signs: cosine of their latent vectors, the share of the query's words and
    character pairs that the text holds, whether it holds the query as it
    stands, and the text's length. Trained on the driver from at most
    `RERANK_SAMPLE` judged pairs.
    """

    def __init__(self, encoder: LatentEncoder, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.encoder, self.weights, self.mean, self.spread = encoder, weights, mean, spread

    @staticmethod
    def signs(encoder: LatentEncoder, query: str, texts: Sequence[str]) -> np.ndarray:
        q = normal(query)
        words, pairs = set(q.split()), {q[i : i + 2] for i in range(len(q) - 1)}
        near = encoder.encode(texts) @ encoder.encode([query])[0]
        out = np.zeros((len(texts), 5))
        for i, t in enumerate(map(normal, texts)):
            out[i] = near[i], sum(w in t for w in words) / max(1, len(words)), sum(p in t for p in pairs) / max(1, len(pairs)), q in t, np.log1p(len(t))
        return out

    @staticmethod
    def fit(encoder: LatentEncoder, judged: Sequence[tuple[str, str, bool]], *, rounds: int = 300, rate: float = 0.5, damping: float = 1e-3) -> TrainedReranker:
        x = np.vstack([TrainedReranker.signs(encoder, q, [t]) for q, t, _ in judged]) if judged else np.zeros((0, 5))
        y = np.array([g for _, _, g in judged], float)
        mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(5), np.ones(5))
        z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
        w = np.zeros(6)
        for _ in range(rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-z @ w))
            w -= rate * (z.T @ (p - y) / len(y) + damping * w)
        return TrainedReranker(encoder, w, mean, spread)

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        z = (self.signs(self.encoder, query, texts) - self.mean) / self.spread
        return (1 / (1 + np.exp(-(z @ self.weights[:-1] + self.weights[-1])))).tolist()


def sample(df: DataFrame, key: str, columns: Sequence[str], rows: int) -> list:
    """At most `rows` rows, the first in the order of a hash of their key: the same however the data are partitioned."""
    return df.orderBy(F.xxhash64(key), key, *columns).limit(rows).select(*columns).collect()


def encode_distinct(df: DataFrame, text: str, model: Encoder) -> DataFrame:
    """(text_key, embedding): every distinct non-null text once; text_key is its MD5 digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                v = np.asarray(model.encode(part.column(1).to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))], names=["text_key", "embedding"])

    once = df.where(F.col(text).isNotNull()).select(F.md5(text).alias("text_key"), F.col(text).alias("t")).groupBy("text_key").agg(F.min("t").alias("t"))
    return once.mapInArrow(run, "text_key string, embedding array<float>")


def rerank(candidates: DataFrame, query: str, query_text: str, item: str, text: str, model: Reranker) -> DataFrame:
    """(query, item, rerank_score) of candidates that were cut to a bounded number per query before."""
    types = [candidates.schema[c].dataType.simpleString() for c in (query, item)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, texts = b.column(1).to_pylist(), b.column(3).to_pylist()
            by: dict[str, list[int]] = {}
            for i, q in enumerate(asked):
                by.setdefault(q, []).append(i)
            score = np.zeros(b.num_rows)
            for q, at in by.items():
                score[at] = model.rerank(q, [texts[i] or "" for i in at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score)], names=[query, item, "rerank_score"])

    return candidates.select(query, query_text, item, text).mapInArrow(run, f"`{query}` {types[0]}, `{item}` {types[1]}, rerank_score double")
