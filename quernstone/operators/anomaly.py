"""Reconstruction error of cohort members under their cohort's main components.

Features are scaled by median and interquartile range, centred, and projected
on at most two components; a member stands out if its squared residual exceeds
the cohort's 95th percentile by more than rounding noise.

A cohort enters as sums, not as rows: medians, ranges, means and the matrix of
products of scaled features are aggregates that combine before the shuffle. The
matrix is as small as the number of features, whatever the cohort's size, so a
cohort that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.ranks import group_key, quantiles
from quernstone.session import settled

LEAST = 12


def residuals(df: DataFrame, cohort: Sequence[str], key: str, features: Sequence[str], *, least: int = LEAST) -> DataFrame:
    """(key, cohort, error, threshold, flagged, skipped) of every row.

    skipped names why a row has no error: 'no_cohort' (a part of it is null),
    'incomplete' (a feature is null or not finite), 'small_cohort' (fewer than `least` complete rows),
    'few_active_features' (fewer than two features with spread).
    """
    fs = list(features)
    complete = F.lit(True)
    for f in fs:
        complete = complete & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf"))
    placed = F.lit(True)
    for c in cohort:
        placed = placed & F.col(c).isNotNull()
    complete = complete & placed
    base = df.select(key, *cohort, *fs).withColumn("__ok", complete)
    full = base.where("__ok")
    # written once: read for the quantiles and for scaling
    full = settled(full.withColumn("__g", group_key(cohort)))
    spread = quantiles(full, cohort, fs, (0.25, 0.5, 0.75)).withColumn("__n", F.col(f"{fs[0]}_n"))
    scaled = full.join(spread, "__g")
    for f in fs:
        iqr = F.col(f"{f}_q")[2] - F.col(f"{f}_q")[0]
        scaled = scaled.withColumn(f"__x_{f}", F.when(iqr > 0, (F.col(f) - F.col(f"{f}_q")[1]) / iqr).otherwise(0.0)).withColumn(f"__a_{f}", (iqr > 0).cast("int"))
    xs = [F.col(f"__x_{f}") for f in fs]
    scaled = scaled.select(key, *cohort, "__n", F.array(*xs).alias("__x"), F.array(*[F.col(f"__a_{f}") for f in fs]).alias("__act"))
    pairs = [(i, j) for i in range(len(fs)) for j in range(i, len(fs))]
    moments = scaled.groupBy(*cohort).agg(
        F.first("__n").alias("__n"), F.first("__act").alias("__act"), F.array(*[F.avg(F.col("__x")[i]) for i in range(len(fs))]).alias("__m"),
        F.array(*[F.sum(F.col("__x")[i] * F.col("__x")[j]) for i, j in pairs]).alias("__p"),
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def basis(n: pd.Series, act: pd.Series, mean: pd.Series, prod: pd.Series) -> pd.Series:
        """The kept components, row by row; empty where the cohort has too few active features."""
        out = []
        for count, active, m, p in zip(n, act, mean, prod):
            on = np.flatnonzero(np.asarray(active))
            if count < least or len(on) < 2:
                out.append([])
                continue
            s = np.zeros((len(m), len(m)))
            for (i, j), v in zip(pairs, p):
                s[i, j] = s[j, i] = v
            m = np.asarray(m)
            s = s - count * np.outer(m, m)
            values, vectors = np.linalg.eigh(s)
            order = np.argsort(values)[::-1]
            # these are squares of singular values, known to rounding noise of the sums they were made from
            noise = np.finfo(float).eps * max(count, len(m)) * max(float(np.trace(s)), float(count * (m @ m)), 1e-300)
            rank = int((values[order] > noise).sum())
            keep = min(2, len(on) - 1, rank)
            out.append(vectors[:, order[:keep]].T.ravel().tolist())
        return pd.Series(out)

    model = moments.withColumn("__basis", basis("__n", "__act", "__m", "__p")).select(*cohort, "__m", "__basis")
    joined = scaled.join(model, list(cohort))
    centred = F.zip_with("__x", "__m", lambda x, m: x - m)
    size = len(fs)
    c = joined.withColumn("__c", centred)
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    part = lambda i: F.slice("__basis", i * size + 1, size)
    has = lambda i: F.size("__basis") >= (i + 1) * size
    # a function of its own: a second parameter of the lambda would be the index
    stretched = lambda v, by: F.transform(v, lambda x: x * by)
    left = F.col("__c")
    for i in range(2):
        along = F.when(has(i), dot(F.col("__c"), part(i))).otherwise(0.0)
        vector = F.when(has(i), part(i)).otherwise(F.array_repeat(F.lit(0.0), size))
        left = F.zip_with(left, stretched(vector, along), lambda x, y: x - y)
    e = c.withColumn("__r", left).withColumn("error", F.when(F.size("__basis") > 0, dot(F.col("__r"), F.col("__r"))))
    # written once: read for the threshold, for the largest member and for the answer
    e = settled(e.select(key, *cohort, "__n", "__c", "error").withColumn("__g", group_key(cohort)))
    limit = quantiles(e, cohort, ["error"], [0.95]).select("__g", F.col("error_q")[0].alias("threshold"))
    largest = e.groupBy("__g").agg(F.max(dot(F.col("__c"), F.col("__c"))).alias("__big"))
    noise = 100 * float(np.finfo(float).eps) * F.greatest(F.lit(1.0), F.col("__big"))
    scored = e.join(limit, "__g", "left").join(largest, "__g").withColumn("flagged", F.col("error") > F.col("threshold") + noise)
    scored = scored.select(key, *cohort, "error", "threshold", F.coalesce("flagged", F.lit(False)).alias("flagged"),
                           F.when(F.col("__n") < least, "small_cohort").when(F.col("error").isNull(), "few_active_features").alias("skipped"))
    rest = base.where("not __ok").select(key, *cohort, F.lit(None).cast("double").alias("error"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("flagged"), F.when(placed, "incomplete").otherwise("no_cohort").alias("skipped"))
    return scored.unionByName(rest)
