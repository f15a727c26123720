"""Peer comparison: blocks of percentiles, composites, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranks import group_key, quantiles


def block(*parts: str) -> Column:
    """Mean of component percentiles; null unless all are known."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return total / len(parts)


def composite(weights: Mapping[str, float]) -> Column:
    """Weighted sum of the blocks with a weight; null if one of them is unknown."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if w > 0:
            total = total + F.col(name) * w
    return total


def mad_outlier(df: DataFrame, cohort: Sequence[str], value: str, *, limit: float = 5.0, least: int = 5, name: str | None = None) -> DataFrame:
    """df with a flag for values further than `limit` scaled median deviations from the cohort's median.

    Both medians are exact, and found without bringing a cohort into one task.
    Null where the value is, or where there are too few values or no spread.
    """
    x = df.withColumn("__g", group_key(cohort))
    center = quantiles(df, cohort, [value], [0.5]).select("__g", F.col(f"{value}_q")[0].alias("__med"), F.col(f"{value}_n").alias("__n"))
    gaps = x.join(center, "__g", "left").withColumn("__gap", F.abs(F.col(value) - F.col("__med")))
    spread = quantiles(gaps, cohort, ["__gap"], [0.5]).select("__g", F.col("__gap_q")[0].alias("__mad"))
    flag = F.when((F.col("__n") >= least) & (F.col("__mad") > 0), F.try_divide(F.col("__gap"), F.col("__mad") * 1.4826) > limit)
    return gaps.join(spread, "__g", "left").withColumn(name or f"{value}_outlier", flag).drop("__g", "__med", "__n", "__gap", "__mad")
