"""Version histories: what was visible at a cutoff, which version holds, where versions contradict each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, as_of: Column, *, own_day: str, pub_day: str) -> DataFrame:
    """Rows whose own day and publication day both lie on or before the cutoff. Null days are never visible."""
    return df.where((F.col(own_day) <= as_of) & (F.col(pub_day) <= as_of))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The greatest row of each key, by a maximum that combines before the shuffle.

    order: ascending sort columns; the row with the greatest list wins. A hot
    key costs one row per map task, unlike a window over its rows.
    """
    best = F.max_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{k}").alias(k) for k in keep])


def conflicts(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys that hold different payloads, with the number of rows; equal rows that repeat are no conflict."""
    seen = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("versions"), F.min(seen).alias("__lo"), F.max(seen).alias("__hi"))
        .where("__lo <> __hi").drop("__lo", "__hi")
    )


def first_seen(df: DataFrame, content: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The first row of each content, with the number of rows that repeat it."""
    first = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("first")
    return df.groupBy(*content).agg(first, F.count(F.lit(1)).alias("copies")).select(*content, *[F.col(f"first.{k}").alias(k) for k in keep], "copies")


def with_previous(df: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], steps: int = 2) -> DataFrame:
    """Each row beside the `steps` rows before it in its key's order: column c of n steps back is c_n."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumns({f"{c}_{n}": F.lag(c, n).over(w) for n in range(1, steps + 1) for c in columns})
