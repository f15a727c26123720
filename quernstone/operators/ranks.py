"""Places and exact quantiles within groups of any size.

A window over a group sorts all its rows in one task. Here equal values are
counted first, the counts are range-partitioned by group and value, so that a
large group spans many tasks, and running totals are put together from totals
per partition: as many rows as a group has partitions, not as it has values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import settled, shuffle_partitions


def group_key(columns: Sequence[str]) -> Column:
    """One text for a list of group columns; nulls are values like any other."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")


def unpivot(df: DataFrame, keep: Sequence[str | Column], values: Sequence[str]) -> DataFrame:
    """(kept columns, measure, value): one row per known, finite value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")
    return df.select(*keep, pairs).select("*", "m.measure", "m.value").drop("m").where(F.col("value").isNotNull() & ~F.isnan("value"))


def places(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, value, equal, before, total): rows of each value, below it, and in the group. Group columns are not null."""
    g = list(group)
    counts = long.groupBy(*g, "value").agg(F.count(F.lit(1)).alias("equal"))
    # written once: a range partition is drawn by sampling, and its numbers must not change between reads
    ranged = settled(counts.repartitionByRange(shuffle_partitions(long.sparkSession), *g, "value").withColumn("__p", F.spark_partition_id()))
    parts = ranged.groupBy(*g, "__p").agg(F.sum("equal").alias("__n"))
    whole = Window.partitionBy(*g)
    parts = parts.withColumns({
        "__off": F.coalesce(F.sum("__n").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("__n").over(whole),
    }).drop("__n")
    inside = Window.partitionBy(*g, "__p").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("__in", F.coalesce(F.sum("equal").over(inside), F.lit(0)))
    return within.join(parts, [*g, "__p"]).select(*g, "value", "equal", (F.col("__off") + F.col("__in")).alias("before"), "total")


def midranks(df: DataFrame, key: str, cohort: Sequence[str], values: Mapping[str, bool], *, least: int = 5) -> DataFrame:
    """df with v_pct for each value v: its percentile among its peers.

    values: name to whether higher is better. Ties share the middle of their
    places, a constant or single-member cohort is 50, lower-is-better is the
    reverse of the percentile; a null or NaN value, or a cohort with fewer than
    `least` values, has none. `key` is unique and not null.
    """
    # read for counting and for the answer
    df = settled(df)
    long = unpivot(df, [key, group_key(cohort).alias("__g")], list(values))
    p = places(long, ["__g", "measure"])
    percent = F.when(F.col("total") == F.col("equal"), F.lit(50.0)).otherwise(F.try_divide(F.col("before") + (F.col("equal") - 1) / 2, F.col("total") - 1) * 100)
    reverse = F.col("measure").isin(*[v for v, up in values.items() if not up] or [""])
    scored = p.where(F.col("total") >= least).select("__g", "measure", "value", F.when(reverse, 100 - percent).otherwise(percent).alias("pct"))
    wide = long.join(scored, ["__g", "measure", "value"]).groupBy(key).agg(*[F.max(F.when(F.col("measure") == v, F.col("pct"))).alias(f"{v}_pct") for v in values])
    return df.join(wide, key, "left")


def quantiles(df: DataFrame, cohort: Sequence[str], values: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(__g, v_q for each value, v_n): exact linear-interpolated quantiles of known values as arrays, and their number.

    __g is group_key(cohort); a cohort without known values is missing.
    """
    p = places(unpivot(df, [group_key(cohort).alias("__g")], list(values)), ["__g", "measure"])
    out = []
    for v in values:
        mine = F.col("measure") == v
        parts = []
        for q in at:
            h = (F.col("total") - 1) * F.lit(float(q))
            value_at = lambda place: F.max(F.when(mine & (F.col("before") <= place) & (place < F.col("before") + F.col("equal")), F.col("value")))
            low, high = value_at(F.floor(h)), value_at(F.ceil(h))
            share = F.max(F.when(mine, h - F.floor(h)))
            parts.append(low + (high - low) * share)
        out += [F.array(*parts).alias(f"{v}_q"), F.coalesce(F.max(F.when(mine, F.col("total"))), F.lit(0)).alias(f"{v}_n")]
    return p.groupBy("__g").agg(*out)
