"""Coverage, exclusion counters and reconciliation of row sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, present, zero): non-null and zero counts of numeric columns, in one pass."""
    counts = df.agg(*[F.count(c).alias(f"{c}__n") for c in columns], *[F.count_if(F.col(c) == 0).alias(f"{c}__z") for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}__n").alias("present"), F.col(f"{c}__z").alias("zero")) for c in columns])).alias("f")).select("f.*")


def first_reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that holds; a rule that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def exclusion_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(reason, n): rows by their first reason; null counts the accepted ones."""
    return df.select(first_reason(rules).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Expected keys that are not present."""
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def coverage_ratio(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: expected and covered keys and their ratio; null where nothing is expected."""
    e = expected.select(key).distinct().join(present.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    return e.agg(F.count(F.lit(1)).alias("expected"), F.count("__in").alias("covered")).withColumn("ratio", F.try_divide("covered", "expected"))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with the side; repeats count. Columns are compared by name."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def within(df: DataFrame, facts: DataFrame, key: Sequence[str], value: str, other: str, tolerance: float) -> DataFrame:
    """df's keys and values beside the facts', and whether both agree; null where either is missing."""
    j = df.select(*key, value).join(facts.select(*key, other), list(key), "left")
    gap = F.abs(F.col(value).cast("decimal(38,6)") - F.col(other).cast("decimal(38,6)"))
    return j.withColumn("agrees", gap <= F.lit(tolerance).cast("decimal(38,6)"))


def rollup_status(df: DataFrame, group: str, status: str, severity: Sequence[str]) -> DataFrame:
    """(group, status): the most severe status of each group; severity lists them from mild to severe."""
    level = F.array_position(F.array(*map(F.lit, severity)), F.col(status))
    return df.groupBy(group).agg(F.max(level).alias("__l")).select(group, F.get(F.array(*map(F.lit, severity)), (F.col("__l") - 1).cast("int")).alias("status"))
