"""Evaluation: rankings with unjudged items, classes, rank correlation, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.ranks import group_key, places, unpivot
from quernstone.session import settled


def ranking_bounds(rankings: DataFrame, judgments: DataFrame, universe: DataFrame, query: str, item: str, *, k: int, maximum: int, threshold: int = 1) -> DataFrame:
    """Per query, lower and upper bounds of precision, recall, NDCG and MRR at k.

    rankings: (query, item, rank); judgments: (query, item, grade), unjudged
    items absent; universe: (query, items) with the number of candidates. An
    unjudged item may have any grade from 0 to `maximum`. Recall and MRR are
    null where no item is or may be relevant, NDCG where none can have a gain.
    """
    judged = rankings.join(judgments, [query, item], "left").withColumns({
        "known": F.col("grade").isNotNull(), "good": F.coalesce(F.col("grade") >= threshold, F.lit(False)), "top": F.col("rank") <= k,
    })
    gain = lambda g: (F.pow(F.lit(2.0), g) - 1) / F.log2(F.col("rank") + 1.0)
    top = F.col("top")
    ranked = judged.groupBy(query).agg(
        F.sum((top & F.col("good")).cast("int")).alias("p"), F.sum((top & ~F.col("known")).cast("int")).alias("u"),
        F.sum(F.when(top, gain(F.coalesce("grade", F.lit(0))))).alias("dcg_lo"), F.sum(F.when(top, gain(F.coalesce("grade", F.lit(maximum))))).alias("dcg_hi"),
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first_good"), F.min(F.when(F.col("good") | ~F.col("known"), F.col("rank"))).alias("first_possible"),
    )
    known = judgments.groupBy(query).agg(F.count(F.lit(1)).alias("judged"), F.sum((F.col("grade") >= threshold).cast("int")).alias("r"))
    w = Window.partitionBy(query).orderBy(F.desc("g"), F.desc(item))
    ideal = lambda rows, name: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy(query).agg(F.sum(gain(F.col("g"))).alias(name))
    ideal_lo = ideal(judgments.select(query, item, F.col("grade").alias("g")), "idcg_lo")
    # with every unjudged item at the maximum: they take the first places
    x = universe.join(known, query, "left").na.fill(0, ["judged", "r"]).withColumn("open", F.col("items") - F.col("judged"))
    places = x.select(query, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"), "open")
    best = judgments.select(query, item, F.col("grade").alias("g")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(query, "place", "g")
    filled = places.join(best, (places[query] == best[query]) & (F.col("place") == F.col("rank") - F.col("open")), "left").select(places[query], "rank", F.when(F.col("rank") <= F.col("open"), F.lit(maximum)).otherwise(F.coalesce("g", F.lit(0))).alias("g"))
    # judged items of the maximal grade stand beside them and change nothing; lower ones follow in order
    ideal_hi = filled.groupBy(query).agg(F.sum(gain(F.col("g"))).alias("idcg_hi"))
    y = x.join(ranked, query, "left").join(ideal_lo, query, "left").join(ideal_hi, query, "left").na.fill(0)
    div = lambda a, b, zero: F.when(b > 0, a / b).otherwise(F.lit(zero))
    p, u, r, open_ = (F.col(c) for c in ("p", "u", "r", "open"))
    return y.select(
        query, (p / k).alias("precision_lo"), ((p + u) / k).alias("precision_hi"),
        F.when(r + open_ > 0, div(p, r + open_ - u, 1.0)).alias("recall_lo"), F.when(r + open_ > 0, div(p + u, r + u, 0.0)).alias("recall_hi"),
        F.when(F.col("idcg_hi") > 0, F.col("dcg_lo") / F.col("idcg_hi")).alias("ndcg_lo"),
        F.when(F.col("idcg_hi") > 0, F.when(F.col("idcg_lo") > 0, F.least(F.lit(1.0), F.col("dcg_hi") / F.col("idcg_lo"))).otherwise((F.col("dcg_hi") > 0).cast("double"))).alias("ndcg_hi"),
        F.when(r + open_ > 0, div(F.lit(1.0), F.col("first_good"), 0.0)).alias("mrr_lo"), F.when(r + open_ > 0, div(F.lit(1.0), F.col("first_possible"), 0.0)).alias("mrr_hi"),
    )


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n) in long form; null labels form a class of their own."""
    return df.groupBy(expected, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of every label that occurs, from the confusion counts alone."""
    c = confusion(df, expected, predicted).withColumn("hit", F.when(F.col(expected).eqNullSafe(F.col(predicted)), F.col("n")).otherwise(0))
    by = lambda col, name: c.groupBy(F.col(col).alias("label")).agg(F.sum("n").alias(name), F.sum("hit").alias(f"{name}_hit"))
    e, q = by(expected, "support"), by(predicted, "named")
    j = e.join(q.withColumnRenamed("label", "label2"), F.col("label").eqNullSafe(F.col("label2")), "full")
    hit = F.coalesce("support_hit", "named_hit", F.lit(0))
    support, named = F.coalesce("support", F.lit(0)), F.coalesce("named", F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select(F.coalesce("label", "label2").alias("label"), support.alias("support"), ratio(hit, named).alias("precision"), ratio(hit, support).alias("recall"), ratio(2 * hit, support + named).alias("f1"))


def macro_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the mean over groups of each group's mean; one unknown value makes the whole unknown."""
    strict = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
    return df.groupBy(group).agg(strict(F.col(value)).alias("m")).agg(strict(F.col("m")).alias("macro"))


def spearman(df: DataFrame, cohort: Sequence[str], a: str, b: str) -> DataFrame:
    """(cohort, n, rho): Pearson correlation of average ranks over rows where both values are known.

    Ranks come from counts of values, so that a cohort of any size is spread
    over many tasks.
    """
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    both = settled(df.where(known).select(*cohort, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b), group_key(cohort).alias("__g")))
    p = places(unpivot(both, ["__g"], [a, b]), ["__g", "measure"])
    rank_of = lambda m, name: p.where(F.col("measure") == m).select("__g", F.col("value").alias(m), (F.col("before") + 1 + (F.col("equal") - 1) / 2).alias(name))
    ranked = both.join(rank_of(a, "__ra"), ["__g", a]).join(rank_of(b, "__rb"), ["__g", b])
    return ranked.groupBy(*cohort).agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("rho"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two arrays; null if both are empty."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint > 0, F.size(F.array_intersect(a, b)) / joint)
