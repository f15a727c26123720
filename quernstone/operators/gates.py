"""Gates over measured values, and a search over evaluated configurations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gates(measures: Mapping[str, tuple[DataFrame, str, str, float]]) -> DataFrame:
    """(check, value, bound, passed): one row per gate.

    measures: name to (one-row table, its column, '>=' or '<=', bound). An
    unknown value does not pass.
    """
    rows = []
    for name, (df, column, way, bound) in measures.items():
        v = F.col(column).cast("double")
        rows.append(df.select(F.lit(name).alias("check"), v.alias("value"), F.lit(float(bound)).alias("bound"), F.coalesce(v >= bound if way == ">=" else v <= bound, F.lit(False)).alias("passed")))
    return reduce(DataFrame.unionByName, rows)


def beam(axes: Mapping[str, Sequence], evaluate: Callable[[dict], tuple], *, width: int = 5) -> list[tuple[tuple, dict]]:
    """Configurations by rising cost, found axis by axis: at each axis the `width` best go on.

    evaluate gives a comparable cost; it is called once per configuration, and
    looks costs up in a table that was made in one pass. A beam as wide as the
    grid finds the grid's optimum.
    """
    seen: dict[tuple, tuple] = {}

    def cost(c: dict) -> tuple:
        k = tuple(sorted(c.items()))
        if k not in seen:
            seen[k] = evaluate(c)
        return seen[k]

    front = [{a: values[0] for a, values in axes.items()}]
    for axis, values in axes.items():
        grown = {tuple(sorted({**c, axis: v}.items())): {**c, axis: v} for c in front for v in values}
        front = sorted(grown.values(), key=lambda c: (cost(c), sorted(map(str, c.items()))))[:width]
    return [(cost(c), c) for c in front]
