"""Null-safe arithmetic: unknown is not zero, and nothing undefined becomes a number.

A null operand, a denominator at or below 0 and a result that is not finite all
give null. Every helper is a plain expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.operators.rejects import NUMBER, UNKNOWN, strip

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def number(text: Column) -> Column:
    """The finite number that a text states; null for unknowns and for texts that state none."""
    bare = strip(text)
    return finite(F.when(bare.rlike(NUMBER) & ~bare.isin(*UNKNOWN), bare).try_cast("double"))


def number_fault(text: Column) -> Column:
    """True where a text is neither unknown nor a finite number."""
    known = text.isNotNull() & ~strip(text).isin("", *UNKNOWN)
    return known & number(text).isNull()


def divide(a: Column, b: Column, *, positive: bool = True) -> Column:
    ok = b > 0 if positive else b != 0
    return finite(F.when(ok, F.try_divide(a, b)))


def average(a: Column, b: Column) -> Column:
    """Half plus half: the sum of two large numbers could overflow."""
    return a / 2 + b / 2


def difference(a: Column, b: Column) -> Column:
    return finite(a - b)


def growth(now: Column, before: Column) -> Column:
    return divide(now, before) - 1


def cagr(now: Column, before: Column, years: int = 2) -> Column:
    """Compound growth a year; null unless both ends are positive."""
    return finite(F.when((now > 0) & (before > 0), F.expm1((F.log(now) - F.log(before)) / years)))


def capped(x: Column, most: float) -> Column:
    """x, at most `most`; a null stays null."""
    return F.when(x.isNotNull(), F.least(x, F.lit(most)))


def rank_key(x: Column | str, digits: int = 12) -> Column:
    """x to so many significant digits, so that noise in the last places parts no equals; null and what is not finite stay.

    -0 becomes 0, as the two are one value.
    """
    x = F.col(x) if isinstance(x, str) else x
    exact = F.format_string(f"%.{digits - 1}e", x).cast("double") + F.lit(0.0)
    return F.when(F.abs(x) < F.lit(INF), exact).otherwise(x)
