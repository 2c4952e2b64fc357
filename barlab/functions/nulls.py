"""Null-aware comparisons.

Frames here follow the convention of the data they replace: a comparison with a missing operand is
false, except "not equal", which is true. Every rule and window predicate goes through these, so that
warm-up rows behave the same everywhere (a missing slope sign counts as a flip, see README).
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

Num = Column | float | int


def _f(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ne(a: Column, b) -> Column:
    return F.coalesce(a != b, F.lit(True))


def eq(a: Column, b) -> Column:
    return _f(a == b)


def ge(a: Column, b: Num) -> Column:
    return _f(a >= b)


def gt(a: Column, b: Num) -> Column:
    return _f(a > b)


def le(a: Column, b: Num) -> Column:
    return _f(a <= b)


def lt(a: Column, b: Num) -> Column:
    return _f(a < b)


def between(a: Column, lo: Num, hi: Num) -> Column:
    """Half-open range [lo, hi)."""
    return ge(a, lo) & lt(a, hi)


def clean(a: Column) -> Column:
    """NaN to null; Spark orders NaN above everything, so it must not enter a frame."""
    return F.when(~F.isnan(a), a)


def zero_to_null(a: Column) -> Column:
    return F.nullif(a, F.lit(0.0))


def sign(a: Column) -> Column:
    return F.signum(a)


def flag(c: Column) -> Column:
    return c.cast("int")
