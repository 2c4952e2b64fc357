"""Exact order statistics of groups of every size, in one way.

The values of a group become a histogram of value and count, summed in part before the shuffle, so ties are one row
however many they are. A running count over the histogram, in ranges of about equal depth (``prefix.running``), says which ranks a
value holds; the wanted ranks are picked in a plain aggregation. No task holds a group, no plan depends on a size.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.readers import small
from .prefix import DEPTH, Run, running
from .store import stored


def ranked(df: DataFrame, by: Sequence[str], col: str | Column, depth: int = DEPTH) -> DataFrame:
    """One row per group and different value: by..., _x, _n (rows with it), _cum (rows up to it), _all (rows of the group).
    Nulls in the column and rows with a null key are left out."""
    by = list(by)
    x = F.col(col) if isinstance(col, str) else col
    d = df.select(*by, x.alias("_x"))
    for c in d.columns:
        d = d.where(F.col(c).isNotNull())
    h = stored(d.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n")))
    total = h.groupBy(*by).agg(F.sum("_n").alias("_all"))
    c = running(h, by, ["_x"], [Run("_cum", "sum", F.col("_n"))], F.lit(0), 1, depth)
    return c.join(small(total), by)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_cum") - F.col("_n")) & (rank < F.col("_cum"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str | Column, qs: dict[str, float], depth: int = DEPTH) -> DataFrame:
    """Linear-interpolated quantiles per group: one column per name in ``qs``. A histogram of more than ``depth`` values is
    cut in ranges; the result does not depend on it."""
    by = list(by)
    if not by:  # one group: the same code under a constant key
        return exact_quantiles(df.withColumn("_one", F.lit(0)), ["_one"], col, qs, depth).drop("_one")
    picks = []
    for i, p in enumerate(qs.values()):
        pos = (F.col("_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when(_holds(rank), F.col("_x"))).alias(f"_{side}{i}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f{i}"))
    d = ranked(df, by, col, depth).groupBy(*by).agg(*picks)
    lo, hi = (lambda i: F.col(f"_lo{i}")), (lambda i: F.col(f"_hi{i}"))
    return d.select(*by, *[(lo(i) + (hi(i) - lo(i)) * F.col(f"_f{i}")).alias(k) for i, k in enumerate(qs)])


def top_sum(df: DataFrame, by: Sequence[str], col: str, share: float, out: str, depth: int = DEPTH) -> DataFrame:
    """Sum of the largest ceil(share * n) values per group (at least one): a value gives as many of its rows as ranks above
    the cut are left to it."""
    by = list(by)
    k = F.greatest(F.lit(1), F.ceil(F.col("_all") * share))
    mine = F.greatest(F.lit(0), F.least(F.col("_n"), k - (F.col("_all") - F.col("_cum"))))
    return ranked(df, by, col, depth).groupBy(*by).agg(F.sum(F.col("_x") * mine).alias(out))
