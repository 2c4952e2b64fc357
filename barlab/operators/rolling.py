"""Long rolling windows.

A Spark window with a sliding frame evaluates its whole frame again for every row (rows x window work):
fine for a few dozen rows, not for hundreds or thousands. Here Spark partitions the series into halo blocks and sorts them;
inside a block the native rolling kernels of pandas do the O(log n) sliding update.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import BLK


@dataclass(frozen=True)
class Roll:
    """kind: rank, quantile, mean, sum, std (ddof 0), ema, diff, abs, minus, ratio."""
    out: str
    kind: str
    col: str
    n: int = 0
    q: float = 0.0
    min_periods: int | None = None
    other: str = ""
    floor: float | None = None


def _one(p: pd.DataFrame, r: Roll) -> pd.Series:
    x = p[r.col]
    if r.kind == "ema":
        return x.ewm(span=r.n, adjust=False).mean()
    if r.kind == "diff":
        return x.diff(r.n)
    if r.kind == "abs":
        return x.abs()
    if r.kind == "minus":
        return x - p[r.other]
    if r.kind == "ratio":
        d = p[r.other]
        return x / (d.clip(lower=r.floor) if r.floor is not None else d.where(d != 0))
    roll = x.rolling(r.n, min_periods=r.min_periods or r.n)
    if r.kind == "rank":
        return roll.rank(pct=True)
    if r.kind == "quantile":
        return roll.quantile(r.q)
    if r.kind == "mean":
        return roll.mean()
    if r.kind == "sum":
        return roll.sum()
    if r.kind == "std":
        s = roll.std(ddof=0)
        return s.where(s > 0)
    raise ValueError(r.kind)


def back_rows(rolls: Sequence[Roll]) -> int:
    """Rows of history the listed columns need, following their dependencies."""
    need: dict[str, int] = {}
    for r in rolls:
        own = 20 * r.n if r.kind == "ema" else max(r.n - 1, 0) + (1 if r.kind == "diff" else 0)
        need[r.out] = own + max(need.get(r.col, 0), need.get(r.other, 0))
    return max(need.values(), default=0)


def long_rolling(df: DataFrame, keys: Sequence[str], rolls: Sequence[Roll], pos: str = "idx") -> DataFrame:
    """Add the listed columns to a frame already cut by ``with_halo``. Later entries may use earlier ones."""
    schema = T.StructType(df.schema.fields + [T.StructField(r.out, T.DoubleType()) for r in rolls])
    names = schema.fieldNames()

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(pos, ignore_index=True)
        for r in rolls:
            p[r.out] = _one(p, r).astype("float64")
        return p[names]

    return df.groupBy(*keys, BLK).applyInPandas(apply, schema)
