"""Time resampling of ticks and bars. All forms are plain grouped aggregates with map-side partials."""
from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import ceil_to, floor_to

_UNIT = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def timeframe_seconds(tf: str) -> int:
    m = re.fullmatch(r"(\d+)([smhd])", tf)
    if not m:
        raise ValueError(f"bad timeframe {tf!r}")
    return int(m.group(1)) * _UNIT[m.group(2)]


def ticks_to_bars(ticks: DataFrame, step: int, keys: Sequence[str] = ("symbol",), ts: str = "ts",
                  order: Sequence[str] = ("ts",), price: str = "price", volume: str = "volume") -> DataFrame:
    """Left-labelled bars from (price, volume) ticks; ``order`` breaks ties inside a bar."""
    o = F.struct(*order)
    return (ticks.groupBy(*keys, floor_to(F.col(ts), step).alias("_bar"))
            .agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, o).alias("close"),
                 F.sum(volume).alias("volume"))
            .withColumnRenamed("_bar", "ts")
            .select(*keys, "ts", "open", "high", "low", "close", "volume"))


def resample(bars: DataFrame, step: int, label: str = "left", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV on a coarser grid. ``left``: bins [t, t+step) labelled t. ``right``: bins (t-step, t]
    labelled t. Bins without a complete bar are absent, gaps are not filled."""
    t = F.col("ts")
    bin_ = {"left": floor_to, "right": ceil_to}[label](t, step)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), t))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), t))
    out = (bars.groupBy(*keys, bin_.alias("_bin"))
           .agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                last("close").alias("close"), F.sum("volume").alias("volume")))
    return (out.withColumnRenamed("_bin", "ts").na.drop(subset=["open", "high", "low", "close"])
            .select(*keys, "ts", "open", "high", "low", "close", "volume"))


def last_per_bin(df: DataFrame, step: int, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per left-labelled bin; bins missing any of them are dropped."""
    t = F.col("ts")
    out = df.groupBy(*keys, floor_to(t, step).alias("_bin")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), t)).alias(c) for c in cols])
    return out.withColumnRenamed("_bin", "ts").na.drop(subset=list(cols))
