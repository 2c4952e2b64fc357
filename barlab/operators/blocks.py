"""Blocks with a halo: bounded windows in parallel inside one series.

A row-based window of n rows needs only its n-1 predecessors. Rows are cut into blocks of ``block``
positions, and each block also receives the rows just before (and after) it. Windows then partition by
(keys, blk), run in parallel inside one symbol, and give exactly the same values as a window over the
whole symbol on the block's own rows; halo rows are dropped at the end.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

BLK, OWN = "blk", "own"


def with_halo(df: DataFrame, back: int, forward: int, block: int, pos: str = "idx") -> DataFrame:
    """Copy each row into every block that needs it; ``own`` marks its home block."""
    i = F.col(pos)
    first = F.greatest(F.floor((i - forward) / block), F.lit(0))
    last = F.floor((i + back) / block)
    return (df.withColumn(BLK, F.explode(F.sequence(first, last)))
            .withColumn(OWN, F.col(BLK) == F.floor(i / block)))


def block_window(keys: Sequence[str], pos: str = "idx") -> WindowSpec:
    return Window.partitionBy(*keys, BLK).orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(OWN, BLK)


def in_blocks(df: DataFrame, keys: Sequence[str], build, back: int = 0, forward: int = 0, ts: str = "ts",
              span: int = 86400 * 30, block: int = 16384, order: Sequence[str] | None = None,
              keep_index: bool = False) -> DataFrame:
    """Run ``build(df, w)`` with a window over bounded history and future, in parallel inside each key.

    ``build`` may add any windows over ``w`` that look at most ``back`` rows back and ``forward`` rows
    ahead. ``df`` is read twice (its keys and times once more for the positions).
    """
    from .prefix import row_index
    order = list(order or [ts])
    d = row_index(df, keys, order, F.col(ts), span)
    d = with_halo(d, back, forward, max(block, back + forward))
    d = drop_halo(build(d, block_window(keys)))
    return d if keep_index else d.drop("idx")
