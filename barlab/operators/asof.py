"""As-of join, backward and inclusive, with no tolerance."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from .prefix import Run, running


def asof_join_many(left: DataFrame, rights: dict[str, DataFrame], keys: Sequence[str], on: str = "ts",
                   span: int = 86400 * 7, index: str | None = None) -> DataFrame:
    """Attach to each left row the latest row of every series in ``rights`` with ``right.on <= left.on``.

    The matched row is taken as a whole: a null payload stays null and does not fall through to an
    older row. All sides go on one time line and the last row of each series is carried forward by one
    two-level running pass: a hot key is spread over its time chunks, no pairs are formed, and k series
    cost one shuffle of the left side, not k. ``left`` is read twice (once for its keys and times only);
    pass a stored table when it is expensive. Each right needs at most one row per (keys, on).
    ``index`` adds the dense position of the left row within ``keys``.
    """
    keys = list(keys)
    lcols = left.columns
    u = left.withColumn("_side", F.lit(1))
    payload: dict[str, list[str]] = {}
    for tag, r in rights.items():
        payload[tag] = [c for c in r.columns if c not in (*keys, on)]
        # side 0 puts a right row before left rows of the same time
        u = u.unionByName(r.select(*keys, on, F.lit(0).alias("_side"),
                                   F.struct(*payload[tag]).alias(f"_r_{tag}")), allowMissingColumns=True)
    runs = [Run(f"_m_{tag}", "last", F.col(f"_r_{tag}")) for tag in rights]
    if index:
        runs.append(Run(index, "sum", F.col("_side").cast("long")))
    u = running(u, keys, [on, "_side"], runs, F.col(on), span).where(F.col("_side") == 1)
    return u.select(*lcols, *[F.col(f"_m_{t}")[c].alias(c) for t, cs in payload.items() for c in cs],
                    *([(F.col(index) - 1).alias(index)] if index else []))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str],
              on: str = "ts", span: int = 86400 * 7) -> DataFrame:
    return asof_join_many(left, {"m": right.select(*keys, on, *cols)}, keys, on, span)


def hour_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str],
              step: int, on: str = "ts") -> DataFrame:
    """As-of against a left-labelled resample of the same rows. Every left row lies in a bin that
    exists on the right, so the as-of match is the row's own bin: a plain equi-join."""
    keys = list(keys)
    r = right.select(*keys, F.col(on).alias("_bin"), *cols)
    l = left.withColumn("_bin", F.col(on) - F.pmod(F.col(on), F.lit(step)))
    return l.join(r, [*keys, "_bin"], "left").drop("_bin")
