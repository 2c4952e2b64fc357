"""Checks of whole result sets: does a rule beat its own directions dealt at random, and how many such finds are luck."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators import stats
from ..operators.prefix import Run, running
from ..operators.quantiles import exact_quantiles
from ..operators.store import stored
from ..sources.readers import small

# Multipliers of the round function, 31-bit arithmetic so that any SQL engine can repeat it
_M31, _A, _B, ROUNDS = (1 << 31) - 1, 739982445, 695872825, 5


def _round_value(right, iteration, no: int, seed: int):
    """Pseudo-random bits of one round, from the middle of a square; works on numpy arrays."""
    x = (right * _A + iteration * _B + (no * 7919 + seed * 15485863 + 1) * 104729) & _M31
    return (x * x) >> 24


def shuffled(pos: np.ndarray, n: np.ndarray, iteration: np.ndarray, seed: int) -> np.ndarray:
    """Place of each position below ``n`` in permutation number ``iteration``: a Feistel network over the next even
    power of two, walked on until it lands below n. No table, no sort; one position at a time is enough."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.int64)
    mask = (np.int64(1) << half) - 1
    x, half, mask, n, iteration = (np.array(a) for a in np.broadcast_arrays(pos, half, mask, n, iteration))
    live = np.ones(x.shape, dtype=bool)
    while live.any():
        h, m, t = half[live], mask[live], iteration[live]
        left, right = x[live] >> h, x[live] & m
        for no in range(ROUNDS):
            left, right = right, left ^ (_round_value(right, t, no, seed) & m)
        x[live] = (left << h) | right
        live &= x >= n
    return x


def shuffled_sql(x: str, half: str, iteration: str, seed: int) -> str:
    """One walk of the same network as a SQL expression; ``half`` is the number of bits of a half."""
    left, right = f"(({x}) >> {half})", f"(({x}) & ((1 << {half}) - 1))"
    for no in range(ROUNDS):
        f = f"((({right})*{_A} + ({iteration})*{_B} + {(no * 7919 + seed * 15485863 + 1) * 104729}) & {_M31})"
        left, right = right, f"xor({left}, (({f}*{f}) >> 24) & ((1 << {half}) - 1))"
    return f"((({left}) << {half}) | ({right}))"


def permutation_test(ev: DataFrame, by: Sequence[str], order: Sequence[str], iters: int, seed: int = 42,
                     direction: str = "signal_dir", ret: str = "gross_r") -> DataFrame:
    """Per group: n, mean return and p_value, the share of permutations (the data as they are counted as one) whose
    mean is at least as high.

    ``ret`` is direction times forward return. A permutation deals the group's directions anew over its forward
    returns: with the long positions put first, then those without direction, then the short ones, the direction that
    falls on a row follows from the row's own position under the permutation, so no rows are joined, sorted or
    collected for it. ``order`` must be unique in a group (it numbers the rows). Rows with a null return or direction
    are left out. Sums are compared at nine digits. Tasks return ``iters`` sums a group.
    """
    by, d, r = list(by), F.col(direction), F.col(ret)
    e = stored(ev.where(r.isNotNull() & d.isNotNull()).select(*by, *order, F.signum(d).alias("_d"), r.alias("_r")))
    n = stored(e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_d") > 0).alias("_long"), F.count_if(F.col("_d") < 0).alias("_short"), F.sum("_r").alias("_sum")))
    at = running(e, by, list(order), [Run("_pos", "count", F.lit(1))], F.lit(0), 1)
    at = at.select(*by, (F.col("_pos") - 1).alias("_pos"), (F.col("_d") * F.col("_r")).alias("_f")).join(small(n.select(*by, "n", "_long", "_short")), by)
    out = T.StructType([*[at.schema[k] for k in by], T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for key, g in p.groupby(by, dropna=False, sort=False):
                f, pos, size = g["_f"].to_numpy(), g["_pos"].to_numpy(), int(g["n"].iloc[0])
                long, short, sums = int(g["_long"].iloc[0]), int(g["_short"].iloc[0]), np.empty(iters)
                step = max(1, 200_000 // len(g))
                for lo in range(0, iters, step):
                    t = np.arange(lo, min(lo + step, iters), dtype=np.int64)[:, None]
                    x = shuffled(pos[None, :], np.int64(size), t, seed)
                    sums[lo:lo + step] = ((x < long).astype(float) - (x >= size - short)) @ f
                yield pd.DataFrame({k: g[k].iloc[:1].to_numpy() for k in by} | {"_s": [sums]})

    sums = at.mapInPandas(deal, out).select(*by, F.posexplode("_s").alias("_t", "_x")).groupBy(*by, "_t").agg(F.sum("_x").alias("_x"))
    high = sums.join(small(n.select(*by, "_sum")), by).groupBy(*by).agg(F.count_if(F.round("_x", 9) >= F.round("_sum", 9)).alias("_high"))
    return n.join(small(high), by).select(*by, "n", (F.col("_sum") / F.col("n")).alias("mean"), ((F.col("_high") + 1) / (iters + 1)).alias("p_value"))


def fdr_adjusted(tests: DataFrame, p: str, order: Sequence[str], within: Sequence[str] = (), depth: int | None = None) -> DataFrame:
    """Adds ``rank`` (by p, then ``order``, from 1), ``m`` (tests) and ``q_value``: the smallest p * m / rank of this
    and all higher ranks (false-discovery rate), at most 1; equal p have equal q.

    The rank is global: it and the minimum over the ranks behind are running values over ranges of about equal depth,
    so no task holds all tests. A null p is no test and gets nulls. ``within`` adjusts families on their own.
    """
    keys, more = list(within) or ["_all"], {} if depth is None else {"depth": depth}
    d = tests.withColumn("_all", F.lit(0))
    real = stored(d.where(F.col(p).isNotNull()))
    r = running(real, keys, [p, *order], [Run("rank", "count", F.lit(1))], F.lit(0), 1, **more)
    r = r.join(small(stored(real.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")))), keys)
    r = stored(r.withColumns({"_v": F.col(p) * F.col("m") / F.col("rank"), "_back": -F.col("rank")}))
    r = running(r, keys, ["_back"], [Run("q_value", "min", F.col("_v"))], F.lit(0), 1, **more)
    r = r.withColumn("q_value", F.least("q_value", F.lit(1.0))).drop("_v", "_back")
    return r.unionByName(d.where(F.col(p).isNull()), allowMissingColumns=True).drop("_all")


# Limits of the stricter verdict
MIN_TRADES, MIN_SHARPE, MIN_MAE, MAX_P, MAX_Q = 100, 0.5, -0.005, 0.10, 0.10
GATES = ("trades_ok", "sharpe_ok", "mae_ok", "permutation_ok", "discovery_ok")


def gates(ev: DataFrame, by: Sequence[str], order: Sequence[str], train: int, test: int, step: int, cost: float, iters: int,
          seed: int = 42, ret: str = "gross_r", mae: str = "mae_proxy") -> DataFrame:
    """One row per group: n, fold_sharpe (mean over sample deviation of the net returns in all test folds, by the root
    of trades a year), mae_median, p_value and q_value of the permutation test, recent_positive (the two latest folds
    have trades and gain), one column for each of ``GATES``, and how many of them ``failed``. A missing value fails
    its gate. Groups here are rules, so results are small; events are read in jobs of their own."""
    by, ev = list(by), stored(ev)
    net = F.col(ret) - cost
    pooled = stats.assign_folds(ev, by, train, test, step).groupBy(*by).agg(F.count(ret).alias("_n"), F.avg(net).alias("_mean"), F.stddev_samp(net).alias("_std"))
    fs = stored(stats.fold_stats(ev, by, train, test, step, ret))
    late = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("test_start")))
    recent = fs.withColumn("_k", late).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_folds"), (F.count_if((F.col("_k") <= 2) & (F.col("n") > 0) & (F.col("mean") > cost)) == 2).alias("recent_positive"))
    p = fdr_adjusted(stored(permutation_test(ev, by, order, iters, seed, ret=ret)), "p_value", by).select(*by, "n", "p_value", "q_value")
    m = exact_quantiles(ev, by, mae, {"mae_median": 0.5})
    d = p.join(pooled, by, "left").join(recent, by, "left").join(m, by, "left")
    year = F.col("_n") / (F.col("_folds") * test / 365.0)
    d = d.withColumn("fold_sharpe", F.when((F.col("_n") >= 2) & (F.col("_std") > 0), F.col("_mean") / F.col("_std") * F.sqrt(year)).otherwise(0.0))
    checks = (F.col("n") >= MIN_TRADES, F.col("fold_sharpe") > MIN_SHARPE, F.col("mae_median") > MIN_MAE, F.col("p_value") < MAX_P, F.col("q_value") <= MAX_Q)
    d = d.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in zip(GATES, checks)}).withColumn("recent_positive", F.coalesce("recent_positive", F.lit(False)))
    failed = sum((F.when(F.col(name), 0).otherwise(1) for name in GATES), F.lit(0))
    return d.select(*by, "n", "fold_sharpe", "mae_median", "p_value", "q_value", "recent_positive", *GATES, failed.alias("failed"))


def stricter(verdicts: DataFrame, gated: DataFrame, by: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """``verdict`` after the gates: two failures or more make it FAIL, one makes a PASS BORDERLINE, and so does a loss
    in one of the two latest folds. Groups without gates fail."""
    d = verdicts.join(small(gated), list(by), "left")
    v = F.col(verdict)
    new = (F.when(F.col("failed").isNull() | (F.col("failed") >= 2), "FAIL")
           .when((v == "PASS") & ((F.col("failed") == 1) | ~F.col("recent_positive")), "BORDERLINE").otherwise(v))
    return d.withColumn("stricter_verdict", new)
