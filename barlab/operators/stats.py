"""Event statistics: summaries, bootstrap, walk-forward folds, diagnostics."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalar import COST_MODES, with_cost_modes
from ..sources.readers import small
from .prefix import Run, running
from .quantiles import exact_quantiles, top_sum
from .store import stored

DAY = 86400


def summary_aggs(r: Column) -> list[Column]:
    """n, mean, hit rate, population std and mean/std of one return column (median: see ``summarize``)."""
    m, s = F.avg(r), F.stddev_pop(r)
    return [F.count(r).alias("n"), F.coalesce(m, F.lit(0.0)).alias("mean"),
            F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
            F.coalesce(s, F.lit(0.0)).alias("std"),
            F.coalesce(F.when(s > 0, m / s), F.lit(0.0)).alias("sharpe_like")]


def summarize(df: DataFrame, by: Sequence[str], ret: str, grid: DataFrame | None = None) -> DataFrame:
    """Summary with the exact median. With ``grid`` (all wanted key combinations) empty cells are zeros."""
    by = list(by)
    d = stored(df.select(*by, F.col(ret).alias("_r")))
    a = d.groupBy(*by).agg(*summary_aggs(F.col("_r")))
    out = a.join(exact_quantiles(d, by, "_r", {"median": 0.5}), by, "left")
    if grid is not None:
        out = grid.join(out, by, "left")
    return out.na.fill(0).select(*by, "n", "mean", "median", "hit_rate", "std", "sharpe_like")


def dense_grid(spark, **axes: list) -> DataFrame:
    """All combinations of a few literal axes, as generators over one row."""
    return expand(spark.range(1), **axes).drop("id")


def expand(df: DataFrame, **axes: list) -> DataFrame:
    """Every row once per combination of the literal axes."""
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def with_t_stat(df: DataFrame) -> DataFrame:
    ok = (F.col("n") > 0) & (F.col("std") > 0)
    return df.withColumns({
        "n_lt_20": F.col("n") < 20,
        "t_stat": F.when(ok, F.col("mean") / (F.col("std") / F.sqrt(F.col("n").cast("double")))).otherwise(0.0)})


def baseline(net: DataFrame, by: Sequence[str], ret: str = "net_r", groups: DataFrame | None = None) -> DataFrame:
    """Metrics per group. With ``groups`` (all wanted key combinations) a group without events has n = 0 and
    null metrics."""
    r = F.col(ret)
    a = net.groupBy(*by).agg(F.count(r).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"),
                             F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"))
    return a if groups is None else groups.select(*by).join(a, list(by), "left").na.fill(0, ["n"])


# --- bootstrap ---------------------------------------------------------------------------------------
# Multipliers of the draw hash, 31-bit arithmetic so that any SQL engine can repeat it
_M31, _A, _B, _LEAF_STEP = (1 << 31) - 1, 739982445, 695872825, 15485863
# Positions of a leaf, inside which draws are made one by one (part of what a result means), and of a task.
LEAF, BLOCK = 65536, 65536


def _draw(x: np.ndarray) -> np.ndarray:
    x = x & _M31
    x ^= x >> 15
    x = (x * _A) & _M31
    x ^= x >> 12
    x = (x * _B) & _M31
    return x ^ (x >> 15)


def draw_sql(b: str, i: str, seed: int, n: str, leaf: str = "0") -> str:
    """The same draw as a SQL expression: 0-based index below n."""
    x = f"(({b})*1000003 + ({i})*7919 + {seed}*104729 + ({leaf})*{_LEAF_STEP}) & {_M31}"
    x = f"(xor({x}, ({x}) >> 15) * {_A}) & {_M31}"
    x = f"(xor({x}, ({x}) >> 12) * {_B}) & {_M31}"
    return f"((xor({x}, ({x}) >> 15) * ({n})) >> 31)"


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """Stirling's series, exact to double precision from ten on; products below."""
    y = np.maximum(x, 10).astype(float) + 1.0
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return np.where(x < 10, np.log(np.cumprod(np.maximum(np.arange(10), 1)).astype(float))[np.minimum(x, 9)], s)


def binomial(k: np.ndarray, p: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """One binomial number (k trials, chance p) for each uniform u: chances are added up from the most likely number
    outwards, above before below, until they exceed u. Takes about sqrt(k) steps, many of them at once."""
    p = np.broadcast_to(np.asarray(p, dtype=float), k.shape)
    q = 1.0 - p
    out = np.minimum(np.floor((k + 1) * p).astype(np.int64), k)
    chance = np.exp(_log_factorial(k) - _log_factorial(out) - _log_factorial(k - out) + out * np.log(p) + (k - out) * np.log(q))
    todo = np.flatnonzero(u >= chance)
    for i in range(0, len(todo), 4096):  # working set stays in the cache
        live = todo[i:i + 4096]
        up, down, above, below, total = out[live], out[live], chance[live], chance[live], chance[live]
        while len(live):
            n, odds, against = k[live, None], (p[live] / q[live])[:, None], (q[live] / p[live])[:, None]
            spread = 1 + int(np.sqrt((n[:, 0] * p[live] * q[live]).max()))
            step = np.arange(min(spread, max(1, 65536 // len(live))))
            over, under = up[:, None] + step, down[:, None] - step
            more = np.cumprod(np.hstack([above[:, None], (n - over) / (over + 1) * odds]), axis=1)[:, 1:]
            less = np.cumprod(np.hstack([below[:, None], under / (n - under + 1) * against]), axis=1)[:, 1:]
            sums = np.cumsum(np.hstack([total[:, None], np.stack([more, less], axis=2).reshape(len(live), -1)]), axis=1)
            past = u[live, None] < sums[:, 1:]
            hit, at = past.any(axis=1), past.argmax(axis=1)
            out[live[hit]] = np.where(at % 2 == 0, up + 1 + at // 2, down - 1 - at // 2)[hit]
            go = ~hit & (sums[:, -1] > sums[:, -3])  # chances too small to count only get smaller
            live, total = live[go], sums[go, -1]
            up, down, above, below = up[go] + len(step), down[go] - len(step), more[go, -1], less[go, -1]
    return out


def tree_draws(n: int, leaf: int, first: int, last: int, iters: int, seed: int, weights: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """How many of the n draws of each iteration fall on the leaves ``first`` to ``last`` (excluded): arrays of some
    leaves x ``iters``, in order. A binary tree over the positions splits them: every node gives its left half a
    binomial share, drawn from (seed, iteration, range of positions) alone, so every task finds the same numbers without
    seeing other leaves, and each node above the wanted leaves is drawn once. ``weights`` of the leaves replace their sizes."""
    sums = None if weights is None else np.concatenate([[0.0], np.cumsum(weights)])
    share = lambda a, b: b - a if sums is None else sums[-(-b // leaf)] - sums[a // leaf]
    b = np.arange(iters, dtype=np.int64)
    together = max(1, 65536 // iters)  # leaves of a subtree whose nodes are drawn level by level

    def halves(lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mid = lo + leaf * (1 << (np.frexp(-(-(hi - lo) // leaf) - 1)[1].astype(np.int64) - 1))
        u = _draw(b * 1000003 + (lo * 31 + hi)[:, None] * 7919 + (seed + 1) * 104729) / float(1 << 31)
        left = binomial(k.ravel(), np.repeat(share(lo, mid) / share(lo, hi), iters), u.ravel()).reshape(k.shape)
        lo, hi, k = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([left, k - left])
        near = (lo < last * leaf) & (hi > first * leaf)
        return lo[near], hi[near], k[near]

    nodes = [(np.array([0]), np.array([n]), np.full((1, iters), n, dtype=np.int64))]
    while nodes:
        lo, hi, k = nodes.pop()
        if hi[0] - lo[0] > together * leaf:
            lo, hi, k = halves(lo, hi, k)
            nodes += [(lo[i:i + 1], hi[i:i + 1], k[i:i + 1]) for i in range(len(lo))][::-1]
            continue
        while (wide := hi - lo > leaf).any():
            below = halves(lo[wide], hi[wide], k[wide])
            lo, hi, k = (np.concatenate([x[~wide], y]) for x, y in zip((lo, hi, k), below))
        yield k[np.argsort(lo)]


def leaf_draws(n: int, leaf: int, cell: int, iters: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many of the n draws of each iteration fall on leaf ``cell``."""
    return next(tree_draws(n, leaf, cell, cell + 1, iters, seed, weights))[0]


def leaf_sums(x: np.ndarray, at: np.ndarray, size: np.ndarray, cell: np.ndarray, cnt: np.ndarray, seed: int,
              weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of the ``cnt`` (leaves x iterations) values drawn from each leaf: ``size`` values of ``x`` from ``at`` on.
    With ``weights`` of the values there is one leaf."""
    iters, k = cnt.shape[1], cnt.ravel()
    out, ends = np.zeros(len(k)), np.cumsum(k)
    cum = None if weights is None else np.cumsum(weights)
    cuts = np.searchsorted(ends, np.arange(0, ends[-1], 100_000), side="right")  # working set stays in the cache
    for lo, hi in pairwise(np.unique([0, *cuts, len(k)])):
        r = lo + np.flatnonzero(k[lo:hi])
        if not len(r):
            continue
        many, c = k[r], r // iters
        start = np.cumsum(many) - many
        base = r % iters * 1000003 - start * 7919 + seed * 104729 + cell[c] * _LEAF_STEP
        u = _draw(np.repeat(base, many) + np.arange(many.sum()) * 7919)
        if cum is None:
            j = ((u * np.repeat(size[c], many)) >> 31) + np.repeat(at[c], many)
        else:
            j = np.minimum(np.searchsorted(cum, u / float(1 << 31) * cum[-1], side="right"), len(x) - 1)
        out[r] = np.add.reduceat(x[j], start)
    return out.reshape(cnt.shape)


def whole_leaves(batches: Iterator[pd.DataFrame], leaf: int, heavy: deque) -> Iterator[pd.DataFrame]:
    """The rows in frames that end where a leaf ends, numbered on from the row (``_blk`` < 0) that leads in each walk.
    Weights of the leaves in that row go to ``heavy``."""
    held: list[pd.DataFrame] = []
    follows = 0
    for a in batches:
        i, head = np.arange(len(a)), a["_blk"].to_numpy() < 0
        if "_cells" in a:
            heavy.extend(a["_cells"][head])
        lead = np.maximum.accumulate(np.where(head, i, -1))
        pos = np.where(lead < 0, follows + i, a["_pos"].to_numpy()[lead] + i - lead - 1)
        follows = pos[-1] + 1 if len(a) else follows
        a = a.assign(_pos=pos)[~head]
        starts = np.flatnonzero(a["_pos"].to_numpy() % leaf == 0)
        if len(starts):
            done = pd.concat([*held, a.iloc[:starts[-1]]], ignore_index=True)
            if len(done):
                yield done
            held, a = [], a.iloc[starts[-1]:]
        held.append(a)
    if held and (done := pd.concat(held, ignore_index=True)).size:
        yield done


def bootstrap_means(values: DataFrame, by: Sequence[str], col: str, order: Sequence[str], iters: int,
                    seed: int, block: int = BLOCK, leaf: int = LEAF, half_life: float | None = None, ts: str = "ts") -> DataFrame:
    """Mean of each of ``iters`` resamples with replacement of size n: one array ``means`` per group.

    ``order`` must be unique inside a group: equal keys would let the draws fall on either value. Positions in that
    order fall into leaves of ``leaf``: a binary tree deals the n draws of an iteration to the leaves, inside a leaf
    they are made one by one. Every number follows from seed, iteration and position, so a result depends on ``leaf``
    but not on ``block``, the positions of one partial sum per iteration. Blocks next to each other, ``BLOCK`` positions
    in all or one larger block, pass through a task in order, a few leaves in memory at a time, and share the tree above.

    With ``half_life`` (days of the time column ``ts``, one of ``order``) a value counts half as much as one that much
    newer: leaves share the draws by their weights, inside a leaf a draw searches the cumulative weights.
    """
    by, per = list(by), max(1, block // leaf)
    v = stored(values.where(F.col(col).isNotNull()).select(*by, *order, F.col(col).alias("_x")))
    n = stored(v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *([F.max(ts).alias("_newest")] if half_life else [])))
    one, many = (small(n.where(c)) for c in (F.col("_n") <= leaf, F.col("_n") > leaf))
    at = v.join(many, by)
    if not many.isEmpty():
        at = running(at, by, list(order), [Run("_pos", "count", F.lit(1))], F.lit(0), 1)
    else:
        at = at.withColumn("_pos", F.lit(1).cast("long"))
    wide = leaf * per * max(1, BLOCK // (leaf * per))  # positions that pass through a task together
    at, alone = at.withColumn("_pos", F.col("_pos") - 1), v.join(one, by)
    weight = []
    if half_life:
        w = F.exp((F.col(ts) - F.col("_newest")) * (-np.log(0.5) / (half_life * DAY)))
        at, alone, weight = at.withColumn("_w", w), alone.withColumn("_w", w), ["_w"]
        cells = at.groupBy(*by, F.floor(F.col("_pos") / leaf).alias("_cell")).agg(F.sum("_w").alias("_w"))
        cells = stored(cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_cell", "_w"))).alias("_cells")))  # one entry for ``leaf`` values
        at = at.join(small(cells), by, "left").withColumn("_cells", F.when(F.col("_pos") % wide == 0, F.col("_cells._w")))
    out = T.StructType([*[at.schema[k] for k in by], T.StructField("_s", T.ArrayType(T.DoubleType()))])
    keycols, ordercols = list(by), list(order)

    def resample(a: pd.DataFrame) -> pd.DataFrame:
        """A group of one leaf."""
        a = a.sort_values(ordercols)
        x, total, s = a["_x"].to_numpy(), len(a), np.zeros(iters)
        w = np.cumsum(a["_w"].to_numpy()) if half_life else None
        step = max(1, 100_000 // total)  # working set stays in the cache
        for lo in range(0, iters, step):
            b = np.arange(lo, min(lo + step, iters), dtype=np.int64)[:, None]
            u = _draw(b * 1000003 + np.arange(total, dtype=np.int64)[None, :] * 7919 + seed * 104729)
            j = (u * total) >> 31 if w is None else np.minimum(np.searchsorted(w, u / float(1 << 31) * w[-1], side="right"), total - 1)
            s[lo:lo + step] = x[j].sum(axis=1)
        return pd.DataFrame({k: a[k].iloc[:1].to_numpy() for k in keycols} | {"_s": [s / total]})

    def resample_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sums of each block, of rows in order of group and position."""
        sums: list[tuple] = []  # key, values of the group, block, sums: the last one may go on

        def table(done: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({k: [d[0][i] for d in done] for i, k in enumerate(keycols)} | {"_s": [d[3] / d[1] for d in done]})

        heavy: deque = deque()
        for a in whole_leaves(batches, leaf, heavy):
            pos, x, w = a["_pos"].to_numpy(), a["_x"].to_numpy(), a["_w"].to_numpy() if half_life else None
            start = np.flatnonzero(pos % leaf == 0)
            size, cells_, new = np.diff([*start, len(a)]), pos[start] // leaf, pos[start] % wide == 0
            for lo, hi in pairwise(np.unique([0, *np.flatnonzero(new), len(start)])):
                at_, size_, cell = start[lo:hi], size[lo:hi], cells_[lo:hi]
                if new[lo]:
                    key, total = tuple(a[k].iloc[at_[0]] for k in keycols), int(a["_n"].iloc[at_[0]])
                    weights = np.asarray(heavy.popleft(), dtype=float) if half_life else None
                    draws = tree_draws(total, leaf, int(cell[0]), min(int(cell[0]) + wide // leaf, -(-total // leaf)), iters, seed, weights)
                    cnt = np.zeros((0, iters), dtype=np.int64)
                while len(cnt) < len(cell):
                    cnt = np.concatenate([cnt, next(draws)])
                if half_life:
                    got = np.concatenate([leaf_sums(x[i:i + m], np.array([0]), np.array([m]), cell[c:c + 1], cnt[c:c + 1], seed, w[i:i + m])
                                          for c, (i, m) in enumerate(zip(at_, size_))])
                else:
                    got = leaf_sums(x, at_, size_, cell, cnt[:len(cell)], seed)
                cnt, blk = cnt[len(cell):], cell // per
                first = np.flatnonzero(np.diff(blk, prepend=-1))
                for i, (b, t) in enumerate(zip(blk[first], np.add.reduceat(got, first, axis=0))):
                    if i == 0 and not new[lo] and sums[-1][2] == b:
                        sums[-1] = (*sums[-1][:3], sums[-1][3] + t)
                    else:
                        sums.append((key, total, b, t))
            if len(sums) > 1:
                yield table(sums[:-1])
                sums = sums[-1:]
        if sums:
            yield table(sums)

    # inside a block nulls of ``order`` come last; a copy of the first row, marked by block -1, leads in each walk
    blk = F.floor(F.col("_pos") / (leaf * per))
    blks = F.when(F.col("_pos") % wide == 0, F.array(F.lit(-1).cast("long"), blk)).otherwise(F.array(blk))
    rows = at.select(*by, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.floor(F.col("_pos") / wide).alias("_walk"), F.explode(blks).alias("_blk"),
                     "_pos", "_x", "_n", *weight, *([F.col("_cells")] if half_life else []))
    if half_life:
        rows = rows.withColumn("_cells", F.when(F.col("_blk") < 0, F.col("_cells")))
    nulls_last = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
    rows = rows.repartition(*by, "_walk").sortWithinPartitions(*by, "_walk", "_blk", *nulls_last).drop(*[f"_o{i}" for i in range(len(order))], "_walk")
    parts = rows.mapInPandas(resample_blocks, out)
    parts = stored(parts.unionByName(alone.groupBy(*by).applyInPandas(resample, out)))
    whole = small(n.where(F.col("_n") <= leaf * per).select(*by))
    done = parts.join(whole, by, "left_semi").select(*by, F.col("_s").alias("means"))
    rest = parts.join(whole, by, "left_anti").select(*by, F.posexplode("_s").alias("iter", "s"))
    rest = rest.groupBy(*by, "iter").agg(F.sum("s").alias("m")).groupBy(*by).agg(F.collect_list("m").alias("means"))  # exactly ``iters`` values
    return done.unionByName(rest)


def bootstrap_ci(means: DataFrame, by: Sequence[str], modes: dict[str, float] | None = None,
                 ci: float = 0.95) -> DataFrame:
    """Confidence limits and share of positive means, per group and cost mode. A constant cost shifts
    every resample mean by itself, so one set of resamples serves all modes."""
    a = (1.0 - ci) / 2.0
    d = means.withColumn("_m", F.array_sort("means"))

    def quantile(q: float) -> Column:
        pos = (F.size("_m") - 1) * F.lit(q)
        lo, hi = (F.get("_m", f(pos).cast("int")) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (pos - F.floor(pos))
    d = d.select(*by, "_m", quantile(a).alias("_lo"), quantile(1.0 - a).alias("_hi"))
    d = with_cost_modes(d, modes or COST_MODES, "_lo", "mean_ci_low")
    return d.select(*by, "mode", "mean_ci_low", (F.col("_hi") - F.col("cost")).alias("mean_ci_high"),
                    (F.size(F.filter("_m", lambda x: x > F.col("cost"))) / F.size("_m")).alias("p_mean_gt_0"))


# --- folds -------------------------------------------------------------------------------------------
def folds(ev: DataFrame, by: Sequence[str], train: int, test: int, step: int, ts: str = "ts") -> DataFrame:
    """Test windows per group: from the first day plus ``train`` days, ``test`` days long, every ``step``
    days, as long as the window ends by the last event."""
    g = ev.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    first = F.col("_lo") - F.pmod(F.col("_lo"), F.lit(DAY)) + train * DAY
    last = F.col("_hi") - test * DAY
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step * DAY)))
    return (g.select(*by, F.posexplode(starts).alias("_k", "test_start"))
            .select(*by, (F.col("_k") + 1).alias("fold_id"), "test_start",
                    (F.col("test_start") + test * DAY).alias("test_end")))


def assign_folds(ev: DataFrame, by: Sequence[str], train: int, test: int, step: int, ts: str = "ts") -> DataFrame:
    """Events with the folds they fall in (several when step < test). The fold number follows from
    arithmetic on the group's first and last time, so there is no range join."""
    by = list(by)
    g = ev.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    first = F.col("_lo") - F.pmod(F.col("_lo"), F.lit(DAY)) + train * DAY
    g = g.select(*by, first.alias("_first"), F.floor((F.col("_hi") - test * DAY - first) / (step * DAY)).alias("_last_k"))
    e = ev.join(small(g), by)
    off = F.col(ts) - F.col("_first")
    k0 = F.greatest(F.lit(0), F.floor((off - test * DAY) / (step * DAY)) + 1)
    k1 = F.least(F.col("_last_k"), F.floor(off / (step * DAY)))
    return (e.withColumn("_k", F.explode(F.when(k0 <= k1, F.sequence(k0, k1))))
            .withColumn("fold_id", (F.col("_k") + 1).cast("int")).drop("_k", "_first", "_last_k"))


def fold_stats(ev: DataFrame, by: Sequence[str], train: int, test: int, step: int, ret: str = "gross_r",
               ts: str = "ts") -> DataFrame:
    """One row per (group, fold), empty folds with n = 0 and a null mean before costs."""
    by = list(by)
    f = folds(ev, by, train, test, step, ts)
    s = assign_folds(ev, by, train, test, step, ts).groupBy(*by, "fold_id").agg(
        F.count(ret).alias("n"), F.avg(ret).alias("mean"))
    return f.join(s, [*by, "fold_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def walkforward(ev: DataFrame, by: Sequence[str], train: int = 60, test: int = 15, step: int = 15,
                modes: dict[str, float] | None = None, ret: str = "gross_r", ts: str = "ts",
                iters: int = 0, seed: int = 42, order: Sequence[str] = ("ts",), groups: DataFrame | None = None) -> DataFrame:
    """Per (group, mode): pooled n and mean over folds, folds with a positive mean, their share, and with
    ``iters`` the bootstrap of the pooled returns (seed + 17; ``order`` must be unique in a group). An empty fold
    counts as mean 0. Groups too short for a fold, and those of ``groups`` without events, have zeros."""
    by = list(by)
    modes = modes or COST_MODES
    fs = with_cost_modes(fold_stats(ev, by, train, test, step, ret, ts), modes, "mean", "_m")
    pos = F.count(F.when(F.col("_m") > 0, 1))
    n = F.sum("n")
    agg = fs.groupBy(*by, "mode").agg(
        n.alias("wf_n"),
        F.when(n > 0, F.sum(F.col("_m") * F.col("n")) / n).otherwise(0.0).alias("wf_mean"),
        pos.alias("positive_folds"), F.count(F.lit(1)).alias("total_folds"),
        (100.0 * pos / F.count(F.lit(1))).alias("positive_pct"))
    every = (ev if groups is None else groups).select(*by).distinct()
    agg = expand(every, mode=list(modes)).join(agg, [*by, "mode"], "left").na.fill(0)
    if iters:
        pooled = assign_folds(ev, by, train, test, step, ts)
        b = bootstrap_means(pooled, by, ret, [*order, "fold_id"], iters, seed + 17)
        ci = bootstrap_ci(b, by, modes).withColumnsRenamed(
            {c: f"wf_{c}" for c in ("mean_ci_low", "mean_ci_high", "p_mean_gt_0")})
        agg = agg.join(ci, [*by, "mode"], "left")
    return agg


# --- diagnostics -------------------------------------------------------------------------------------
# Histogram edges and labels
HIST_EDGES = [-0.01, -0.005, -0.002, 0.0, 0.002, 0.005, 0.01]
HIST_LABELS = ["(-inf,-1%)", "[-1%,-0.5%)", "[-0.5%,-0.2%)", "[-0.2%,0%)", "[0%,0.2%)", "[0.2%,0.5%)",
               "[0.5%,1%)", "[1%,inf)"]


def histogram_label(r: Column) -> Column:
    out = F.when(r < HIST_EDGES[0], HIST_LABELS[0])
    for e, lab in zip(HIST_EDGES[1:], HIST_LABELS[1:]):
        out = out.when(r < e, lab)
    return out.when(r.isNotNull(), HIST_LABELS[-1])


def return_histogram(net: DataFrame, by: Sequence[str], ret: str = "net_r") -> DataFrame:
    """Counts per fixed bin, dense: every group has all eight bins."""
    lab = histogram_label(F.col(ret))
    a = net.groupBy(*by).agg(*[F.count(F.when(lab == l, 1)).alias(f"b{i}") for i, l in enumerate(HIST_LABELS)])
    bins = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(l).alias("bin"), F.col(f"b{i}").alias("count"))
                     for i, l in enumerate(HIST_LABELS)])
    return a.select(*by, F.explode(bins).alias("h")).select(*by, "h.bin", "h.count")


def diagnostics(net: DataFrame, by: Sequence[str], ret: str = "net_r", ts: str = "ts",
                mae: str | None = "mae_proxy") -> DataFrame:
    """Trades per day (span at least one day), median return, share of the best tenth in total pnl,
    median adverse excursion."""
    by = list(by)
    net = stored(net.select(*by, ts, ret, *([mae] if mae else [])))
    days = F.greatest(F.lit(1.0), (F.max(ts) - F.min(ts)) / 86400.0)
    a = net.groupBy(*by).agg((F.count(ret) / days).alias("trades_per_day"), F.sum(ret).alias("_total"))
    a = a.join(exact_quantiles(net, by, ret, {"median_hold_return": 0.5}), by)
    a = a.join(top_sum(net, by, ret, 0.10, "_top"), by)
    if mae:
        a = a.join(exact_quantiles(net, by, mae, {"mae_proxy_median": 0.5}), by, "left")
    return a.withColumn("top10_pct_pnl_contribution",
                        F.when(F.abs("_total") >= 1e-12, F.col("_top") / F.col("_total"))).drop("_total", "_top")
