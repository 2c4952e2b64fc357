"""Drift, shock and trade studies on single symbols."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import windows as W
from ..functions.nulls import between, eq, ge, gt, le, lt, ne, zero_to_null
from ..functions.scalar import atr_shock_bucket, bucket, shock_side, trend_regime
from ..operators.blocks import in_blocks
from ..operators.prefix import Run, running
from ..operators.resample import resample
from ..operators.rolling import Roll, back_rows, long_rolling
from ..operators.stats import summarize, with_t_stat
from ..operators.store import stored
from ..operators.thin import thin
from ..sources.readers import small

# Bins and labels of the studies
RV_BINS, RV_LABELS = [0.0, 0.1, 0.3, 0.7, 0.9, 1.0], ["0-10%", "10-30%", "30-70%", "70-90%", "90-100%"]
SHOCK_BINS, SHOCK_LABELS = [0.0, 0.9, 0.95, 0.99, 0.995, 1.0], ["0-90%", "90-95%", "95-99%", "99-99.5%", "99.5-100%"]
Z_BINS = [float("-inf"), -2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, float("inf")]
Z_LABELS = ["<-2.0", "-2.0--1.5", "-1.5--1.0", "-1.0--0.5", "-0.5-0.0", "0.0-0.5", "0.5-1.0", "1.0-1.5", "1.5-2.0", ">2.0"]
RET_BINS = [float("-inf"), -0.05, -0.02, -0.01, 0.0, 0.01, 0.02, 0.05, float("inf")]
RET_LABELS = ["<-5%", "-5--2%", "-2--1%", "-1-0%", "0-1%", "1-2%", "2-5%", ">5%"]
LOW_VOLATILITY = {"rv_low_10": 0.10, "rv_low_20": 0.20}
SPAN = 86400 * 30


def rolling_rank(df: DataFrame, keys: Sequence[str], cols: dict[str, str], n: int, span: int = SPAN) -> DataFrame:
    """Add long-window percentile ranks {out: col}; keeps the row order columns out of the result."""
    rolls = [Roll(o, "rank", c, n) for o, c in cols.items()]
    return in_blocks(df, keys, lambda d, w: long_rolling(d, keys, rolls), back=back_rows(rolls), span=span)


def ahead_returns(df: DataFrame, keys: Sequence[str], horizons: Sequence[int], price: str = "close",
                  carry: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """One row per (row, horizon) with the return to the h-th next row *within keys*. Putting a bucket in
    ``keys`` gives the subset shift: h rows of the subset ahead, not h bars. ``df`` is read twice."""
    def build(d, w):
        c = F.col(price)
        arr = F.array(*[F.struct(F.lit(h).alias("h"), W.forward_return(c, w, h).alias("fwd")) for h in horizons])
        return d.withColumn("_a", arr)
    d = in_blocks(df.select(*keys, "ts", price, *carry), keys, build, forward=max(horizons), span=span)
    return d.select(*keys, *carry, "ts", F.explode("_a").alias("a")).select(*keys, *carry, "ts", "a.h", "a.fwd")


def drift_study(df: DataFrame, symbol: Sequence[str], by: str, horizons: Sequence[int], value: str = "fwd",
                sign: Column | None = None, absolute: bool = False, subset_shift: bool = True,
                grid: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Summary of forward returns per (symbol, bucket, horizon).

    ``subset_shift`` takes the return between rows of the same bucket, as the published studies do; False
    uses true bars. Rows without a bucket take no part.
    """
    symbol = list(symbol)
    d = stored(df.where(F.col(by).isNotNull()) if subset_shift else df)
    keys = [*symbol, by] if subset_shift else symbol
    extra = [c for c in carry if c not in keys] + ([] if subset_shift else [by])
    r = ahead_returns(d, keys, horizons, carry=extra).where(F.col(by).isNotNull())
    x = F.col("fwd") * sign if sign is not None else F.col("fwd")
    r = r.withColumn("fwd", F.abs(x) if absolute else x)
    return summarize(r, [*symbol, by, "h"], "fwd", grid)


def low_volatility_study(bars: DataFrame, keys: Sequence[str], window: int, horizons: Sequence[int], grid: DataFrame | None = None,
                         span: int = SPAN) -> DataFrame:
    """Returns after bars of low volatility rank, and after those where volatility also rises."""
    rolls = [Roll("rv_pct", "rank", "rv48", window)]

    def build(d, w):
        d = d.withColumn("_up", gt(F.col("rv48"), W.lag(F.col("rv48"), w)))
        return long_rolling(d, keys, rolls)
    d = in_blocks(bars.select(*keys, "ts", "close", "rv48"), keys, build, back=back_rows(rolls) + 1, span=span)
    hits = F.array_compact(F.array(*[x for n, p in LOW_VOLATILITY.items() for x in (
        F.when(le(F.col("rv_pct"), p), F.lit(n)), F.when(le(F.col("rv_pct"), p) & F.col("_up"), F.lit(f"{n}_rising")))]))
    e = stored(d.select(*keys, "ts", "close", F.explode(hits).alias("event")))
    return summarize(ahead_returns(e, [*keys, "event"], horizons), [*keys, "event", "h"], "fwd", grid)


def price_z_study(bars: DataFrame, keys: Sequence[str], window: int, horizons: Sequence[int], grid: DataFrame | None = None,
                  span: int = SPAN) -> DataFrame:
    """Returns by distance from the average price in sample deviations. ``bars`` has close and vwap."""
    def build(d, w):
        dev = F.col("close") - F.col("vwap")
        d = d.withColumn("_dev", dev)
        return d.withColumn("z_bucket", bucket(F.col("_dev") / zero_to_null(W.std(F.col("_dev"), w, window, ddof=1)), Z_BINS, Z_LABELS))
    d = in_blocks(bars.select(*keys, "ts", "close", "vwap"), keys, build, back=window, span=span)
    return drift_study(d, keys, "z_bucket", horizons, grid=grid)


def daily_return_study(bars: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (1, 3, 5), grid: DataFrame | None = None,
                       span: int = 86400 * 200) -> DataFrame:
    """Returns of the next days of a bucket by the size of the day's return; days end at midnight, closed right."""
    daily = resample(bars, 86400, "right", keys)
    d = in_blocks(daily, keys, lambda x, w: x.withColumn("ret_bucket", bucket(W.ret(F.col("close"), w), RET_BINS, RET_LABELS)), back=1, span=span)
    return drift_study(d, keys, "ret_bucket", horizons, grid=grid)


def breakout_flags(bars: DataFrame, keys: Sequence[str], ns: Sequence[int], buffers: Sequence[float], span: int = SPAN) -> DataFrame:
    """Long rows for bars closing above the prior n-bar high plus a fraction of ATR."""
    def build(d, w):
        arr = F.array(*[F.struct(F.lit(n).alias("n_bars"), F.lit(float(b)).alias("buffer_atr"),
                                 gt(F.col("close"), W.prior_max(F.col("high"), w, n) + F.col("atr14") * b).alias("hit"))
                        for n in ns for b in buffers])
        return d.withColumn("_e", arr)
    d = in_blocks(bars, keys, build, back=max(ns), span=span)
    e = d.select(*keys, "ts", "close", F.explode("_e").alias("e")).where("e.hit")
    return e.select(*keys, "ts", "close", "e.n_bars", "e.buffer_atr")


def breakout_study(bars, keys, ns, buffers, horizons, grid=None, subset_shift: bool = True) -> DataFrame:
    e = stored(breakout_flags(bars, keys, ns, buffers))
    r = ahead_returns(e, [*keys, "n_bars", "buffer_atr"], horizons)
    return summarize(r, [*keys, "n_bars", "buffer_atr", "h"], "fwd", grid)


def shock_table(df: DataFrame, keys: Sequence[str], window: int, atr_units: bool = False, span: int = SPAN) -> DataFrame:
    """Bars with one-bar return, shock bucket and side, and volatility bucket. The shock is the rolling
    rank of the absolute return, or the absolute return in ATRs."""
    rolls = [Roll("abs_r1_pct", "rank", "abs_r1", window), Roll("rv_pct", "rank", "rv48", window)]

    def build(d, w):
        r = W.ret(F.col("close"), w)
        d = d.withColumns({"r1": r, "abs_r1": F.abs(r)})
        return long_rolling(d, keys, rolls)
    d = in_blocks(df, keys, build, back=back_rows(rolls) + 1, span=span)
    shock = (atr_shock_bucket(F.col("abs_r1") / (F.col("atr14") / F.col("close"))) if atr_units
             else bucket(F.col("abs_r1_pct"), SHOCK_BINS, SHOCK_LABELS))
    return d.withColumns({"shock_bucket": shock, "rv_bucket": bucket(F.col("rv_pct"), RV_BINS, RV_LABELS),
                          "shock_side": shock_side(F.col("r1"))})


def shock_study(t: DataFrame, keys: Sequence[str], horizons: Sequence[int], by_side: bool = True, by_rv: bool = True,
                grid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(continuation, forward) summaries by side, shock and volatility bucket. Both use the same rows;
    continuation signs the return with the shock's side."""
    keys = list(keys)
    cut = [*(["shock_side"] if by_side else []), "shock_bucket", *(["rv_bucket"] if by_rv else [])]
    d = t.where(F.col("shock_bucket").isNotNull())
    if by_rv:
        d = d.where(F.col("rv_bucket").isNotNull())
    if by_side:
        d = d.where(F.col("shock_side") != "zero")
    d = stored(d.withColumn("_s", F.signum(F.coalesce("r1", F.lit(0.0)))))
    r = stored(ahead_returns(d, [*keys, *cut], horizons, carry=["_s"]))
    k = [*keys, *cut, "h"]
    cont = summarize(r.withColumn("_c", F.col("fwd") * F.col("_s")), k, "_c", grid)
    return with_t_stat(cont), with_t_stat(summarize(r, k, "fwd", grid))


def in_out_compare(ins: DataFrame, outs: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer join of two result tables with _is / _oos suffixes."""
    a = ins.select(*keys, *[F.col(c).alias(f"{c}_is") for c in cols])
    b = outs.select(*keys, *[F.col(c).alias(f"{c}_oos") for c in cols])
    return a.join(b, list(keys), "full_outer")


# --- next-open trades ---------------------------------------------------------------------------------
def shock_trades(df: DataFrame, keys: Sequence[str], window: int, horizons: Sequence[int], variant: str = "A",
                 rv=(0.7, 0.9), shock=(1.5, 2.5), fee_bps: float = 0.0, slip_bps: float = 0.0, span: int = SPAN) -> DataFrame:
    """Enter at the next open after a shock in ATRs within a volatility band, leave h opens later.
    Negative shocks go short; positive ones go short in variant A and long in B."""
    keys = list(keys)
    rolls = [Roll("rv_pct", "rank", "rv48", window)]

    def build(d, w):
        r = W.ret(F.col("close"), w)
        d = d.withColumns({"r1": r, "shock_atr": F.abs(r) / (F.col("atr14") / F.col("close"))})
        d = long_rolling(d, keys, rolls)
        o, t = F.col("open"), F.col("ts")
        hs = F.array(*[F.struct(F.lit(h).alias("h"), W.lead(t, w, 1).alias("entry_ts"), W.lead(t, w, 1 + h).alias("exit_ts"),
                                W.lead(o, w, 1).alias("entry_open"), W.lead(o, w, 1 + h).alias("exit_open")) for h in horizons])
        return d.withColumn("_t", hs)
    d = in_blocks(df, keys, build, back=back_rows(rolls) + 1, forward=1 + max(horizons), span=span)
    sig = between(F.col("rv_pct"), *rv) & between(F.col("shock_atr"), *shock) & ne(F.col("r1"), 0.0)
    d = d.where(sig).select(*keys, F.col("ts").alias("signal_ts"), "r1", F.coalesce("atr14", F.lit(0.0)).alias("atr"), F.explode("_t").alias("t"))
    d = d.select(*keys, "signal_ts", "r1", "atr", "t.*").where("exit_open > 0 and entry_open > 0")
    side = F.when((F.col("r1") < 0) | F.lit(variant == "A"), "short").otherwise("long")
    e, x = F.col("entry_open"), F.col("exit_open")
    gross = F.when(side == "long", x / e - 1.0).otherwise(e / x - 1.0)
    return d.withColumns({"side": side, "ret": gross - 2.0 * (fee_bps + slip_bps) / 10000.0}).drop("r1")


def split_tag(df: DataFrame, days_out: int, bounds: tuple[int, int], is_days: int | None = None) -> DataFrame:
    """'is' / 'oos' by the last ``days_out`` days; a fixed in-sample length drops older rows. Later
    windows partition by ``split``, so features never look across."""
    lo, hi = bounds
    cut = hi - days_out * 86400
    first = cut - is_days * 86400 if is_days else lo
    d = df.where((F.col("ts") >= first) & (F.col("ts") <= hi))
    return d.withColumn("split", F.when(F.col("ts") < cut, "is").otherwise("oos"))


def rolling_folds(df: DataFrame, bounds: tuple[int, int], train: int, test: int, step: int) -> DataFrame:
    """Rows copied into every walk-forward fold whose train or test span holds them, with the fold's
    test window; the copy factor is (train + test) / step."""
    lo, hi = bounds
    D = 86400
    last = (hi - lo - (train + test) * D) // (step * D)
    if last < 0:
        raise ValueError("walk-forward produces no folds")
    off = F.col("ts") - lo
    k0 = F.greatest(F.lit(0), F.floor((off - (train + test) * D) / (step * D)) + 1)
    k1 = F.least(F.lit(last), F.floor(off / (step * D)))
    d = df.withColumn("fold_id", F.explode(F.when(k0 <= k1, F.sequence(k0, k1)))).withColumn("fold_id", (F.col("fold_id") + 1).cast("int"))
    start = F.lit(lo) + (F.col("fold_id") - 1) * step * D
    return d.withColumns({"test_start": start + train * D, "test_end": start + (train + test) * D})


def walkforward_trades(df: DataFrame, keys: Sequence[str], bounds, train, test, step, **kw) -> DataFrame:
    """``shock_trades`` computed inside every fold; trades signalled and closed in the fold's test span."""
    keys = list(keys)
    f = stored(rolling_folds(df, bounds, train, test, step))
    t = shock_trades(f, [*keys, "fold_id"], **kw)
    w = f.select("fold_id", "test_start", "test_end").distinct()
    t = t.join(small(w), "fold_id")  # one row per fold
    return t.where("signal_ts >= test_start and signal_ts < test_end and exit_ts < test_end")


# --- dedicated pair event builder ----------------------------------------------------------------------
def tail_slope_events(frame: DataFrame, horizon: int, inverse: bool = False, span: int = SPAN) -> DataFrame:
    """Short-tail spread with a sloping lead: trade the lead's slope (or against it) on the base leg."""
    keys = ["pair"]

    def build(d, w):
        return d.withColumn("fwd_r", W.forward_return(F.col("close_btc"), w, horizon))
    d = in_blocks(frame.select("pair", "ts", "close_btc", "spread_pct", "eth_slope_sign_1h"), keys, build, forward=horizon, span=span, keep_index=True)
    s = F.col("eth_slope_sign_1h")
    d = d.withColumn("signal_dir", F.when(lt(F.col("spread_pct"), 0.10) & ne(s, 0.0), -s if inverse else s).otherwise(0.0))
    e = thin(d.where(ne(F.col("signal_dir"), 0.0)), keys, horizon)
    return e.na.drop(subset=["signal_dir", "fwd_r"]).select("pair", "ts", "signal_dir", "fwd_r", (F.col("signal_dir") * F.col("fwd_r")).alias("gross_r"))


# --- entry screens --------------------------------------------------------------------------------------
def trend_screen(bars: DataFrame, keys: Sequence[str], lookback: int = 20, atr_buffer: float = 0.0, er_min: float = 0.35,
                 er_band: tuple[float, float] | None = None, rv_window: int | None = None, ema_span: int | None = None,
                 slope_bars: int = 3, slope_min: float = 0.0, retest_bars: int | None = None, retest_band: float = 0.25,
                 span: int = SPAN) -> DataFrame:
    """Bars that pass the trend entry screen: efficiency regime and band, volatility decile, slow average
    confirmation, breakout of the prior high plus an ATR buffer, or its retest within a few bars.
    Input: bars with er20, atr14, rv48. Adds breakout_level and candidate."""
    keys = list(keys)
    rolls = []
    if rv_window:
        rolls.append(Roll("_rv90", "quantile", "_rv1", rv_window, 0.9))
    if ema_span:
        rolls += [Roll("ema_slow", "ema", "close", ema_span), Roll("ema_slope", "diff", "ema_slow", slope_bars)]
    back = max(back_rows(rolls), lookback) + 1 + (retest_bars or 0)

    def build(d, w):
        if rv_window:
            d = d.withColumn("_rv1", W.lag(F.col("rv48"), w))
        if rolls:
            d = long_rolling(d, keys, rolls)
        level = W.prior_max(F.col("high"), w, lookback)
        d = d.withColumn("_lvl", level)
        brk = gt(F.col("close"), F.col("_lvl") + F.col("atr14") * atr_buffer) & F.col("er20").isNotNull()
        d = d.withColumn("_brk", brk)
        ok = eq(trend_regime(F.col("er20")), F.lit("trend")) & ge(F.col("er20"), er_min)
        if er_band:
            ok = ok & ~between(F.col("er20"), *er_band)
        if rv_window:
            ok = ok & (F.col("_rv90").isNull() | ~ge(F.col("rv48"), F.col("_rv90")))
        if ema_span:
            ok = ok & gt(F.col("close"), F.col("ema_slow")) & gt(F.col("ema_slope"), slope_min)
        d = d.withColumn("_ok", ok)
        if retest_bars is None:
            return d.withColumns({"breakout_level": F.when(F.col("_brk"), F.col("_lvl")), "candidate": F.col("_ok") & F.col("_brk")})
        # a level is remembered only from bars that passed the other conditions
        lvl = F.last(F.when(F.col("_ok") & F.col("_brk"), F.col("_lvl")), ignorenulls=True).over(w.rowsBetween(-retest_bars, 0))
        d = d.withColumn("breakout_level", lvl)
        touch = le(F.col("low"), F.col("breakout_level") + F.col("atr14") * retest_band) & ge(F.col("close"), F.col("breakout_level"))
        return d.withColumn("candidate", F.col("_ok") & touch)
    d = in_blocks(bars, keys, build, back=back, span=span)
    return d.drop("_lvl", "_brk", "_ok", "_rv1", "_rv90")


def reversion_screen(bars: DataFrame, keys: Sequence[str], z_entry: float = -1.5, window: int = 48, span: int = SPAN) -> DataFrame:
    """Deviation of the close from its average price, in sample deviations of itself; candidate at or
    below ``z_entry``. Input: bars with vwap48."""
    def build(d, w):
        d = d.withColumn("_dev", F.col("close") - F.col("vwap48"))
        return d.withColumn("z", F.col("_dev") / zero_to_null(W.std(F.col("_dev"), w, window, ddof=1)))
    d = in_blocks(bars, keys, build, back=window, span=span)
    return d.withColumn("candidate", le(F.col("z"), z_entry)).drop("_dev")


def ablation(bars: DataFrame, keys: Sequence[str], variants: dict[str, dict], horizon: int) -> DataFrame:
    """One summary row per configuration of the trend screen: candidates and their forward return."""
    out = None
    b = stored(bars)
    for name, kw in variants.items():
        s = trend_screen(b, keys, **kw).select(*keys, "ts", "close", "candidate")
        one = s.withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    r = ahead_returns(stored(out), [*keys, "variant"], [horizon], carry=["candidate"]).where("candidate")
    return summarize(r, [*keys, "variant", "h"], "fwd")
