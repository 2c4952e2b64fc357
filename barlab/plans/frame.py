"""The aligned feature frame: one row per (pair, bar) with base (``_btc``) and lead (``_eth``) columns.

Stages and their shuffles:
  pair bars -> coarse block (hourly size) -> equi-join back -> slow series as-of -> row index ->
  halo blocks (pair, blk) -> short windows in the JVM -> long ranks/quantiles in one grouped pass.
All partitioning is by (pair, time chunk) or (pair, block); no task handles a whole pair.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions import windows as W
from ..functions.nulls import eq, flag, ge, gt, le, ne, sign, zero_to_null
from ..operators.asof import asof_join_many, hour_join
from ..operators.blocks import block_window, drop_halo, with_halo
from ..operators.prefix import row_index
from ..operators.resample import last_per_bin
from ..operators.rolling import Roll, back_rows, long_rolling
from ..operators.store import stored

KEYS = ["pair"]
EPS = 1e-12


@dataclass(frozen=True)
class FrameConfig:
    """Window lengths in bars. Defaults are for 5-minute bars with an hourly coarse grid."""
    step: int = 300
    slow: int = 3600
    w_long: int = 5760          # 20 days of 5-minute bars
    w_slow: int = 480           # 20 days of hours
    w_spread: int = 2000        # hours
    w_deriv: int = 8640         # 30 days of 5-minute bars
    w_vwap: int = 288
    w_day: int = 288
    min_day: int = 100
    w_corr: int = 8640
    min_corr: int = 500
    ema_span: int = 20
    slope_lag: int = 3
    block: int = 46080
    slow_block: int = 20000
    chunk: int = 86400 * 14     # seconds per chunk for running values
    rule_back: int = 200        # history that windows over the frame look back over; events derive it from their rules
    ahead: int = 0              # bars of future in a block; events derive it from their rules

    def small(self, **kw) -> "FrameConfig":
        return replace(self, **kw)


def coarse_block(pair: DataFrame, c: FrameConfig) -> DataFrame:
    """Cross-asset features on the coarse grid, labelled by bin start."""
    h = last_per_bin(pair, c.slow, ["close_btc", "close_eth"], KEYS)
    h = row_index(h, KEYS, ["ts"], F.col("ts"), c.slow * c.slow_block)
    rolls = [
        Roll("eth_ema20_1h", "ema", "close_eth", c.ema_span),
        Roll("btc_ema20_1h", "ema", "close_btc", c.ema_span),
        Roll("eth_slope_1h", "diff", "eth_ema20_1h", c.slope_lag),
        Roll("btc_slope_1h", "diff", "btc_ema20_1h", c.slope_lag),
        Roll("eth_slope_abs_1h", "abs", "eth_slope_1h"),
        Roll("eth_slope_abs_q70_1h", "quantile", "eth_slope_abs_1h", c.w_slow, 0.70),
        Roll("eth_slope_abs_pct_1h", "rank", "eth_slope_abs_1h", c.w_slow),
        Roll("eth_slope_mean_1h", "mean", "eth_slope_1h", c.w_slow),
        Roll("eth_slope_std_1h", "std", "eth_slope_1h", c.w_slow),
        Roll("spread_pct", "rank", "spread", c.w_spread),
    ]
    back = max(back_rows(rolls), c.w_spread + 6) + 2
    h = with_halo(h, back, 0, max(c.slow_block, back))
    w = block_window(KEYS)
    h = h.select("*", W.ret(F.col("close_btc"), w, 6).alias("ret_btc_1h_6h"),
                 W.ret(F.col("close_eth"), w, 6).alias("ret_eth_1h_6h"))
    h = h.withColumn("spread", F.col("ret_eth_1h_6h") - F.col("ret_btc_1h_6h"))
    h = long_rolling(h, KEYS, rolls)
    s = F.col("eth_slope_sign_1h")
    h = h.withColumns({"eth_slope_sign_1h": sign(F.col("eth_slope_1h")),
                       "btc_slope_sign_1h": sign(F.col("btc_slope_1h"))})
    return drop_halo(h.withColumns({
        "eth_slope_stable_2_1h": ne(s, 0.0) & eq(s, W.lag(s, w)),
        "eth_slope_z_1h": (F.col("eth_slope_1h") - F.col("eth_slope_mean_1h")) / F.col("eth_slope_std_1h"),
        "eth_above_ema20_1h": gt(F.col("close_eth"), F.col("eth_ema20_1h")),
    }))


COARSE_COLS = ["spread_pct", "eth_slope_sign_1h", "eth_slope_stable_2_1h", "eth_slope_abs_1h",
               "eth_slope_abs_q70_1h", "eth_slope_abs_pct_1h", "eth_slope_z_1h", "btc_slope_sign_1h",
               "eth_above_ema20_1h"]


def aligned(pair: DataFrame, c: FrameConfig, slow: dict[str, DataFrame] | None = None,
            label: str = "left") -> DataFrame:
    """Pair bars with position, coarse features and the latest row of every slow series.

    ``label='left'``: a bar sees the features of the coarse bin it lies in, including that bin's last
    close (the published behaviour). ``'right'``: only bins already complete at the bar's time, so
    there is no look-ahead.
    """
    coarse = coarse_block(pair, c).select("pair", "ts", *COARSE_COLS)
    side = {k: v.select("pair", "ts", *[x for x in v.columns if x not in ("pair", "ts")])
            for k, v in (slow or {}).items()}
    if label == "right":
        side["coarse"] = coarse.withColumn("ts", F.col("ts") + c.slow)
    x = asof_join_many(pair, side, KEYS, span=c.chunk, index="idx")
    return x if label == "right" else hour_join(x, coarse, KEYS, COARSE_COLS, c.slow)


def _base_windows(x: DataFrame, c: FrameConfig) -> DataFrame:
    w = block_window(KEYS)
    x = x.withColumns({f"_pc_{a}": W.lag(F.col(f"close_{a}"), w) for a in ("btc", "eth")})
    one: dict = {}
    for a in ("btc", "eth"):
        cl, pc = F.col(f"close_{a}"), F.col(f"_pc_{a}")
        r = cl / pc - 1.0
        one |= {
            f"ret1_{a}": r, f"ret1_abs_{a}": F.abs(r),
            f"bar_dir_{a}": sign(cl - F.col(f"open_{a}")),
            f"tr_{a}": W.true_range(F.col(f"high_{a}"), F.col(f"low_{a}"), pc),
            f"_step_{a}": F.abs(cl - pc), f"_pv_{a}": cl * F.col(f"volume_{a}"),
        }
    x = x.withColumns(one)
    two: dict = {}
    for a in ("btc", "eth"):
        cl = F.col(f"close_{a}")
        v = F.col(f"volume_{a}")
        two |= {
            f"atr14_{a}": W.mean(F.col(f"tr_{a}"), w, 14),
            f"rv48_{a}": W.std(F.col(f"ret1_{a}"), w, 48),
            f"er20_{a}": W.efficiency_ratio(F.abs(W.diff(cl, w, 20)), F.col(f"_step_{a}"), w, 20),
            f"vwap48_{a}": W.vwap(F.col(f"_pv_{a}"), v, w, 48),
            f"_r4h_{a}": F.coalesce(W.ret(cl, w, 48), F.lit(0.0)),
            f"_r1h_{a}": F.coalesce(W.ret(cl, w, 12), F.lit(0.0)),
        }
    rb, re = (F.coalesce(F.col(f"ret1_{a}"), F.lit(0.0)) for a in ("btc", "eth"))
    two |= {
        "prior_high_12": W.prior_max(F.col("high_btc"), w, 12),
        "prior_low_12": W.prior_min(F.col("low_btc"), w, 12),
        "prior_high_24": W.prior_max(F.col("high_btc"), w, 24),
        "prior_low_24": W.prior_min(F.col("low_btc"), w, 24),
        "btc_eth_corr_2h": F.coalesce(W.corr(rb, re, w, 24), F.lit(0.0)),
    }
    x = x.withColumns(two)
    three = {f"dist_to_vwap48_{a}": F.col(f"close_{a}") - F.col(f"vwap48_{a}") for a in ("btc", "eth")}
    x = x.withColumns(three | {
        "_atr_rv": F.col("atr14_btc") / zero_to_null(F.col("rv48_btc")),
        "_abs_dist": F.abs(F.col("close_btc") - F.col("vwap48_btc")),
        "delta_er": F.col("er20_btc") - F.col("er20_eth"),
        "_abs_delta_er": F.abs(F.col("er20_btc") - F.col("er20_eth")),
    })
    if "oi_contracts_btc" in x.columns:
        oi = F.col("oi_contracts_btc")
        x = x.withColumn("oi_velocity", oi - W.lag(oi, w, 12) - (W.lag(oi, w, 12) - W.lag(oi, w, 24)))
    if "funding_rate_btc" in x.columns and "funding_rate_eth" in x.columns:
        x = x.withColumn("funding_spread", F.col("funding_rate_eth") - F.col("funding_rate_btc"))
    for a in ("btc", "eth"):
        if f"long_liq_usd_{a}" in x.columns:
            lo, sh = (F.coalesce(F.col(f"{s}_liq_usd_{a}"), F.lit(0.0)) for s in ("long", "short"))
            x = x.withColumns({f"_long_liq_{a}": lo, f"_short_liq_{a}": sh, f"_total_liq_{a}": lo + sh})
    return x


def _long_columns(x: DataFrame, c: FrameConfig) -> list[Roll]:
    L, D = c.w_long, c.w_deriv
    q = lambda out, col, p: Roll(out, "quantile", col, L, p)
    rk = lambda out, col, n=L: Roll(out, "rank", col, n)
    rolls = [
        Roll("_pv_sum", "sum", "_pv_btc", c.w_vwap), Roll("_v_sum", "sum", "volume_btc", c.w_vwap),
        Roll("vwap_btc", "ratio", "_pv_sum", other="_v_sum"), Roll("_dev", "minus", "close_btc", other="vwap_btc"),
        Roll("_dev_std", "std", "_dev", c.w_vwap), Roll("vwap_z", "ratio", "_dev", other="_dev_std"),
    ]
    rolls += [q(f"ret1_abs_btc_q{p}", "ret1_abs_btc", p / 100) for p in (30, 40, 70, 80, 90)]
    rolls += [
        q("ret1_abs_eth_q90", "ret1_abs_eth", .90),
        rk("ret1_abs_btc_pct", "ret1_abs_btc"), rk("ret1_abs_eth_pct", "ret1_abs_eth"),
        q("tr_btc_q90", "tr_btc", .90), q("tr_btc_q10", "tr_btc", .10), q("tr_btc_q25", "tr_btc", .25),
        q("tr_eth_q90", "tr_eth", .90),
        Roll("_dstd_btc", "std", "dist_to_vwap48_btc", L), Roll("_dstd_eth", "std", "dist_to_vwap48_eth", L),
        Roll("dist_to_vwap48_z_btc", "ratio", "dist_to_vwap48_btc", other="_dstd_btc"),
        Roll("dist_to_vwap48_z_eth", "ratio", "dist_to_vwap48_eth", other="_dstd_eth"),
        rk("atr14_pct_btc", "atr14_btc"), rk("atr14_pct_eth", "atr14_eth"),
        rk("rv48_pct_btc", "rv48_btc"), rk("rv48_pct_eth", "rv48_eth"),
        rk("atr_rv_ratio_pct_btc", "_atr_rv"),
        Roll("atr_rv_pct_ratio", "ratio", "atr14_pct_btc", other="rv48_pct_btc", floor=EPS),
        rk("atr_rv_pct_ratio_pct", "atr_rv_pct_ratio"),
        rk("abs_vwap_dist_pct_btc", "_abs_dist"), rk("abs_delta_er_pct", "_abs_delta_er"),
        rk("volume_btc_pct", "volume_btc"), rk("volume_eth_pct", "volume_eth"),
        rk("vwap_z_pct", "vwap_z"), rk("dist_z_eth_pct", "dist_to_vwap48_z_eth"),
        Roll("_r4h_btc_q80", "quantile", "_r4h_btc", c.w_day, .80, c.min_day),
        Roll("_r4h_eth_q80", "quantile", "_r4h_eth", c.w_day, .80, c.min_day),
        Roll("_absret_day_q30", "quantile", "ret1_abs_btc", c.w_day, .30),
        Roll("_corr_p20", "quantile", "btc_eth_corr_2h", c.w_corr, .20, c.min_corr),
    ]
    have = set(x.columns)
    for a in ("btc", "eth"):
        if f"funding_rate_{a}" in have:
            rolls += [rk(f"funding_{a}_pct", f"funding_rate_{a}", D),
                      Roll(f"_fmean_{a}", "mean", f"funding_rate_{a}", D),
                      Roll(f"_fstd_{a}", "std", f"funding_rate_{a}", D)]
        if f"oi_contracts_{a}" in have:
            rolls.append(rk(f"oi_{a}_pct", f"oi_contracts_{a}", D))
        if f"_long_liq_{a}" in have:
            rolls += [rk(f"{s}_liq_{a}_pct", f"_{s}_liq_{a}", D) for s in ("long", "short", "total")]
    if "funding_spread" in have:
        rolls.append(rk("funding_spread_pct", "funding_spread", D))
    if "oi_velocity" in have:
        rolls.append(Roll("_oi_vel_q80", "quantile", "oi_velocity", c.w_day, .80, c.min_day))
    return rolls


def _slow_flags(x: DataFrame) -> DataFrame:
    w = block_window(KEYS)
    have, out = set(x.columns), {}
    for a in ("btc", "eth"):
        if f"funding_rate_{a}" in have:
            f = F.col(f"funding_rate_{a}")
            out |= {f"funding_{a}_ann": f * 24 * 365, f"funding_{a}_sign": sign(f), f"funding_{a}_flip": W.flip(sign(f), w)}
            if f"_fmean_{a}" in have:
                out[f"funding_{a}_z"] = (f - F.col(f"_fmean_{a}")) / F.col(f"_fstd_{a}")
            if f"funding_{a}_pct" in have:
                out |= {f"funding_{a}_extreme_long": ge(F.col(f"funding_{a}_pct"), .90),
                        f"funding_{a}_extreme_short": le(F.col(f"funding_{a}_pct"), .10)}
        if f"oi_contracts_{a}" in have:
            out[f"oi_{a}_chg"] = W.carry_change(F.col(f"oi_contracts_{a}"), w)
        if f"_long_liq_{a}" in have and f"_total_liq_{a}" in have:
            t = F.col(f"_total_liq_{a}")
            out[f"liq_imbalance_{a}"] = F.col(f"_long_liq_{a}") / F.when(t > 0, t)
    if "oi_btc_pct" in have and "oi_eth_pct" in have:
        out["oi_spread_pct"] = F.col("oi_eth_pct") - F.col("oi_btc_pct")
    return x.withColumns(out) if out else x


ALIASES = {"atr14": "atr14_btc", "rv48": "rv48_btc", "er20": "er20_btc", "vwap48": "vwap48_btc",
           "atr14_pct": "atr14_pct_btc", "rv48_pct": "rv48_pct_btc",
           "dist_to_vwap48": "dist_to_vwap48_btc", "dist_to_vwap48_z": "dist_to_vwap48_z_btc",
           "abs_vwap_dist_pct": "abs_vwap_dist_pct_btc"}


def _needed(rolls: list[Roll], only: set[str]) -> list[Roll]:
    """The rolls behind the wanted columns, with what they depend on, in order."""
    want = set(only) | {ALIASES[k] for k in only if k in ALIASES}
    for k in list(want):  # columns finished from rolls after the pandas pass
        for a in ("btc", "eth"):
            if k == f"funding_{a}_z":
                want |= {f"_fmean_{a}", f"_fstd_{a}"}
            if k in (f"funding_{a}_extreme_long", f"funding_{a}_extreme_short"):
                want.add(f"funding_{a}_pct")
        if k == "oi_spread_pct":
            want |= {"oi_btc_pct", "oi_eth_pct"}
    keep = []
    for r in reversed(rolls):
        if r.out in want:
            keep.append(r)
            want |= {r.col, r.other}
    return keep[::-1]


def blocked_frame(pair: DataFrame, c: FrameConfig = FrameConfig(), slow: dict[str, DataFrame] | None = None,
                  label: str = "left", only: set[str] | None = None) -> DataFrame:
    """The frame still cut in halo blocks (columns ``blk``, ``own``), ready for rule windows.

    ``only`` names the columns wanted: long ranks and quantiles behind other columns are not computed, and
    the halo shrinks to what remains. (Catalyst prunes the plain window columns by itself, but it cannot
    look into the grouped pass.)
    """
    x = aligned(stored(pair), c, slow, label)
    # history: the longest chain of long windows on top of the longest short window, plus rule look-back
    short = 72 + 30
    probe = _long_columns(_ColumnsOnly(x.columns), c)
    if only is not None:
        probe = _needed(probe, only)
    back = back_rows(probe) + short + c.rule_back
    x = with_halo(x, back, c.ahead, max(c.block, back + c.ahead))
    x = _base_windows(x, c)
    rolls = _long_columns(x, c)
    if only is not None:
        rolls = _needed(rolls, only)
        keep = {"pair", "ts", "idx", "blk", "own"} | only | {ALIASES[k] for k in only if k in ALIASES} | {r.col for r in rolls} | {r.other for r in rolls}
        keep |= {k for k in x.columns if k.startswith(("_long_liq", "_total_liq")) and any(o.startswith("liq_imbalance") for o in only)}
        keep |= {"spread_pct"}
        for a in ("btc", "eth"):
            if any(o.startswith(f"funding_{a}") for o in only):
                keep.add(f"funding_rate_{a}")
            if f"oi_{a}_chg" in only:
                keep.add(f"oi_contracts_{a}")
        x = x.select(*[k for k in x.columns if k in keep])
    if rolls:
        x = long_rolling(x, KEYS, rolls)
    x = _slow_flags(x)
    have = set(x.columns)
    return x.withColumns({k: F.col(v) for k, v in ALIASES.items() if v in have} | {"spread_regime": _tails()})


def _tails():
    from ..functions.scalar import tail_code
    return tail_code(F.col("spread_pct")).cast("int")


class _ColumnsOnly:
    """Column names a frame will have after the short windows, to size the halo before they exist."""

    def __init__(self, cols):
        c = set(cols)
        if "oi_contracts_btc" in c:
            c.add("oi_velocity")
        if {"funding_rate_btc", "funding_rate_eth"} <= c:
            c.add("funding_spread")
        for a in ("btc", "eth"):
            if f"long_liq_usd_{a}" in c:
                c.add(f"_long_liq_{a}")
        self.columns = list(c)


def frame(pair: DataFrame, c: FrameConfig = FrameConfig(), slow: dict[str, DataFrame] | None = None,
          label: str = "left", only: set[str] | None = None) -> DataFrame:
    """The frame as a plain table, one row per (pair, ts)."""
    x = drop_halo(blocked_frame(pair, c, slow, label, only))
    return x.drop(*[k for k in x.columns if k.startswith("_")])


def require_columns(df: DataFrame, rule: str, cols) -> None:
    missing = [k for k in cols if k not in df.columns]
    if missing:
        raise ValueError(f"{rule} missing required columns: {missing}")
