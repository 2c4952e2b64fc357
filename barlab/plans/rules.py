"""The rule catalogue: every rule is a boolean mask and a direction over frame columns.

Rules that differ only in what happens after the signal (holding period, entry lag, traded leg, day or
session filter, exits) share one *signal*. Signals are evaluated once, each as plain row expressions over
three layers of window columns, and turned into long rows (pair, idx, signal). The rule table is then
joined on the signal name; it has a few hundred rows at most.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions import windows as W
from ..functions.nulls import between, eq, ge, gt, le, lt, ne, sign
from ..functions.scalar import day_of, in_hours, in_session, weekday_of
from ..operators.blocks import block_window
from .frame import KEYS

# ---------------------------------------------------------------------------------------------------
# Holding period in bars where it is not 8, by rule number
HORIZON = {
    4: (62, 64, 246),
    6: (15, 18, 19, 22, 23, 26, 27, 28, 29, 30, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 59, 60, 61, 74, 75, 87, 89, 92, 94, 96, 99, 121, 122, 123, 124, 147, 235, 236),
    10: (90, 95, 100),
    12: (125, 126, 127, 129, 130, 131, 132, 133, 134, 135, 136, 137, 138, 139, 144, 167, 169, 170, 171, 172, 173, 175, 180, 187, 191, 192, 202, 203, 204, 205, 210, 212, 217, 218, 219, 220, 232, 233, 234, 240, 241, 247, 249, 251, 254, 257, 260, 263, 264),
    24: (128, 248, 252, 255, 258, 259, 262),
    48: (261,),
}
# One-bar entry lag, lead-leg trades, day-parity and session subsamples, by rule number
ENTRY_LAG = (61, 76, 161, 171, 183, 184, 185, 186, 187, 240, 241, 249, 259, 260)
TRADES_LEAD = (60, 64, 65, 67, 70, 71, 73, 75, 77, 79, 83, 84, 85)
ODD_DAYS = (68, 70, 159, 169, 181)
EVEN_DAYS = (69, 71, 160, 170, 182)
SESSIONS = {(0, 8): (80, 83, 165, 221, 223), (8, 16): (81, 84, 164), (16, 24): (82, 85, 166), (12, 20): (222, 224)}
# Exit parameters by rule number
EXITS = {
    198: dict(atr_stop=1.5), 199: dict(tp_bps=25), 200: dict(trail_bps=15), 201: dict(atr_stop=1.5, tp_bps=25),
    202: dict(atr_stop=1.5), 203: dict(tp_bps=35), 204: dict(trail_bps=20), 205: dict(atr_stop=1.5, tp_bps=35),
    206: dict(watch="long_liq_btc_pct", watch_min=0.5), 207: dict(atr_stop=1.5),
    208: dict(watch="short_liq_btc_pct", watch_min=0.5),
    209: dict(watch="long_liq_btc_pct", watch_min=0.5, slope_exit=True),
    210: dict(watch="total_liq_btc_pct", watch_min=0.5, slope_exit=True),
    211: dict(breakeven_bps=15), 212: dict(breakeven_bps=20),
    213: dict(atr_stop=1.5, watch="long_liq_btc_pct", watch_min=0.5),
    214: dict(collapse="volume_btc_pct", collapse_below=0.3, collapse_bars=2),
}


@dataclass(frozen=True)
class Signal:
    """``mask`` selects bars, ``direction`` gives -1/+1 (or null). ``gap`` thins candidates before the
    holding period does: 'H' = the holding period (nothing extra to do), an int, or 'H+k'; ``tier`` gives a
    per-row gap expression for two-tier thinning, bounded by ``gap``.

    A signal of the user's own may look back: ``helpers`` names window columns over ``block_window(KEYS)``, in
    order, that mask and direction then read, and ``back`` says how many bars they reach back together."""
    mask: Column
    direction: Column
    gap: int | str = "H"
    tier: Column | None = None
    helpers: dict[str, Column] = field(default_factory=dict)
    back: int = 0


@dataclass(frozen=True)
class Rule:
    number: int
    family: str
    signal: str
    horizon: int = 8
    offset: int = 0
    leg: str = "btc"
    parity: int = -1
    hours: tuple[int, int] | None = None
    exits: dict = field(default_factory=dict)

    @property
    def rule_id(self) -> str:
        return f"H{self.number}"


# Parameters of the three parameterised rules
PARAMS = {
    111: dict(z_window=96, z_entry=2.0, rv_lo=0.25, rv_hi=0.80, cooldown=2, start="08:00", end="22:00"),
    112: dict(rv_lo=0.30, rv_hi=0.75, ratio_lo=0.60, ratio_hi=0.90, z_lo=0.8, z_hi=2.0),
    113: dict(lookback=24, er_min=0.45, rv_lo=0.35, rv_hi=0.85, z_max=2.2),
}

c = F.col


def history(params: dict = PARAMS, signals: Iterable[Signal] = ()) -> int:
    """Bars the layers below look back together: lags and windows, then windows over conditions, then windows
    over those; and the users' own signals on top of frame columns."""
    one = max(36, params[113]["lookback"] + 1)
    return max(one + max(72, params[111]["z_window"]) + 5, max((s.back for s in signals), default=0))


def _layer_one(have: set[str], params: dict) -> dict[str, Column]:
    """Lags and short windows of frame columns."""
    w = block_window(KEYS)
    S, B = c("eth_slope_sign_1h"), c("btc_slope_sign_1h")
    close, p = c("close_btc"), params
    out = {
        "S1": W.lag(S, w), "S2": W.lag(S, w, 2), "B1": W.lag(B, w),
        "R1": W.lag(c("spread_regime"), w),
        "X1": W.lag(c("dist_to_vwap48_z"), w), "D1": W.lag(c("dist_to_vwap48"), w),
        "A1": W.lag(c("atr14"), w), "A2": W.lag(c("atr14"), w, 2), "A3": W.lag(c("atr14"), w, 3),
        "BD1": W.lag(c("bar_dir_btc"), w), "BD2": W.lag(c("bar_dir_btc"), w, 2),
        "PH1": W.lag(c("prior_high_12"), w), "PH2": W.lag(c("prior_high_12"), w, 2),
        "PL1": W.lag(c("prior_low_12"), w), "PL2": W.lag(c("prior_low_12"), w, 2),
        "C1": W.lag(close, w), "C2": W.lag(close, w, 2),
        "C12": W.prior_max(close, w, 12),
        "MR20": W.quantile(c("high_btc") - c("low_btc"), .5, w, 20),
        "MV20": W.quantile(c("volume_btc"), .5, w, 20),
        "H113": W.prior_max(c("high_btc"), w, p[113]["lookback"]),
        "L113": W.prior_min(c("low_btc"), w, p[113]["lookback"]),
        "SPR": c("ret1_btc") - c("ret1_eth"),
        "DV1H": c("_r1h_btc") - c("_r1h_eth"),
        "QTR1": W.lag(c("tr_btc"), w), "QTR10": W.lag(c("tr_btc_q10"), w),
    }
    if "oi_contracts_btc" in have:
        oi = c("oi_contracts_btc")
        out |= {f"OI{k}": W.lag(oi, w, k) for k in (12, 24, 36)}
    return out


def _conditions(have: set[str]) -> dict[str, Column]:
    """Row conditions whose rising edge or recent history a signal needs."""
    sp = c("spread_pct")
    out = {
        "k_neutral": between(sp, .10, .90),
        "k_shock_eth": ge(c("ret1_abs_eth_pct"), .95),
        "k_shock_btc": ge(c("ret1_abs_btc_pct"), .90),
        "k_flip": ne(c("eth_slope_sign_1h"), c("S1")) & ne(c("eth_slope_sign_1h"), 0.0),
        "k_up_brk": gt(c("close_btc"), c("prior_high_12")),
        "k_dn_brk": lt(c("close_btc"), c("prior_low_12")),
        "k_r4h_btc": gt(c("_r4h_btc"), c("_r4h_btc_q80")),
        "k_r4h_eth": gt(c("_r4h_eth"), c("_r4h_eth_q80")),
        "k_tight": le(c("tr_btc"), c("tr_btc_q25")),
        "k_rv_low": lt(c("rv48_pct_btc"), .20),
    }
    if "funding_btc_pct" in have:
        f, fs = c("funding_btc_pct"), c("funding_btc_sign")
        S = c("eth_slope_sign_1h")
        out |= {"k_f_low": le(f, .10), "k_f_high": ge(f, .85), "k_f_pos": gt(fs, 0.0),
                "k_f_agree": eq(S, fs) & ne(S, 0.0) & ne(fs, 0.0)}
        if "funding_spread_pct" in have:
            out["k_f_spread"] = ge(c("funding_spread_pct"), .80)
    for side in ("long", "short"):
        for a in ("btc", "eth"):
            if f"{side}_liq_{a}_pct" in have:
                v = c(f"{side}_liq_{a}_pct")
                out |= {f"k_{side}_{a}_{int(t * 100)}": ge(v, t) for t in (.80, .90, .95)}
    if "long_liq_eth_pct" in have and "long_liq_btc_pct" in have:
        out["k_both_liq"] = ge(c("long_liq_btc_pct"), .90) & ge(c("long_liq_eth_pct"), .70)
    if "liq_imbalance_btc" in have:
        imb, act = c("liq_imbalance_btc"), ge(c("total_liq_btc_pct"), .70)
        out |= {"k_imb80": ge(imb, .80), "k_long_dom": act & ge(imb, .65), "k_short_dom": act & le(imb, .35)}
    if "oi_velocity" in have:
        out["k_oi_vel"] = gt(c("oi_velocity"), c("_oi_vel_q80"))
    return out


def _edges(conds: dict[str, Column], params: dict) -> dict[str, Column]:
    """Window columns over the conditions."""
    w = block_window(KEYS)
    on = lambda k: W.onset(c(k), w)
    out = {f"on_{k[2:]}": on(k) for k in conds if k not in ("k_shock_btc", "k_flip", "k_tight", "k_rv_low")}
    lagb = lambda k, n=1: F.coalesce(W.lag(c(k), w, n), F.lit(False))
    out |= {
        "after_eth_shock": W.recent(c("k_shock_eth"), w, 6),
        "shock_ends": lagb("k_shock_btc") & ~c("k_shock_btc"),
        "recent_flip": W.recent(c("k_flip"), w, 3),
        "up1": lagb("k_up_brk"), "up2": lagb("k_up_brk", 2),
        "dn1": lagb("k_dn_brk"), "dn2": lagb("k_dn_brk", 2),
        "tight5": F.coalesce(F.sum(c("k_tight").cast("int")).over(w.rowsBetween(-5, -1)) == 5, F.lit(False)),
        "rv_low_48": W.sustained(c("k_rv_low"), w, 48),
        "DV1": F.coalesce(W.lag(c("DV1H"), w), F.lit(0.0)),
    }
    n = params[111]["z_window"]
    m, s = W.mean(c("SPR"), w, n), W.std(c("SPR"), w, n)
    out["spread_z"] = (c("SPR") - m) / F.nullif(s, F.lit(0.0))
    if "k_f_high" in conds:
        out |= {"f_high_36": W.sustained(c("k_f_high"), w, 36), "k_f_pos_72": W.sustained(c("k_f_pos"), w, 72)}
    return out


def _edges_two(conds: dict[str, Column]) -> dict[str, Column]:
    w = block_window(KEYS)
    out = {"after_shock": W.recent(c("shock_ends"), w, 4, shift=0)}
    if "k_f_high" in conds:
        out["on_f_pos_72"] = W.onset(c("k_f_pos_72"), w)
    return out


def _signals(have: set[str], params: dict) -> dict[str, Signal]:
    S, B, sp = c("eth_slope_sign_1h"), c("btc_slope_sign_1h"), c("spread_pct")
    nz = ne(S, 0.0)
    agree = eq(B, S) & nz
    flip = c("k_flip")
    flip_b = ne(B, c("B1")) & ne(B, 0.0)
    bull, bear = ne(S, c("S1")) & eq(S, 1.0), ne(S, c("S1")) & eq(S, -1.0)
    dn = eq(S, -1.0) & eq(c("S1"), 1.0)
    R, R1 = c("spread_regime"), c("R1")
    moved = (ne(R, R1)) & R1.isNotNull()
    reg = lambda name: eq(c("hmm_regime"), name) if "hmm_regime" in have else F.lit(False)
    T, G, V = reg("TRENDING"), reg("RANGING"), reg("VOLATILE")
    vol, ar, ap = c("volume_btc_pct"), c("ret1_abs_btc"), c("ret1_abs_btc_pct")
    z, zp = c("vwap_z"), c("vwap_z_pct")
    d, dz = c("dist_to_vwap48"), c("dist_to_vwap48_z")
    sd, adz = sign(c("dist_to_vwap48")), F.abs(c("dist_to_vwap48_z"))
    rv, at, er = c("rv48_pct"), c("atr14_pct"), c("er20")
    L, N = F.lit(1.0), F.lit(-1.0)
    up_or_down = lambda hi, lo_: F.when(hi, L).when(lo_, N)
    ts = c("ts")
    enter_tail, exit_tail = moved & eq(R1, 0) & ne(R, 0), moved & ne(R1, 0) & eq(R, 0)
    slope_ap, slope_z = c("eth_slope_abs_pct_1h"), c("eth_slope_z_1h")
    long97, short97 = ge(sp, .10) & gt(S, 0.0) & ge(slope_ap, .60), lt(sp, .10) & lt(S, 0.0) & ge(slope_ap, .60)
    long92 = ge(slope_ap, .50) & eq(S, 1.0) & eq(c("S1"), 1.0) & eq(c("S2"), 1.0)
    short92 = ge(slope_ap, .50) & eq(S, -1.0)
    strong95 = ge(F.abs(slope_z), 1.25) & nz
    med95 = between(F.abs(slope_z), .90, 1.25) & nz
    cand100 = agree & ge(slope_ap, .75) & between(ap, .30, .85)
    base15 = le(z, -2.0) & F.coalesce(c("eth_above_ema20_1h"), F.lit(False)) & gt(S, 0.0)
    neutral = c("k_neutral")
    eshock = ge(c("ret1_abs_eth"), c("ret1_abs_eth_q90"))
    bshock = ge(ar, c("ret1_abs_btc_q90"))
    bd, ed = sign(c("ret1_btc")), sign(c("ret1_eth"))
    close = c("close_btc")
    fail_hi1, fail_lo1 = c("up1") & le(close, c("PH1")), c("dn1") & ge(close, c("PL1"))
    fail_hi2, fail_lo2 = c("up2") & le(close, c("PH2")), c("dn2") & ge(close, c("PL2"))
    bdir = c("bar_dir_btc")
    up3 = eq(bdir, 1.0) & eq(c("BD1"), 1.0) & eq(c("BD2"), 1.0)
    dn3 = eq(bdir, -1.0) & eq(c("BD1"), -1.0) & eq(c("BD2"), -1.0)
    p1, p2, p3 = params[111], params[112], params[113]
    sz = c("spread_z")
    z111 = up_or_down(le(sz, -p1["z_entry"]), ge(sz, p1["z_entry"]))
    gate113 = ge(er, p3["er_min"]) & between(rv, p3["rv_lo"], p3["rv_hi"]) & lt(adz, p3["z_max"])
    up113, dn113 = gate113 & gt(close, c("H113")), gate113 & lt(close, c("L113"))
    decoupled = lt(c("btc_eth_corr_2h"), c("_corr_p20"))
    de = c("delta_er")
    sb, se = sign(c("dist_to_vwap48_btc")), sign(c("dist_to_vwap48_eth"))

    def two_sided(hi: Column, lo_: Column, **kw) -> Signal:
        return Signal(hi | lo_, up_or_down(hi, lo_), **kw)

    s = {
        # lead slope and spread regime
        "slope_afternoon": Signal(in_hours(ts, (12, 20)) & F.coalesce(c("eth_slope_stable_2_1h"), F.lit(False)) & nz, S),
        "regime_moves_12": Signal(moved & nz, S, gap=12),
        "regime_moves_10": Signal(moved & nz, S, gap=10),
        "slope_mid_vol": Signal(ge(ar, c("ret1_abs_btc_q40")) & lt(ar, c("ret1_abs_btc_q80")) & nz, S),
        "slope_z_one": two_sided(ge(slope_z, 1.0), le(slope_z, -1.0)),
        "strong_slope_calm": Signal(agree & ge(c("eth_slope_abs_1h"), c("eth_slope_abs_q70_1h"))
                                    & ge(ar, c("ret1_abs_btc_q30")) & lt(ar, c("ret1_abs_btc_q70")), S, gap=18),
        "slope_confirmed": two_sided(long92, short92),
        "slope_no_shock": Signal(between(ap, .25, .75) & ~c("k_shock_eth") & ~c("after_eth_shock") & nz, S),
        "slope_sessions": Signal((weekday_of(ts) <= 4) & in_hours(ts, (7, 11), (13, 17)) & agree, S),
        "slope_two_tier": Signal(strong95 | med95, S, gap=24,
                                 tier=F.when(strong95, 6).otherwise(24)),
        "tail_fade_return": Signal((enter_tail | exit_tail) & nz,
                                   F.when(enter_tail, -S).when(exit_tail, S), gap=14),
        "spread_slope": two_sided(long97, short97, gap=8),
        "slope_after_shock": Signal(between(ap, .20, .90) & ~c("after_shock") & nz, S),
        "fresh_flip_hours": Signal(in_hours(ts, (6, 8), (12, 14)) & c("recent_flip") & agree, S),
        BEST: Signal(cand100, S),
        "spread_tails": two_sided(lt(sp, .10), ge(sp, .90)),
        "spread_turns_neutral": Signal(c("on_neutral"), L),
        "legs_disagree_lead": Signal(ne(S, B) & nz & ne(B, 0.0), S),
        "slope_neutral": Signal(between(sp, .10, .90) & nz, S),
        "slope_long_tail": Signal(ge(sp, .90) & nz, S),
        "flip_lead": Signal(flip, S),
        "legs_agree": Signal(eq(B, S) & ne(B, 0.0), B),
        "legs_disagree_base": Signal(ne(B, S) & ne(B, 0.0) & nz, -B),
        "flip_base": Signal(flip_b, B),
        "spread_stretched": Signal(ge(sp, .70) & le(zp, .30), L),
        "spread_stretched_tight": Signal(ge(sp, .85) & le(zp, .15), L),
        "ranging_vol_spread": Signal(ge(c("atr14_pct_btc"), .70) & ge(sp, .70) & G, L),
        "vol_low_spread": Signal(ge(c("rv48_pct_btc"), .70) & le(sp, .30), N),
        "flip_below_vwap": Signal(flip & lt(c("dist_to_vwap48_z_btc"), 0.0), S),
        # shocks and range
        "wide_heavy_bar": Signal(gt(c("high_btc") - c("low_btc"), c("MR20") * 1.8)
                                 & gt(c("volume_btc"), c("MV20") * 1.8), bdir),
        "base_shock": Signal(bshock, bd), "base_shock_fade": Signal(bshock, -bd),
        "lead_shock": Signal(eshock, ed), "lead_shock_alone": Signal(eshock & ~bshock, ed),
        "both_shock": Signal(eshock & bshock & eq(ed, bd) & ne(ed, 0.0), ed),
        "wide_base": Signal(ge(c("tr_btc"), c("tr_btc_q90")), bdir),
        "after_narrow": Signal(le(c("QTR1"), c("QTR10")), bdir),
        "expansion": Signal(c("tight5") & gt(c("tr_btc"), c("tr_btc_q25")), bdir),
        "wide_lead": Signal(ge(c("tr_eth"), c("tr_eth_q90")), c("bar_dir_eth")),
        "failed_break_2": Signal(
            fail_hi1 | fail_hi2 | fail_lo1 | fail_lo2,
            F.when(fail_hi1 | fail_hi2, N).when(fail_lo1 | fail_lo2, L)),
        "range_break": two_sided(c("k_up_brk"), c("k_dn_brk")),
        "failed_break_1": Signal(fail_hi1 | fail_lo1, F.when(fail_hi1, N).when(fail_lo1, L)),
        "three_bars": two_sided(up3, dn3),
        "filtered_break": two_sided(up113, dn113),
        # mean reversion and momentum around the average price
        "dip_confirmed": Signal(base15, L), "dip_shock": Signal(base15 & eshock, L),
        "dip_shock_neutral": Signal(base15 & eshock & neutral, L), "dip_neutral": Signal(base15 & neutral, L),
        "dip_mid": Signal(base15 & between(sp, .25, .75), L),
        "low_z_neutral": Signal(le(z, -2.0) & neutral, L), "high_z_neutral": Signal(ge(z, 2.0) & neutral, N),
        "far_z_fade": Signal(ge(F.abs(z), 3.0), -sign(z)),
        "z_fade_trending": Signal((le(zp, .30) | ge(zp, .70)) & T, F.when(ge(zp, .70), N).otherwise(L)),
        "z_follow_ranging": Signal((le(zp, .30) | ge(zp, .70)) & G, F.when(le(zp, .30), N).otherwise(L)),
        "low_z": Signal(le(z, -2.0), L), "high_z": Signal(ge(z, 2.0), N),
        "base_4h_stretch": Signal(c("on_r4h_btc"), N), "lead_4h_stretch": Signal(c("on_r4h_eth"), N),
        "z_high_trending": Signal(ge(zp, .70) & T, L),
        "lead_dist_trending": Signal(ge(c("dist_z_eth_pct"), .70) & T, L),
        # volatility state
        "vol_band": Signal(between(at, .65, .90) & between(rv, .40, .80) & ne(sd, 0.0), sd),
        "compressed_break": Signal(lt(at, .30) & lt(rv, .35) & gt(adz, 1.2) & le(F.abs(c("X1")), 1.2) & ne(sd, 0.0), sd),
        "shock_decay": Signal(ge(rv, .90) & lt(c("atr14") - c("A1"), 0.0) & lt(c("A1") - c("A2"), 0.0)
                              & lt(c("A2") - c("A3"), 0.0) & eq(sd, sign(c("D1"))) & ne(sd, 0.0), -sd),
        "ratio_band": Signal(between(c("atr_rv_ratio_pct_btc"), .45, .70)
                             & between(c("abs_vwap_dist_pct"), .50, .85) & ne(sd, 0.0), sd),
        "ratio_band_param": Signal(between(rv, p2["rv_lo"], p2["rv_hi"])
                                   & between(c("atr_rv_pct_ratio_pct"), p2["ratio_lo"], p2["ratio_hi"])
                                   & between(adz, p2["z_lo"], p2["z_hi"]) & ne(sd, 0.0), sd),
        "rv_trending": Signal(ge(c("rv48_pct_btc"), .70) & T, L),
        "lead_atr_trending": Signal(ge(c("atr14_pct_eth"), .70) & T, L),
        "atr_ranging": Signal(ge(c("atr14_pct_btc"), .70) & G, L),
        "lead_dist_volatile": Signal(ge(c("dist_z_eth_pct"), .70) & ge(c("rv48_pct_btc"), .70) & V, N),
        # efficiency
        "choppy_fade": Signal(le(er, .25) & ge(adz, 1.5) & lt(rv, .85) & ne(sd, 0.0), -sd),
        "efficient_follow": Signal(ge(er, .60) & between(adz, .6, 1.8) & between(at, .35, .85) & ne(sd, 0.0), sd),
        "efficiency_switch": Signal(ge(adz, .9) & lt(rv, .92) & ne(sd, 0.0), F.when(lt(er, .40), -sd).otherwise(sd)),
        # divergence between the legs
        "efficiency_gap": Signal(ge(c("abs_delta_er_pct"), .85) & ge(F.abs(c("dist_to_vwap48_z_btc")), .7)
                                 & lt(c("rv48_pct_btc"), .90) & ne(sign(de), 0.0),
                                 F.when(gt(de, 0.0), N).when(lt(de, 0.0), L).otherwise(0.0)),
        "lead_vol_lead": Signal(ge(c("atr14_pct_eth"), .70) & lt(c("atr14_pct_btc"), .50)
                                & between(c("rv48_pct_btc"), .30, .85) & ne(se, 0.0), se),
        "opposite_sides": Signal(ne(sb, 0.0) & ne(se, 0.0) & ne(sb, se)
                                 & ge(F.abs(c("dist_to_vwap48_z_btc")), 1.0) & ge(F.abs(c("dist_to_vwap48_z_eth")), 1.0)
                                 & le(c("er20_btc"), .50) & le(c("er20_eth"), .50), -sb),
        "spread_z_fade": Signal(z111.isNotNull() & between(c("rv48_pct_btc"), p1["rv_lo"], p1["rv_hi"])
                                & between(c("rv48_pct_eth"), p1["rv_lo"], p1["rv_hi"])
                                & in_session(ts, p1["start"], p1["end"]), z111, gap=f"H+{p1['cooldown']}"),
        "base_leads_1h": Signal(le(c("DV1"), 0.0) & gt(c("DV1H"), .001), L),
        "flip_decoupled": Signal(flip & decoupled, S), "bull_flip_decoupled": Signal(bull & decoupled, L),
        # volume
        **{f"flip_volume_{int(t * 100)}": Signal(flip & ge(vol, t), S) for t in (.75, .80, .85)},
        "flip_lead_volume": Signal(flip & ge(c("volume_eth_pct"), .80), S),
        "break_volume": Signal(gt(close, c("C12")) & ge(vol, .75), L),
        "quiet_move_fade": Signal(ge(ap, .80) & le(vol, .20) & ne(bdir, 0.0), -bdir),
        # direction splits, regimes, compression
        "flip_up": Signal(flip & gt(S, 0.0), S), "flip_dn": Signal(flip & lt(S, 0.0), S),
        "flip_volume_up": Signal(flip & ge(vol, .80) & gt(S, 0.0), S),
        "flip_volume_dn": Signal(flip & ge(vol, .80) & lt(S, 0.0), S),
        "flip_trending": Signal(flip & T, S), "flip_ranging": Signal(flip & G, S), "flip_volatile": Signal(flip & V, S),
        "flip_volume_trending": Signal(flip & ge(vol, .80) & T, S),
        "flip_volume_volatile": Signal(flip & ge(vol, .80) & V, S),
        "flip_compressed": Signal(flip & c("rv_low_48"), S),
    }
    if "funding_btc_pct" in have:
        f, fs = c("funding_btc_pct"), c("funding_btc_sign")
        cool = lt(f, .85)
        stretched = lambda hi, lo_: (ge(sp, hi) & eq(S, 1.0) & cool) | (le(sp, lo_) & eq(S, -1.0) & cool)
        s |= {
            "spread_extreme_cool": Signal(stretched(.97, .03), S), "spread_tail_cool": Signal(stretched(.90, .10), S),
            "crowded_short_tail": Signal(ge(f, .90) & lt(sp, .10), N),
            "funding_flip": Signal(F.coalesce(c("funding_btc_flip"), F.lit(False)), fs),
            "funding_trending": Signal(ge(f, .70) & T, L), "funding_volatile": Signal(ge(f, .70) & V, L),
            "lead_atr_funding_ranging": Signal(le(c("atr14_pct_eth"), .30) & le(f, .30) & G, N),
            "funding_washed": Signal(c("on_f_low"), L),
            "dn_crowded_85": Signal(dn & ge(f, .85), N), "dn_crowded_80": Signal(dn & ge(f, .80), N),
            "funding_agrees": Signal(c("on_f_agree"), S),
            "dn_crowded_3h": Signal(dn & c("f_high_36"), N), "funding_positive_6h": Signal(c("on_f_pos_72"), N),
            "flip_against_funding": Signal(flip & ne(fs, S) & ne(fs, 0.0), S),
        }
        if "funding_spread_pct" in have:
            s["funding_gap"] = Signal(c("on_f_spread"), N)
    if "oi_contracts_btc" in have:
        oi, o12, o24, o36 = c("oi_contracts_btc"), c("OI12"), c("OI24"), c("OI36")
        faster = gt(oi - o12, o12 - o24)
        s |= {"flip_oi_faster": Signal(flip & faster, S), "bull_oi_faster": Signal(bull & faster, L),
              "bear_oi_rising": Signal(bear & gt(oi, o12) & gt(o12, o24) & gt(o24, o36), N),
              "oi_velocity_high": Signal(c("on_oi_vel"), L),
              "flip_oi": Signal(flip & ge(c("oi_btc_pct"), .80), S)}
    if "long_liq_btc_pct" in have:
        LL, TL = c("long_liq_btc_pct"), ge(c("total_liq_btc_pct"), .70)
        s |= {
            **{f"long_liq_{t}": Signal(c(f"on_long_btc_{t}"), N) for t in (80, 90, 95)},
            **{f"short_liq_{t}": Signal(c(f"on_short_btc_{t}"), L) for t in (80, 90)},
            "long_liq_bear": Signal(c("on_long_btc_90") & eq(S, -1.0), N),
            "short_liq_bull": Signal(c("on_short_btc_90") & eq(S, 1.0), L),
            "liq_imbalanced": Signal(c("on_imb80"), N),
            "long_dominant": Signal(c("on_long_dom"), N), "short_dominant": Signal(c("on_short_dom"), L),
            "dn_long_liq": Signal(dn & ge(LL, .70), N),
            "flip_volume_liq": Signal(flip & ge(vol, .80) & TL, S),
            "flip_volume_liq_up": Signal(flip & ge(vol, .80) & TL & gt(S, 0.0), S),
            "flip_volume_liq_dn": Signal(flip & ge(vol, .80) & TL & lt(S, 0.0), S),
            "flip_volume_liq_trending": Signal(flip & ge(vol, .80) & TL & T, S),
        }
        if "oi_btc_pct" in have:
            s["flip_oi_liq"] = Signal(flip & ge(c("oi_btc_pct"), .80) & TL, S)
        if "long_liq_eth_pct" in have:
            s |= {"lead_long_liq": Signal(c("on_long_eth_90"), N), "lead_short_liq": Signal(c("on_short_eth_90"), L),
                  "both_long_liq": Signal(c("on_both_liq"), N)}
    return s


# Which rules use which signal, by family and rule number
CATALOGUE: dict[str, dict[str, str]] = {
    "cross_asset_regime": {
        "slope_afternoon": (86,), "regime_moves_12": (87,), "slope_mid_vol": (88,), "slope_z_one": (89,),
        "strong_slope_calm": (90,), "regime_moves_10": (91,), "slope_confirmed": (92,), "slope_no_shock": (93,),
        "slope_sessions": (94,), "slope_two_tier": (95,), "tail_fade_return": (96,), "spread_slope": (97,),
        "slope_after_shock": (98,), "fresh_flip_hours": (99,), "best_two_a_day": (100,), "spread_tails": (19,),
        "spread_turns_neutral": (29,), "legs_disagree_lead": (30,), "slope_neutral": (37,), "slope_long_tail": (38,),
        "flip_lead": (39, 60, 61, 64, 65, 67, 70, 71, 73, 75, 77, 79, 83, 84, 85), "legs_agree": (40,), "legs_disagree_base": (41,),
        "flip_base": (59, 62, 63, 66, 68, 69, 72, 74, 76, 78, 80, 81, 82), "spread_extreme_cool": (124,),
        "spread_stretched": (135,), "spread_stretched_tight": (136,), "ranging_vol_spread": (137,),
        "vol_low_spread": (139,), "flip_below_vwap": (242,), "flip_oi_faster": (250, 251, 252, 259), "bull_oi_faster": (262,)},
    "shock_structure": {"wide_heavy_bar": (27,), "base_shock": (42,), "base_shock_fade": (43,), "lead_shock": (44,),
                        "lead_shock_alone": (45,), "both_shock": (46,)},
    "volatility_conditioning": {"wide_base": (47,), "after_narrow": (48,), "expansion": (49,), "wide_lead": (50,)},
    "mean_reversion": {"dip_confirmed": (15,), "dip_shock": (18,), "dip_shock_neutral": (22,), "dip_neutral": (23,),
                       "dip_mid": (26,), "low_z_neutral": (51,), "high_z_neutral": (52,), "far_z_fade": (53,),
                       "z_fade_trending": (130,), "z_follow_ranging": (131,), "low_z": (235,), "high_z": (236,),
                       "base_4h_stretch": (253, 254, 255), "lead_4h_stretch": (261,)},
    "range_structure": {"failed_break_2": (28,), "range_break": (54,), "failed_break_1": (55,), "three_bars": (56,),
                        "filtered_break": (113,)},
    "volatility_state": {"vol_band": (101,), "compressed_break": (102,), "shock_decay": (103,), "ratio_band": (104,),
                         "ratio_band_param": (112,), "rv_trending": (128,), "lead_atr_trending": (129,),
                         "atr_ranging": (133,), "lead_dist_volatile": (134,), "lead_atr_funding_ranging": (138,)},
    "efficiency_mean_reversion": {"choppy_fade": (105,), "efficient_follow": (106,), "efficiency_switch": (107,)},
    "cross_asset_divergence": {"efficiency_gap": (108,), "lead_vol_lead": (109,), "opposite_sides": (110,),
                               "spread_z_fade": (111,), "base_leads_1h": (245,), "flip_decoupled": (256, 257, 258, 260),
                               "bull_flip_decoupled": (263,)},
    "funding_regime": {"crowded_short_tail": (121,), "funding_flip": (122,), "spread_tail_cool": (123,),
                       "funding_trending": (127,), "funding_volatile": (132,), "funding_washed": (140,),
                       "dn_crowded_85": (141,), "funding_gap": (142,), "funding_agrees": (143,), "dn_crowded_3h": (144,),
                       "dn_crowded_80": (174, 175), "funding_positive_6h": (238,)},
    "momentum": {"z_high_trending": (125,)}, "cross_asset": {"lead_dist_trending": (126,)},
    "volume_state": {"flip_volume_80": (145, 159, 160, 161, 164, 165, 166, 167, 169, 170, 171), "flip_volume_75": (162, 172),
                     "flip_volume_85": (163, 173), "flip_lead_volume": (168,), "break_volume": (146,),
                     "quiet_move_fade": (147,)},
    "oi_liq": {"flip_oi": (176, 181, 182, 183, 225), "long_liq_90": (177, 184, 191, 221, 222, 240),
               "short_liq_90": (178, 185, 192, 223, 224, 241), "long_liq_80": (188,), "long_liq_95": (189,),
               "short_liq_80": (190,), "lead_long_liq": (193,), "lead_short_liq": (194,), "liq_imbalanced": (195,),
               "both_long_liq": (196,), "flip_oi_liq": (197,), "dn_long_liq": (179, 186), "flip_volume_liq": (180, 187),
               "flip_against_funding": (226,), "long_liq_bear": (227,), "short_liq_bull": (228,),
               "bear_oi_rising": (239,), "long_dominant": (243, 246, 247, 248, 249), "oi_velocity_high": (244,),
               "short_dominant": (264,)},
    "direction_split": {"flip_up": (215,), "flip_dn": (216,), "flip_volume_up": (217,), "flip_volume_dn": (218,),
                        "flip_volume_liq_up": (219,), "flip_volume_liq_dn": (220,)},
    "regime_conditioning": {"flip_trending": (229,), "flip_ranging": (230,), "flip_volatile": (231,),
                            "flip_volume_trending": (232,), "flip_volume_volatile": (233,),
                            "flip_volume_liq_trending": (234,)},
    "vol_compression": {"flip_compressed": (237,)},
    "exit_logic": {"flip_lead": (198, 199, 200, 201, 211, 214), "flip_volume_80": (202, 203, 204, 205, 212),
                   "long_liq_90": (206, 207, 213), "short_liq_90": (208,), "dn_long_liq": (209,), "flip_volume_liq": (210,)},
}


def rules(numbers: Iterable[int] | None = None) -> list[Rule]:
    horizon = {n: h for h, t in HORIZON.items() for n in t}
    lag, lead = set(ENTRY_LAG), set(TRADES_LEAD)
    odd, even = set(ODD_DAYS), set(EVEN_DAYS)
    hours = {n: h for h, t in SESSIONS.items() for n in t}
    want = None if numbers is None else set(numbers)
    return sorted((Rule(n, fam, sig, horizon.get(n, 8), int(n in lag), "eth" if n in lead else "btc",
                        1 if n in odd else 0 if n in even else -1, hours.get(n), EXITS.get(n, {}))
                   for fam, sigs in CATALOGUE.items() for sig, t in sigs.items() for n in t
                   if want is None or n in want), key=lambda r: r.number)


def available(rs: list[Rule], columns: Iterable[str]) -> list[Rule]:
    """The rules whose signals the frame can express."""
    have = signal_table(columns)
    return [r for r in rs if r.signal in have]


def signal_table(columns: Iterable[str], params: dict = PARAMS) -> dict[str, Signal]:
    return _signals(set(columns), params)


BEST = "best_two_a_day"


def best_of_day(hits: DataFrame, score: str = "eth_slope_abs_pct_1h", top: int = 2) -> DataFrame:
    """Candidates of the two-a-day rule: the strongest two of each (pair, day), the earlier one on a tie. Only
    the rows of that signal are shuffled, and a day's candidates are at most its bars."""
    day = Window.partitionBy(*KEYS, day_of(c("ts"))).orderBy(F.col(score).desc_nulls_last(), "idx")
    best = hits.where(c("signal") == BEST).withColumn("_n", F.row_number().over(day)).where(c("_n") <= top).drop("_n")
    return hits.where(c("signal") != BEST).unionByName(best)


def signal_rows(x: DataFrame, rs: list[Rule], params: dict = PARAMS, keep: Iterable[str] = (),
                table: dict[str, Signal] | None = None) -> DataFrame:
    """Blocked frame -> one long row per (bar, signal) that fires: pair, ts, idx, signal, dir, pre_gap.

    ``keep`` lists further columns to carry. Halo rows are dropped here. Candidates of the two-a-day rule are
    not yet cut to two (``best_of_day``).
    """
    have = set(x.columns)
    names = sorted({r.signal for r in rs})
    table = table or _signals(have, params)
    missing = [n for n in names if n not in table]
    if missing:
        raise ValueError(f"frame lacks the inputs of: {missing}")
    offer = have | frame_columns(have)
    conds = _conditions(offer)
    need = needed_columns(rs, offer, table, params) | set(keep)
    for layer in (_layer_one(offer, params), conds, _edges(conds, params), _edges_two(conds)):
        used = {n: e for n, e in layer.items() if n in need}
        if used:
            x = x.withColumns(used)
    for n in names:
        for name, e in table[n].helpers.items():
            x = x.withColumn(name, e)
    x = x.where("own")
    hits = []
    for n in names:
        s = table[n]
        gap = s.tier if s.tier is not None else F.lit(s.gap if isinstance(s.gap, int) else None)
        hits.append(F.when(s.mask & ne(s.direction, 0.0), F.struct(
            F.lit(n).alias("signal"), s.direction.cast("double").alias("dir"), gap.cast("int").alias("pre_need"))))
    # evaluated in small arrays, so that each stays within one generated method
    groups = [F.array_compact(F.array(*hits[i:i + 16])) for i in range(0, len(hits), 16)]
    return (x.select(*KEYS, "ts", "idx", *keep, F.explode(F.concat(*groups)).alias("h"))
            .select(*KEYS, "ts", "idx", *keep, "h.signal", "h.dir", "h.pre_need"))


def frame_columns(have: Iterable[str]) -> set[str]:
    """All columns a frame can offer for the given aligned columns, before it is built."""
    have = set(have)
    out = set()
    for a in ("btc", "eth"):
        if f"funding_rate_{a}" in have:
            out |= {f"funding_{a}_{k}" for k in ("pct", "sign", "flip", "z")}
        if f"oi_contracts_{a}" in have:
            out |= {f"oi_{a}_pct", "oi_velocity"}
        if f"long_liq_usd_{a}" in have:
            out |= {f"{s}_liq_{a}_pct" for s in ("long", "short", "total")} | {f"liq_imbalance_{a}"}
    if {"funding_rate_btc", "funding_rate_eth"} <= have:
        out |= {"funding_spread", "funding_spread_pct"}
    return have | out


def needed_columns(rs: list[Rule], have: Iterable[str], table: dict[str, Signal], params: dict = PARAMS) -> set[str]:
    """Frame columns the signals of these rules read, through the helper layers."""
    offer = set(have)
    conds = _conditions(offer)
    layers = {**_layer_one(offer, params), **conds, **_edges(conds, params), **_edges_two(conds)}
    names = lambda col: set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", str(col)))
    todo, seen = set(), set()
    for r in rs:
        s = table[r.signal]
        todo |= names(s.mask) | names(s.direction) | (names(s.tier) if s.tier is not None else set())
        for e in s.helpers.values():
            todo |= names(e)
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in layers:
            todo |= names(layers[n])
    return seen


def rule_table(spark, rs: list[Rule], table: dict[str, Signal]) -> DataFrame:
    """The rule dimension: one small row per rule. ``pre_gap`` is set where candidates are thinned before
    the holding period thins them."""

    def gap(r: Rule) -> int | None:
        g = table[r.signal].gap
        return None if g == "H" else g if isinstance(g, int) else r.horizon + int(g[2:])

    rows = [Row(rule_id=r.rule_id, family=r.family, signal=r.signal, horizon=r.horizon, offset=r.offset,
                leg=r.leg, parity=r.parity, h_from=r.hours[0] if r.hours else 0,
                h_to=r.hours[1] if r.hours else 24, pre_gap=gap(r), has_exit=bool(r.exits)) for r in rs]
    return spark.createDataFrame(rows, "rule_id string, family string, signal string, horizon int, offset int, "
                                       "leg string, parity int, h_from int, h_to int, pre_gap int, has_exit boolean")
