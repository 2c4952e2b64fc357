"""The whole rule catalogue in SQL: every signal, thinning, entry, exit and post-filter, rules without events included."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.plans import events as EV
from barlab.plans import rules as RL

from .fixtures import CFG, EB, PAIR, SLOW, pair, slow
from .q_features import COARSE, PW, _f1
from .registry import query, r6, rank_sql, win

L, D, DAY = 96, 120, 24
NE = lambda a, b: f"coalesce({a} <> {b}, true)"
Y = lambda *c: "(" + " AND ".join(f"coalesce({x}, false)" for x in c) + ")"
ANY = lambda *c: "(" + " OR ".join(c) + ")"
lag = lambda e, k=1: f"lag({e}, {k}) OVER ({PW})"
over = lambda e, a, b: f"{e} OVER ({PW} ROWS BETWEEN {a} PRECEDING AND {b})"
q = lambda c, p, n=L, need=None: win("quantile_cont", c, n, PW, need, f", {p}")

_WIDE = f"""w0 AS (SELECT f4.*, sl.* EXCLUDE (pair, ts) FROM f4 ASOF LEFT JOIN sl ON f4.pair = sl.pair AND f4.ts >= sl.ts),
w1 AS (SELECT *, high_btc - low_btc AS rng, atr14_btc/nullif(rv48_btc, 0) AS atr_rv, atr14_pct_btc/greatest(rv48_pct_btc, 1e-12) AS pct_ratio, abs(dist_to_vwap48_btc) AS adist, abs(delta_er) AS ader,
 coalesce(c_btc/c48_btc - 1, 0) AS r4b, coalesce(c_eth/c48_eth - 1, 0) AS r4e, coalesce(c_btc/c12_btc - 1, 0) - coalesce(c_eth/c12_eth - 1, 0) AS dv, coalesce(ret1_btc, 0) AS zb, coalesce(ret1_eth, 0) AS ze, ret1_btc - ret1_eth AS spr,
 funding_rate_eth - funding_rate_btc AS fsp, sign(funding_rate_btc)::DOUBLE AS fs, oi_contracts_btc AS oi, oi_contracts_btc - {lag('oi_contracts_btc', 12)} - ({lag('oi_contracts_btc', 12)} - {lag('oi_contracts_btc', 24)}) AS ov,
 coalesce(long_liq_usd_btc, 0) AS llb, coalesce(short_liq_usd_btc, 0) AS slb, coalesce(long_liq_usd_btc, 0) + coalesce(short_liq_usd_btc, 0) AS tlb, coalesce(long_liq_usd_eth, 0) AS lle, coalesce(short_liq_usd_eth, 0) AS sle FROM w0),
w2 AS MATERIALIZED (SELECT *, {", ".join(f"{q('ar_btc', p / 100)} AS q{p}" for p in (30, 40, 70, 80))}, {q('ar_eth', .9)} AS qe90, {rank_sql('ar_eth', L, PW)} AS ape, {q('tr_btc', .9)} AS tq90, {q('tr_btc', .1)} AS tq10, {q('tr_eth', .9)} AS teq90,
 {rank_sql('atr14_eth', L, PW)} AS ate, {rank_sql('rv48_eth', L, PW)} AS rve, {rank_sql('atr_rv', L, PW)} AS arp, {rank_sql('pct_ratio', L, PW)} AS prp, {rank_sql('adist', L, PW)} AS adp, {rank_sql('ader', L, PW)} AS aep, {rank_sql('volume_eth', L, PW)} AS vole,
 {rank_sql('vwap_z', L, PW)} AS zp, {rank_sql('dist_to_vwap48_z_eth', L, PW)} AS dze, {q('r4b', .8, DAY, 12)} AS r4bq, {q('r4e', .8, DAY, 12)} AS r4eq, coalesce(CASE WHEN {over('count(*)', 23, 'CURRENT ROW')} >= 24 THEN {over('corr(zb, ze)', 23, 'CURRENT ROW')} END, 0) AS cor,
 {rank_sql('funding_rate_btc', D, PW)} AS f, {rank_sql('fsp', D, PW)} AS fspp, {rank_sql('oi', D, PW)} AS oip, {rank_sql('llb', D, PW)} AS ll, {rank_sql('slb', D, PW)} AS sls, {rank_sql('tlb', D, PW)} AS tl, {rank_sql('lle', D, PW)} AS lleth, {rank_sql('sle', D, PW)} AS sleth,
 CASE WHEN tlb > 0 THEN llb/tlb END AS imb, {q('ov', .8, DAY, 12)} AS ovq, {win('quantile_cont', 'rng', 20, PW, extra=', 0.5')} AS mr20, {win('quantile_cont', 'volume_btc', 20, PW, extra=', 0.5')} AS mv20,
 {win('avg', 'spr', 96, PW)} AS sprm, nullif({win('stddev_pop', 'spr', 96, PW)}, 0) AS sprs FROM w1)"""

_S, _B, _SP = "eth_slope_sign_1h", "btc_slope_sign_1h", "spread_pct"
_NZ = NE(_S, "0")
_COND = {  # conditions that later steps look back on
    "flip": f"{NE(_S, 's1')} AND {_NZ}", "neutral": Y(f"{_SP} >= .1", f"{_SP} < .9"), "she": Y("ape >= .95"), "shb": Y("ret1_abs_btc_pct >= .9"),
    "up": Y("close_btc > ph"), "dn": Y("close_btc < pl"), "hr4b": Y("r4b > r4bq"), "hr4e": Y("r4e > r4eq"), "tight": Y("tr_btc <= tr_btc_q25"), "narrow": Y("tr_btc <= tq10"), "rvlow": Y("rv48_pct_btc < .2"),
    "flow": Y("f <= .1"), "fhigh": Y("f >= .85"), "fpos": Y("fs > 0"), "fagree": f"{Y(f'{_S} = fs')} AND {_NZ} AND {NE('fs', '0')}", "fgap": Y("fspp >= .8"), "ovhi": Y("ov > ovq"),
    "l80": Y("ll >= .8"), "l90": Y("ll >= .9"), "l95": Y("ll >= .95"), "p80": Y("sls >= .8"), "p90": Y("sls >= .9"), "le90": Y("lleth >= .9"), "se90": Y("sleth >= .9"), "bothl": Y("ll >= .9", "lleth >= .7"),
    "imb80": Y("imb >= .8"), "longdom": Y("tl >= .7", "imb >= .65"), "shortdom": Y("tl >= .7", "imb <= .35"),
}
_ONSET = ["neutral", "hr4b", "hr4e", "flow", "fagree", "fgap", "ovhi", "l80", "l90", "l95", "p80", "p90", "le90", "se90", "bothl", "imb80", "longdom", "shortdom"]
_ALL = lambda c, n: f"({over('count(*)', n - 1, 'CURRENT ROW')} >= {n} AND {over(f'min({c}::INT)', n - 1, 'CURRENT ROW')} = 1)"
_SOME = lambda c, a, b="1 PRECEDING": f"coalesce({over(f'max({c}::INT)', a, b)} = 1, false)"
_STEPS = f"""k1 AS (SELECT *, row_number() OVER ({PW}) - 1 AS n, make_timestamp(ts*1000000) AS d, {lag(_S)} AS s1, {lag(_S, 2)} AS s2, {lag(_B)} AS b1, CASE WHEN {_SP} < .1 THEN -1 WHEN {_SP} >= .9 THEN 1 ELSE 0 END AS reg,
 sign(close_btc - open_btc)::DOUBLE AS bd, sign(close_eth - open_eth)::DOUBLE AS bde, sign(dist_to_vwap48_btc)::DOUBLE AS sd, sign(dist_to_vwap48_eth)::DOUBLE AS sde, sign(ret1_btc)::DOUBLE AS dib, sign(ret1_eth)::DOUBLE AS die, abs(dist_to_vwap48_z_btc) AS adz,
 (spr - sprm)/sprs AS sz, CASE WHEN {over('count(cor)', D - 1, 'CURRENT ROW')} >= 36 THEN {over('quantile_cont(cor, 0.2)', D - 1, 'CURRENT ROW')} END AS corq,
 {", ".join(f"CASE WHEN {over('count(*)', m, '1 PRECEDING')} >= {m} THEN {over(e, m, '1 PRECEDING')} END AS {a}" for a, e, m in (("ph", "max(high_btc)", 12), ("pl", "min(low_btc)", 12), ("h24", "max(high_btc)", 24), ("l24", "min(low_btc)", 24), ("c12", "max(close_btc)", 12)))} FROM w2),
k2 AS (SELECT *, {lag('reg')} AS r1, {lag('bd')} AS bd1, {lag('bd', 2)} AS bd2, {lag('ph')} AS ph1, {lag('ph', 2)} AS ph2, {lag('pl')} AS pl1, {lag('pl', 2)} AS pl2, {lag('adz')} AS adz1, {lag('sd')} AS sd1, {lag('atr14_btc')} AS a1, {lag('atr14_btc', 2)} AS a2, {lag('atr14_btc', 3)} AS a3,
 {lag('oi', 12)} AS o12, {lag('oi', 24)} AS o24, {lag('oi', 36)} AS o36, coalesce({lag('dv')}, 0) AS dv1, {", ".join(f"({e}) AS {n}" for n, e in _COND.items())} FROM k1),
k3 AS (SELECT *, {", ".join(f"({n} AND NOT coalesce({lag(n)}, false)) AS on_{n}" for n in _ONSET)}, coalesce({lag('up')}, false) AS up1, coalesce({lag('up', 2)}, false) AS up2, coalesce({lag('dn')}, false) AS dn1, coalesce({lag('dn', 2)}, false) AS dn2,
 (coalesce({lag('shb')}, false) AND NOT shb) AS shend, {_SOME('she', 6)} AS aftere, {_SOME('flip', 3)} AS rflip, coalesce({lag('narrow')}, false) AS narrow1, coalesce({over('sum(tight::INT)', 5, '1 PRECEDING')} = 5, false) AS tight5,
 {_ALL('rvlow', 48)} AS rvlow48, {_ALL('fhigh', 36)} AS fhigh36, {_ALL('fpos', 72)} AS fpos72, coalesce(fs <> {lag('fs')}, true) AND coalesce(fs <> 0, true) AS fflip FROM k2),
k4 AS MATERIALIZED (SELECT *, {_SOME('shend', 3, 'CURRENT ROW')} AS afters, (fpos72 AND NOT coalesce({lag('fpos72')}, false)) AS on_fpos72 FROM k3)"""


def _signals() -> dict[str, tuple]:
    """name -> (mask, direction[, gap per row]) over k4."""
    reg = lambda n: Y(f"hmm_regime = '{n}'")
    T, G, V = reg("TRENDING"), reg("RANGING"), reg("VOLATILE")
    hours = lambda *h: ANY(*[f"(hour(d) >= {a} AND hour(d) < {b})" for a, b in h])
    agree = f"{Y(f'{_B} = {_S}')} AND {_NZ}"
    ap, vol, z, rv, at, er = "ret1_abs_btc_pct", "volume_btc_pct", "vwap_z", "rv48_pct_btc", "atr14_pct_btc", "er20_btc"
    sap, slz = "eth_slope_abs_pct_1h", "eth_slope_z_1h"
    moved = f"({Y('reg <> r1')} AND r1 IS NOT NULL)"
    enter, leave = f"({moved} AND r1 = 0 AND reg <> 0)", f"({moved} AND r1 <> 0 AND reg = 0)"
    two = lambda hi, lo: (ANY(hi, lo), f"CASE WHEN {hi} THEN 1 WHEN {lo} THEN -1 END")
    bull, bear, dnf = f"({NE(_S, 's1')} AND {Y(f'{_S} = 1')})", f"({NE(_S, 's1')} AND {Y(f'{_S} = -1')})", Y(f"{_S} = -1", "s1 = 1")
    b15 = f"({Y(f'{z} <= -2')} AND {Y('eth_above_ema20_1h')} AND {Y(f'{_S} > 0')})"
    es, bs = Y("ar_eth >= qe90"), Y("ar_btc >= ret1_abs_btc_q90")
    strong, med = f"({Y(f'abs({slz}) >= 1.25')} AND {_NZ})", f"({Y(f'abs({slz}) >= .9', f'abs({slz}) < 1.25')} AND {_NZ})"
    fh1, fl1 = f"(up1 AND {Y('close_btc <= ph1')})", f"(dn1 AND {Y('close_btc >= pl1')})"
    fh2, fl2 = f"(up2 AND {Y('close_btc <= ph2')})", f"(dn2 AND {Y('close_btc >= pl2')})"
    sdnz = NE("sd", "0")
    gate = Y(f"{er} >= .45", f"{rv} >= .35", f"{rv} < .85", "adz < 2.2")
    cool = Y("f < .85")
    dec = Y("cor < corq")
    fast = Y("oi - o12 > o12 - o24")
    out = {
        "slope_afternoon": (f"{hours((12, 20))} AND {Y('eth_slope_stable_2_1h')} AND {_NZ}", _S),
        "regime_moves_12": (f"{moved} AND {_NZ}", _S, 12), "regime_moves_10": (f"{moved} AND {_NZ}", _S, 10),
        "slope_mid_vol": (f"{Y('ar_btc >= q40', 'ar_btc < q80')} AND {_NZ}", _S),
        "slope_z_one": two(Y(f"{slz} >= 1"), Y(f"{slz} <= -1")),
        "strong_slope_calm": (f"{agree} AND {Y('eth_slope_abs_1h >= eth_slope_abs_q70_1h', 'ar_btc >= q30', 'ar_btc < q70')}", _S, 18),
        "slope_confirmed": two(Y(f"{sap} >= .5", f"{_S} = 1", "s1 = 1", "s2 = 1"), Y(f"{sap} >= .5", f"{_S} = -1")),
        "slope_no_shock": (f"{Y(f'{ap} >= .25', f'{ap} < .75')} AND NOT she AND NOT aftere AND {_NZ}", _S),
        "slope_sessions": (f"isodow(d) <= 5 AND {hours((7, 11), (13, 17))} AND {agree}", _S),
        "slope_two_tier": (ANY(strong, med), _S, f"CASE WHEN {strong} THEN 6 ELSE 24 END"),
        "tail_fade_return": (f"{ANY(enter, leave)} AND {_NZ}", f"CASE WHEN {enter} THEN -{_S} WHEN {leave} THEN {_S} END", 14),
        "spread_slope": (*two(Y(f"{_SP} >= .1", f"{_S} > 0", f"{sap} >= .6"), Y(f"{_SP} < .1", f"{_S} < 0", f"{sap} >= .6")), 8),
        "slope_after_shock": (f"{Y(f'{ap} >= .2', f'{ap} < .9')} AND NOT afters AND {_NZ}", _S),
        "fresh_flip_hours": (f"{hours((6, 8), (12, 14))} AND rflip AND {agree}", _S),
        "best_two_a_day": ("best2", _S),
        "spread_tails": two(Y(f"{_SP} < .1"), Y(f"{_SP} >= .9")), "spread_turns_neutral": ("on_neutral", "1"),
        "legs_disagree_lead": (f"{NE(_S, _B)} AND {_NZ} AND {NE(_B, '0')}", _S), "slope_neutral": (f"neutral AND {_NZ}", _S),
        "slope_long_tail": (f"{Y(f'{_SP} >= .9')} AND {_NZ}", _S), "flip_lead": ("flip", _S), "legs_agree": (f"{Y(f'{_B} = {_S}')} AND {NE(_B, '0')}", _B),
        "legs_disagree_base": (f"{NE(_B, _S)} AND {NE(_B, '0')} AND {_NZ}", f"-{_B}"), "flip_base": (f"{NE(_B, 'b1')} AND {NE(_B, '0')}", _B),
        "spread_stretched": (Y(f"{_SP} >= .7", "zp <= .3"), "1"), "spread_stretched_tight": (Y(f"{_SP} >= .85", "zp <= .15"), "1"),
        "ranging_vol_spread": (f"{Y(f'{at} >= .7', f'{_SP} >= .7')} AND {G}", "1"), "vol_low_spread": (Y(f"{rv} >= .7", f"{_SP} <= .3"), "-1"),
        "flip_below_vwap": (f"flip AND {Y('dist_to_vwap48_z_btc < 0')}", _S),
        "wide_heavy_bar": (Y("rng > mr20*1.8", "volume_btc > mv20*1.8"), "bd"), "base_shock": (bs, "dib"), "base_shock_fade": (bs, "-dib"), "lead_shock": (es, "die"),
        "lead_shock_alone": (f"{es} AND NOT {bs}", "die"), "both_shock": (f"{es} AND {bs} AND {Y('die = dib')} AND {NE('die', '0')}", "die"),
        "wide_base": (Y("tr_btc >= tq90"), "bd"), "after_narrow": ("narrow1", "bd"), "expansion": (f"tight5 AND {Y('tr_btc > tr_btc_q25')}", "bd"), "wide_lead": (Y("tr_eth >= teq90"), "bde"),
        "failed_break_2": (ANY(fh1, fh2, fl1, fl2), f"CASE WHEN {ANY(fh1, fh2)} THEN -1 ELSE 1 END"), "failed_break_1": (ANY(fh1, fl1), f"CASE WHEN {fh1} THEN -1 ELSE 1 END"),
        "range_break": two("up", "dn"), "three_bars": two(Y("bd = 1", "bd1 = 1", "bd2 = 1"), Y("bd = -1", "bd1 = -1", "bd2 = -1")),
        "filtered_break": two(f"({gate} AND {Y('close_btc > h24')})", f"({gate} AND {Y('close_btc < l24')})"),
        "dip_confirmed": (b15, "1"), "dip_shock": (f"{b15} AND {es}", "1"), "dip_shock_neutral": (f"{b15} AND {es} AND neutral", "1"), "dip_neutral": (f"{b15} AND neutral", "1"),
        "dip_mid": (f"{b15} AND {Y(f'{_SP} >= .25', f'{_SP} < .75')}", "1"), "low_z_neutral": (f"{Y(f'{z} <= -2')} AND neutral", "1"), "high_z_neutral": (f"{Y(f'{z} >= 2')} AND neutral", "-1"),
        "far_z_fade": (Y(f"abs({z}) >= 3"), f"-sign({z})"), "z_fade_trending": (f"{ANY(Y('zp <= .3'), Y('zp >= .7'))} AND {T}", "CASE WHEN zp >= .7 THEN -1 ELSE 1 END"),
        "z_follow_ranging": (f"{ANY(Y('zp <= .3'), Y('zp >= .7'))} AND {G}", "CASE WHEN zp <= .3 THEN -1 ELSE 1 END"), "low_z": (Y(f"{z} <= -2"), "1"), "high_z": (Y(f"{z} >= 2"), "-1"),
        "base_4h_stretch": ("on_hr4b", "-1"), "lead_4h_stretch": ("on_hr4e", "-1"), "z_high_trending": (f"{Y('zp >= .7')} AND {T}", "1"), "lead_dist_trending": (f"{Y('dze >= .7')} AND {T}", "1"),
        "vol_band": (f"{Y(f'{at} >= .65', f'{at} < .9', f'{rv} >= .4', f'{rv} < .8')} AND {sdnz}", "sd"),
        "compressed_break": (f"{Y(f'{at} < .3', f'{rv} < .35', 'adz > 1.2', 'adz1 <= 1.2')} AND {sdnz}", "sd"),
        "shock_decay": (f"{Y(f'{rv} >= .9', 'atr14_btc - a1 < 0', 'a1 - a2 < 0', 'a2 - a3 < 0', 'sd = sd1')} AND {sdnz}", "-sd"),
        "ratio_band": (f"{Y('arp >= .45', 'arp < .7', 'adp >= .5', 'adp < .85')} AND {sdnz}", "sd"),
        "ratio_band_param": (f"{Y(f'{rv} >= .3', f'{rv} < .75', 'prp >= .6', 'prp < .9', 'adz >= .8', 'adz < 2')} AND {sdnz}", "sd"),
        "rv_trending": (f"{Y(f'{rv} >= .7')} AND {T}", "1"), "lead_atr_trending": (f"{Y('ate >= .7')} AND {T}", "1"), "atr_ranging": (f"{Y(f'{at} >= .7')} AND {G}", "1"),
        "lead_dist_volatile": (f"{Y('dze >= .7', f'{rv} >= .7')} AND {V}", "-1"),
        "choppy_fade": (f"{Y(f'{er} <= .25', 'adz >= 1.5', f'{rv} < .85')} AND {sdnz}", "-sd"), "efficient_follow": (f"{Y(f'{er} >= .6', 'adz >= .6', 'adz < 1.8', f'{at} >= .35', f'{at} < .85')} AND {sdnz}", "sd"),
        "efficiency_switch": (f"{Y('adz >= .9', f'{rv} < .92')} AND {sdnz}", f"CASE WHEN {Y(f'{er} < .4')} THEN -sd ELSE sd END"),
        "efficiency_gap": (f"{Y('aep >= .85', 'adz >= .7', f'{rv} < .9')} AND {NE('sign(delta_er)', '0')}", "CASE WHEN delta_er > 0 THEN -1 WHEN delta_er < 0 THEN 1 ELSE 0 END"),
        "lead_vol_lead": (f"{Y('ate >= .7', f'{at} < .5', f'{rv} >= .3', f'{rv} < .85')} AND {NE('sde', '0')}", "sde"),
        "opposite_sides": (f"{NE('sd', '0')} AND {NE('sde', '0')} AND {NE('sd', 'sde')} AND {Y('adz >= 1', 'abs(dist_to_vwap48_z_eth) >= 1', f'{er} <= .5', 'er20_eth <= .5')}", "-sd"),
        "spread_z_fade": (f"{ANY(Y('sz >= 2'), Y('sz <= -2'))} AND {Y(f'{rv} >= .25', f'{rv} < .8', 'rve >= .25', 'rve < .8')} AND hour(d) >= 8 AND hour(d) < 22", "CASE WHEN sz >= 2 THEN -1 ELSE 1 END", "H+2"),
        "base_leads_1h": (Y("dv1 <= 0", "dv > .001"), "1"), "flip_decoupled": (f"flip AND {dec}", _S), "bull_flip_decoupled": (f"{bull} AND {dec}", "1"),
        **{f"flip_volume_{t}": (f"flip AND {Y(f'{vol} >= {t / 100}')}", _S) for t in (75, 80, 85)}, "flip_lead_volume": (f"flip AND {Y('vole >= .8')}", _S),
        "break_volume": (Y("close_btc > c12", f"{vol} >= .75"), "1"), "quiet_move_fade": (f"{Y(f'{ap} >= .8', f'{vol} <= .2')} AND {NE('bd', '0')}", "-bd"),
        "flip_up": (f"flip AND {Y(f'{_S} > 0')}", _S), "flip_dn": (f"flip AND {Y(f'{_S} < 0')}", _S), "flip_volume_up": (f"flip AND {Y(f'{vol} >= .8', f'{_S} > 0')}", _S), "flip_volume_dn": (f"flip AND {Y(f'{vol} >= .8', f'{_S} < 0')}", _S),
        "flip_trending": (f"flip AND {T}", _S), "flip_ranging": (f"flip AND {G}", _S), "flip_volatile": (f"flip AND {V}", _S), "flip_volume_trending": (f"flip AND {Y(f'{vol} >= .8')} AND {T}", _S),
        "flip_volume_volatile": (f"flip AND {Y(f'{vol} >= .8')} AND {V}", _S), "flip_compressed": ("flip AND rvlow48", _S),
        "spread_extreme_cool": (f"{ANY(Y(f'{_SP} >= .97', f'{_S} = 1'), Y(f'{_SP} <= .03', f'{_S} = -1'))} AND {cool}", _S), "spread_tail_cool": (f"{ANY(Y(f'{_SP} >= .9', f'{_S} = 1'), Y(f'{_SP} <= .1', f'{_S} = -1'))} AND {cool}", _S),
        "crowded_short_tail": (Y("f >= .9", f"{_SP} < .1"), "-1"), "funding_flip": ("fflip", "fs"), "funding_trending": (f"{Y('f >= .7')} AND {T}", "1"), "funding_volatile": (f"{Y('f >= .7')} AND {V}", "1"),
        "lead_atr_funding_ranging": (f"{Y('ate <= .3', 'f <= .3')} AND {G}", "-1"), "funding_washed": ("on_flow", "1"), "dn_crowded_85": (f"{dnf} AND {Y('f >= .85')}", "-1"), "dn_crowded_80": (f"{dnf} AND {Y('f >= .8')}", "-1"),
        "funding_agrees": ("on_fagree", _S), "dn_crowded_3h": (f"{dnf} AND fhigh36", "-1"), "funding_positive_6h": ("on_fpos72", "-1"), "flip_against_funding": (f"flip AND {NE('fs', _S)} AND {NE('fs', '0')}", _S), "funding_gap": ("on_fgap", "-1"),
        "flip_oi_faster": (f"flip AND {fast}", _S), "bull_oi_faster": (f"{bull} AND {fast}", "1"), "bear_oi_rising": (f"{bear} AND {Y('oi > o12', 'o12 > o24', 'o24 > o36')}", "-1"), "oi_velocity_high": ("on_ovhi", "1"), "flip_oi": (f"flip AND {Y('oip >= .8')}", _S),
        "long_liq_80": ("on_l80", "-1"), "long_liq_90": ("on_l90", "-1"), "long_liq_95": ("on_l95", "-1"), "short_liq_80": ("on_p80", "1"), "short_liq_90": ("on_p90", "1"), "long_liq_bear": (f"on_l90 AND {Y(f'{_S} = -1')}", "-1"),
        "short_liq_bull": (f"on_p90 AND {Y(f'{_S} = 1')}", "1"), "liq_imbalanced": ("on_imb80", "-1"), "long_dominant": ("on_longdom", "-1"), "short_dominant": ("on_shortdom", "1"), "dn_long_liq": (f"{dnf} AND {Y('ll >= .7')}", "-1"),
        "flip_oi_liq": (f"flip AND {Y('oip >= .8', 'tl >= .7')}", _S), "lead_long_liq": ("on_le90", "-1"), "lead_short_liq": ("on_se90", "1"), "both_long_liq": ("on_bothl", "-1"),
    }
    for name, extra in (("flip_volume_liq", ""), ("flip_volume_liq_up", f" AND {Y(f'{_S} > 0')}"), ("flip_volume_liq_dn", f" AND {Y(f'{_S} < 0')}"), ("flip_volume_liq_trending", f" AND {T}")):
        out[name] = (f"flip AND {Y(f'{vol} >= .8', 'tl >= .7')}{extra}", _S)
    return out


def _all_rules_sql() -> str:
    sig, rs = _signals(), RL.rules()
    best = f"{Y(f'{_B} = {_S}', 'eth_slope_abs_pct_1h >= .75', 'ret1_abs_btc_pct >= .3', 'ret1_abs_btc_pct < .85')} AND {_NZ}"
    rows = []
    for r in rs:
        gap = sig[r.signal][2] if len(sig[r.signal]) > 2 else None
        pre = r.horizon + 2 if gap == "H+2" else 24 if isinstance(gap, str) else gap
        x = r.exits
        rows.append(f"('{r.rule_id}', '{r.family}', '{r.signal}', {r.horizon}, {r.offset}, '{r.leg}', {r.parity}, {r.hours[0] if r.hours else 0}, {r.hours[1] if r.hours else 24}, {pre if pre else 'NULL::INT'}, {bool(x)}, "
                    f"{x.get('atr_stop', 0)}, {x.get('tp_bps', 0)}, {x.get('trail_bps', 0)}, {x.get('breakeven_bps', 0)}, '{x.get('watch', '')}', {x.get('watch_min', 0)}, {bool(x.get('slope_exit'))}, {x.get('collapse_below', 0)})")
    each = "\n UNION ALL ".join(
        f"SELECT '{n}' AS sig, pair, n, CAST({s[1]} AS DOUBLE) AS dir, {s[2] if len(s) > 2 and isinstance(s[2], str) and s[2] != 'H+2' else 'NULL::INT'} AS need FROM k5 WHERE {s[0]}" for n, s in sig.items())
    hop = "(SELECT min(c.n) FROM {c} c WHERE c.sig = t.sig AND c.h = t.h AND c.pair = t.pair AND c.n >= t.n + {g})"
    return f"""WITH RECURSIVE {EB()}, {SLOW}, {PAIR()}, {COARSE}, {_f1}, {_WIDE}, {_STEPS},
k5 AS MATERIALIZED (SELECT *, c100 AND row_number() OVER (PARTITION BY pair, ts//86400, c100 ORDER BY eth_slope_abs_pct_1h DESC, n) <= 2 AS best2 FROM (SELECT *, ({best}) AS c100 FROM k4)),
ru(rule_id, family, sig, h, o, leg, parity, h0, h1, pre, early, x_atr, x_tp, x_trail, x_be, x_watch, x_min, x_slope, x_low) AS (VALUES {", ".join(rows)}),
sg AS MATERIALIZED (SELECT * FROM ({each}) WHERE {NE('dir', '0')}),
c1 AS MATERIALIZED (SELECT sg.*, ru.h, coalesce(sg.need, ru.pre) AS g FROM sg JOIN (SELECT DISTINCT sig, h, pre FROM ru WHERE pre IS NOT NULL) ru USING (sig)),
t1 AS (SELECT sig, h, pair, min(n) AS n FROM c1 GROUP BY 1, 2, 3 UNION ALL SELECT t.sig, t.h, t.pair, {hop.format(c='c1', g='c.g')} FROM t1 t WHERE t.n IS NOT NULL),
c2 AS MATERIALIZED (SELECT sg.sig, sg.pair, sg.n, sg.dir, ru.h FROM sg JOIN (SELECT DISTINCT sig, h FROM ru WHERE pre IS NULL) ru USING (sig) UNION ALL SELECT c1.sig, c1.pair, c1.n, c1.dir, c1.h FROM c1 JOIN t1 USING (sig, h, pair, n)),
t2 AS (SELECT sig, h, pair, min(n) AS n FROM c2 GROUP BY 1, 2, 3 UNION ALL SELECT t.sig, t.h, t.pair, {hop.format(c='c2', g='t.h')} FROM t2 t WHERE t.n IS NOT NULL),
px AS MATERIALIZED (SELECT pair, n, d, reg, r1, close_btc, close_eth, atr14_btc, {_S} AS slope, volume_btc_pct, ll, sls, tl FROM k5),
e AS (SELECT ru.*, c2.pair, c2.n, c2.dir, CASE WHEN ru.sig = 'regime_moves_10' AND s.r1 <> 0 AND s.reg = 0 THEN 4 ELSE ru.h END AS hold, s.d, a.slope AS es, a.atr14_btc AS ea,
 CASE ru.leg WHEN 'eth' THEN a.close_eth ELSE a.close_btc END AS ep FROM c2 JOIN t2 USING (sig, h, pair, n) JOIN ru USING (sig, h) JOIN px s ON s.pair = c2.pair AND s.n = c2.n JOIN px a ON a.pair = c2.pair AND a.n = c2.n + ru.o WHERE c2.dir IS NOT NULL),
e2 AS (SELECT e.*, CASE e.leg WHEN 'eth' THEN b.close_eth ELSE b.close_btc END AS tx FROM e JOIN px b ON b.pair = e.pair AND b.n = e.n + e.o + e.hold WHERE (parity < 0 OR day(e.d) % 2 = parity) AND hour(e.d) >= h0 AND hour(e.d) < h1),
pa AS (SELECT e2.*, p.n AS k, p.close_btc AS px, e2.dir*(p.close_btc/ep - 1) AS pnl, p.slope AS ps, CASE x_watch WHEN 'long_liq_btc_pct' THEN p.ll WHEN 'short_liq_btc_pct' THEN p.sls WHEN 'total_liq_btc_pct' THEN p.tl END AS wv, x_low > 0 AND coalesce(p.volume_btc_pct < x_low, false) AS low
 FROM e2 JOIN px p ON p.pair = e2.pair AND p.n > e2.n AND p.n <= e2.n + e2.h WHERE early),
pb_ AS (SELECT *, greatest(ep, max(px) OVER w) AS hi, least(ep, min(px) OVER w) AS lo_, max(pnl) OVER w AS best, coalesce(lag(low) OVER w, false) AS low1 FROM pa WINDOW w AS (PARTITION BY rule_id, pair, n ORDER BY k)),
ex AS (SELECT rule_id, pair, n, arg_min(px, k) AS xx FROM pb_ WHERE (x_atr > 0 AND coalesce(ea, 0) > 0 AND CASE WHEN dir > 0 THEN px <= ep - x_atr*ea ELSE px >= ep + x_atr*ea END) OR (x_tp > 0 AND pnl >= x_tp/10000.0e0)
 OR (x_trail > 0 AND CASE WHEN dir > 0 THEN px <= hi - x_trail/10000.0e0*ep ELSE px >= lo_ + x_trail/10000.0e0*ep END) OR (x_be > 0 AND best >= x_be/10000.0e0 AND CASE WHEN dir > 0 THEN px <= ep ELSE px >= ep END)
 OR (x_min > 0 AND coalesce(wv < x_min, false)) OR (x_slope AND ps IS NOT NULL AND ps <> 0 AND {NE('ps', 'es')}) OR (x_low > 0 AND low AND low1) GROUP BY 1, 2, 3),
ev AS (SELECT e2.rule_id, dir, dir*(coalesce(xx, tx)/ep - 1) AS g FROM e2 LEFT JOIN ex USING (rule_id, pair, n)),
ag AS (SELECT rule_id, count(*) AS n, avg(g) AS mean, sum(dir) AS net_dir FROM ev GROUP BY 1)
SELECT ru.rule_id, ru.family, coalesce(ag.n, 0) AS n, {r6('mean')} AS mean, {r6('net_dir')} AS net_dir FROM ru LEFT JOIN ag USING (rule_id)"""


@query("all_rules_counts", _all_rules_sql())
def _(spark, d):
    ev = EV.build_events(pair(spark, d), CFG, slow(spark, d))
    a = ev.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_r").alias("mean"), F.sum("signal_dir").alias("net_dir"))
    every = spark.createDataFrame([(r.rule_id, r.family) for r in RL.rules()], "rule_id string, family string")
    return every.join(a, "rule_id", "left").na.fill(0, ["n"])
