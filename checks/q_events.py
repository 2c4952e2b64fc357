"""Rules, events, exits and the dedicated event builders."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.scalar import with_cost_modes
from barlab.operators import stats
from barlab.operators.store import stored
from barlab.plans import events as EV
from barlab.plans import frame as FR
from barlab.plans import rules as RL
from barlab.plans import studies as ST

from .fixtures import CFG, pair
from .q_features import ALIGNED, COARSE, FRAME, PW, EB, PAIR
from .registry import R, query, r6, rank_sql, rx

# direction of each rule as SQL over the frame row (n = row number); null directions follow the rule that
# a comparison with null is false except "not equal"
NE = lambda a, b: f"coalesce({a} <> {b}, true)"
Y = lambda c: f"coalesce({c}, false)"
_S, _B = "eth_slope_sign_1h", "btc_slope_sign_1h"
_FLIP = f"{NE(_S, 's1')} AND {NE(_S, '0')}"
_FLIPB = f"{NE(_B, 'b1')} AND {NE(_B, '0')}"
_SD = "sign(dist_to_vwap48_btc)::DOUBLE"
_MOVED = "reg <> r1 AND r1 IS NOT NULL"
RULE_SQL: dict[int, tuple[str, str, int, int]] = {  # number -> (mask, direction, horizon, gap)
    39: (_FLIP, _S, 6, 6), 60: (_FLIP, _S, 6, 6), 61: (_FLIP, _S, 6, 6), 70: (_FLIP, _S, 8, 8), 83: (_FLIP, _S, 8, 8),
    59: (_FLIPB, _B, 6, 6), 62: (_FLIPB, _B, 4, 4), 63: (_FLIPB, _B, 8, 8), 68: (_FLIPB, _B, 8, 8), 69: (_FLIPB, _B, 8, 8), 80: (_FLIPB, _B, 8, 8), 76: (_FLIPB, _B, 8, 8),
    40: (f"{Y(_B + '=' + _S)} AND {NE(_B, '0')}", _B, 6, 6), 41: (f"{NE(_B, _S)} AND {NE(_B, '0')} AND {NE(_S, '0')}", f"-{_B}", 6, 6),
    30: (f"{NE(_B, _S)} AND {NE(_B, '0')} AND {NE(_S, '0')}", _S, 6, 6),
    19: (f"{Y('spread_pct < .1')} OR {Y('spread_pct >= .9')}", "CASE WHEN spread_pct < .1 THEN 1 ELSE -1 END", 6, 6),
    29: (f"neutral AND NOT coalesce(lag(neutral) OVER ({PW}), false)", "1", 6, 6),
    37: (f"neutral AND {NE(_S, '0')}", _S, 6, 6), 38: (f"{Y('spread_pct >= .9')} AND {NE(_S, '0')}", _S, 6, 6),
    42: (Y("ar_btc >= ret1_abs_btc_q90"), "sign(ret1_btc)::DOUBLE", 6, 6), 43: (Y("ar_btc >= ret1_abs_btc_q90"), "-sign(ret1_btc)::DOUBLE", 6, 6),
    51: (f"{Y('vwap_z <= -2')} AND neutral", "1", 6, 6), 235: (Y("vwap_z <= -2"), "1", 6, 6), 236: (Y("vwap_z >= 2"), "-1", 6, 6),
    53: (Y("abs(vwap_z) >= 3"), "-sign(vwap_z)::DOUBLE", 6, 6), 54: (f"{Y('close_btc > ph')} OR {Y('close_btc < pl')}", "CASE WHEN close_btc > ph THEN 1 ELSE -1 END", 6, 6),
    56: (f"{Y('bd = 1 AND bd1 = 1 AND bd2 = 1')} OR {Y('bd = -1 AND bd1 = -1 AND bd2 = -1')}", "bd", 6, 6),
    101: (f"{Y('atr14_pct_btc >= .65 AND atr14_pct_btc < .9 AND rv48_pct_btc >= .4 AND rv48_pct_btc < .8')} AND {NE(_SD, '0')}", _SD, 8, 8),
    105: (f"{Y('er20_btc <= .25 AND abs(dist_to_vwap48_z_btc) >= 1.5 AND rv48_pct_btc < .85')} AND {NE(_SD, '0')}", f"-{_SD}", 8, 8),
    107: (f"{Y('abs(dist_to_vwap48_z_btc) >= .9 AND rv48_pct_btc < .92')} AND {NE(_SD, '0')}", f"CASE WHEN coalesce(er20_btc < .4, false) THEN -{_SD} ELSE {_SD} END", 8, 8),
    145: (f"{_FLIP} AND {Y('volume_btc_pct >= .8')}", _S, 8, 8), 147: (f"{Y('ret1_abs_btc_pct >= .8 AND volume_btc_pct <= .2')} AND {NE('bd', '0')}", "-bd", 6, 6),
    215: (f"{_FLIP} AND {Y(_S + ' > 0')}", _S, 8, 8), 216: (f"{_FLIP} AND {Y(_S + ' < 0')}", _S, 8, 8),
    242: (f"{_FLIP} AND {Y('dist_to_vwap48_z_btc < 0')}", _S, 8, 8),
    87: (f"{_MOVED} AND {NE(_S, '0')}", _S, 6, 12), 91: (f"{_MOVED} AND {NE(_S, '0')}", _S, 8, 10),
    96: (f"(({_MOVED} AND r1 = 0 AND reg <> 0) OR ({_MOVED} AND r1 <> 0 AND reg = 0)) AND {NE(_S, '0')}", f"CASE WHEN r1 = 0 THEN -{_S} ELSE {_S} END", 6, 14),
}
_LEAD, _LAG1 = {60, 70, 83}, {61, 76}
_POST = {68: "day(d) % 2 = 1", 70: "day(d) % 2 = 1", 69: "day(d) % 2 = 0", 80: "hour(d) < 8", 83: "hour(d) < 8"}

ROWS = f"""q0 AS (SELECT *, row_number() OVER ({PW}) - 1 AS n, lag({_S}) OVER ({PW}) AS s1, lag({_B}) OVER ({PW}) AS b1, CASE WHEN spread_pct < .1 THEN -1 WHEN spread_pct >= .9 THEN 1 ELSE 0 END AS reg,
 coalesce(spread_pct >= .1 AND spread_pct < .9, false) AS neutral, sign(close_btc - open_btc)::DOUBLE AS bd,
 CASE WHEN count(*) OVER p >= 12 THEN max(high_btc) OVER p END AS ph, CASE WHEN count(*) OVER p >= 12 THEN min(low_btc) OVER p END AS pl FROM f4 WINDOW p AS ({PW} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
q1 AS (SELECT *, lag(reg) OVER ({PW}) AS r1, lag(bd) OVER ({PW}) AS bd1, lag(bd,2) OVER ({PW}) AS bd2 FROM q0)"""


def _events_sql(numbers) -> str:
    sig = "\n UNION ALL ".join(f"SELECT {k} AS r, pair, n, ts, CAST({RULE_SQL[k][1]} AS DOUBLE) AS dir, {RULE_SQL[k][2]} AS h, {RULE_SQL[k][3]} AS gap, {int(k in _LAG1)} AS o, reg, r1, ({RULE_SQL[k][0]}) AS hit FROM q1" for k in numbers)
    px = "CASE WHEN e.r IN (60,70,83) THEN {0}.close_eth ELSE {0}.close_btc END"
    post = " AND ".join(f"(r <> {k} OR {c})" for k, c in _POST.items())
    return f"""sg AS MATERIALIZED (SELECT * FROM ({sig}) WHERE hit AND {NE('dir', '0')}),
th AS (SELECT r, pair, gap, min(n) AS n FROM sg GROUP BY 1, 2, 3 UNION ALL SELECT th.r, th.pair, th.gap, (SELECT min(sg.n) FROM sg WHERE sg.r = th.r AND sg.pair = th.pair AND sg.n >= th.n + th.gap) FROM th WHERE th.n IS NOT NULL),
e AS (SELECT sg.*, CASE WHEN sg.r = 91 AND r1 <> 0 AND reg = 0 THEN 4 ELSE h END AS hold FROM sg JOIN th ON th.r = sg.r AND th.pair = sg.pair AND th.n = sg.n),
ev AS (SELECT 'H' || e.r AS rule_id, e.r, e.pair, e.n, e.ts, make_timestamp(e.ts*1000000) AS d, e.dir AS signal_dir, {px.format('a')} AS entry_px, {px.format('b')} AS exit_px, hold, o FROM e JOIN q1 a ON a.pair = e.pair AND a.n = e.n + e.o JOIN q1 b ON b.pair = e.pair AND b.n = e.n + e.o + e.hold WHERE e.dir IS NOT NULL),
evf AS (SELECT *, signal_dir*(exit_px/entry_px - 1) AS gross_r FROM ev WHERE {post})"""


@query("flagship_flip_baseline", f"""WITH RECURSIVE {FRAME}, {ROWS}, {_events_sql([39])}
SELECT rule_id, mode, count(*) AS n, {rx(win_rate='avg((gross_r - c > 0)::INT)', mean='avg(gross_r - c)', std='stddev_pop(gross_r - c)')} FROM evf CROSS JOIN (VALUES ('gross', 0.0), ('bps8', 0.0008), ('bps10', 0.0010)) m(mode, c) GROUP BY 1, 2""")
def _(spark, d):
    ev = EV.build_events(pair(spark, d), CFG, numbers=[39])
    return stats.baseline(with_cost_modes(ev), ["rule_id", "mode"])


@query("rule_events", f"""WITH RECURSIVE {FRAME}, {ROWS}, {_events_sql(list(RULE_SQL))}
SELECT pair, rule_id, ts, {R('signal_dir','entry_px','exit_px','gross_r')}, {r6("(SELECT min((CASE WHEN evf.r IN (60,70,83) THEN p.close_eth ELSE p.close_btc END/entry_px - 1)*signal_dir) FROM q1 p WHERE p.pair = evf.pair AND p.n > evf.n + evf.o AND p.n <= evf.n + evf.o + evf.hold)")} AS mae_proxy FROM evf""")
def _(spark, d):
    ev = EV.build_events(pair(spark, d), CFG, numbers=list(RULE_SQL))
    return ev.select("pair", "rule_id", "ts", "signal_dir", "entry_px", "exit_px", "gross_r", "mae_proxy")


_EXIT = {198: "k.atr_hit", 199: "k.pnl >= 0.0025", 200: "k.trail15", 201: "k.atr_hit OR k.pnl >= 0.0025", 211: "k.be15", 214: "k.low AND k.low1"}


def _exits_sql() -> str:
    base = _events_sql([39]).replace("39 AS r", "198 AS r").replace("6 AS h, 6 AS gap", "8 AS h, 8 AS gap")
    path = """pa AS (SELECT evf.pair, evf.n AS en, evf.ts, evf.signal_dir AS dir, evf.entry_px AS ep, evf.exit_px AS tx, a.atr14_btc AS atr, p.n - evf.n AS k, p.close_btc AS px, coalesce(p.volume_btc_pct < 0.3, false) AS low FROM evf JOIN q1 a ON a.pair = evf.pair AND a.n = evf.n JOIN q1 p ON p.pair = evf.pair AND p.n > evf.n AND p.n <= evf.n + 8),
pb2 AS (SELECT *, dir*(px/ep-1) AS pnl, greatest(ep, max(px) OVER w) AS hi, least(ep, min(px) OVER w) AS lo_, k > 1 AND coalesce(lag(low) OVER w, false) AS low1, max(dir*(px/ep-1)) OVER w AS best FROM pa WINDOW w AS (PARTITION BY pair, en ORDER BY k)),
pk AS (SELECT *, coalesce(atr, 0) > 0 AND CASE WHEN dir > 0 THEN px <= ep - 1.5*atr ELSE px >= ep + 1.5*atr END AS atr_hit, CASE WHEN dir > 0 THEN px <= hi - 0.0015*ep ELSE px >= lo_ + 0.0015*ep END AS trail15,
  best >= 0.0015 AND CASE WHEN dir > 0 THEN px <= ep ELSE px >= ep END AS be15 FROM pb2)"""
    sel = " UNION ALL ".join(f"SELECT 'H{r}' AS rule_id, pair, en, ts, ep, dir, coalesce(arg_min(k.px, k.k) FILTER ({c}), max(tx)) AS exit_px FROM pk k GROUP BY pair, en, ts, ep, dir" for r, c in _EXIT.items())
    return f"WITH RECURSIVE {FRAME}, {ROWS}, {base}, {path} SELECT pair, rule_id, ts, {rx(exit_px='exit_px', gross_r='dir*(exit_px/ep-1)')} FROM ({sel})"


@query("rule_exits", _exits_sql())
def _(spark, d):
    return EV.build_events(pair(spark, d), CFG, numbers=list(_EXIT)).select("pair", "rule_id", "ts", "exit_px", "gross_r")


_PN = f"{EB()}, {PAIR()}, x AS (SELECT *, row_number() OVER ({PW}) - 1 AS n FROM pb)"


@query("long_hold_events", f"""WITH {_PN}, h AS (SELECT unnest([8, 300, 400, 600]) AS h)
SELECT a.pair, 'H' || (900 + h) AS rule_id, a.ts, {rx(exit_px='b.close_btc', gross_r='b.close_btc/a.close_btc - 1')} FROM x a CROSS JOIN h JOIN x b ON b.pair = a.pair AND b.n = a.n + h
WHERE a.n % greatest(50, h // 50 * 50) = 0""")
def _(spark, d):
    """Holding periods longer than a block of the frame."""
    every = RL.Signal(F.col("idx") % 50 == 0, F.lit(1.0))
    own = [RL.Rule(900 + h, "own", "every", horizon=h) for h in (8, 300, 400, 600)]
    ev = EV.build_events(pair(spark, d), CFG.small(block=64), numbers=[], extra={"every": every}, extra_rules=own)
    return ev.select("pair", "rule_id", "ts", "exit_px", "gross_r")


@query("lead_leg_exits", f"""WITH {_PN}, e AS (SELECT s.pair, s.ts, s.n, CASE WHEN s.n % 40 = 0 THEN 1.0 ELSE -1.0 END AS dir, a.close_eth AS ep, b.close_eth AS tx FROM x s JOIN x a ON a.pair = s.pair AND a.n = s.n + 1 JOIN x b ON b.pair = s.pair AND b.n = s.n + 13 WHERE s.n % 20 = 0),
k AS (SELECT e.pair, e.n, arg_min(p.close_eth, p.n) AS px FROM e JOIN x p ON p.pair = e.pair AND p.n > e.n + 1 AND p.n <= e.n + 13 WHERE e.dir*(p.close_eth/e.ep - 1) >= 0.01 GROUP BY 1, 2)
SELECT e.pair, e.ts, {rx(exit_px='coalesce(k.px, e.tx)', gross_r='e.dir*(coalesce(k.px, e.tx)/e.ep - 1)')} FROM e LEFT JOIN k USING (pair, n)""")
def _(spark, d):
    """An exit on the lead leg, entered a bar late: the path starts at the entry bar of the traded leg."""
    turn = RL.Signal(F.col("idx") % 20 == 0, F.when(F.col("idx") % 40 == 0, 1.0).otherwise(-1.0))
    own = [RL.Rule(950, "own", "turn", horizon=12, offset=1, leg="eth", exits=dict(tp_bps=100))]
    ev = EV.build_events(pair(spark, d), CFG, numbers=[], extra={"turn": turn}, extra_rules=own)
    return ev.select("pair", "ts", "exit_px", "gross_r")


@query("tail_slope_events", f"""WITH RECURSIVE {EB()}, {PAIR()}, {COARSE}, x AS (SELECT pb.pair, pb.ts, pb.close_btc, h4.spread_pct, h4.eth_slope_sign_1h AS s, row_number() OVER (PARTITION BY pb.pair ORDER BY pb.ts) AS n FROM pb JOIN h4 ON h4.pair = pb.pair AND h4.ts = pb.ts//14400*14400),
c AS (SELECT * FROM x WHERE coalesce(spread_pct < 0.1, false) AND {NE('s', '0')}), t AS (SELECT pair, min(n) AS n FROM c GROUP BY 1 UNION ALL SELECT t.pair, (SELECT min(c.n) FROM c WHERE c.pair = t.pair AND c.n >= t.n + 6) FROM t WHERE t.n IS NOT NULL)
SELECT c.pair, c.ts, {rx(signal_dir='c.s', fwd_r='z.close_btc/c.close_btc-1', gross_r='c.s*(z.close_btc/c.close_btc-1)')} FROM t JOIN c ON c.pair = t.pair AND c.n = t.n JOIN x z ON z.pair = c.pair AND z.n = c.n + 6 WHERE c.s IS NOT NULL""")
def _(spark, d):
    x = stored(FR.aligned(stored(pair(spark, d)), CFG).drop("idx"))
    return ST.tail_slope_events(x, 6)
