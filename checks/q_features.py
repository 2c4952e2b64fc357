"""Window operators, the pair frame and its feature blocks."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import windows as W
from barlab.functions.nulls import eq, ge, gt, le, lt, ne, sign
from barlab.functions.scalar import day_of
from barlab.operators.blocks import in_blocks
from barlab.operators.prefix import Run, drawdown, max_streak, run_length, running
from barlab.operators.rolling import Roll, back_rows, long_rolling
from barlab.operators.store import stored
from barlab.operators.thin import thin
from barlab.plans import features as feat
from barlab.plans import frame as FR
from barlab.sources import derive, readers

from .fixtures import CFG, DB, EB, PAIR, SLOW, pair, slow
from .registry import R, query, rank_sql, rx, win

SPAN = 86400 * 200
W1 = "PARTITION BY symbol ORDER BY ts"
SYM = ["symbol"]


def _daily(spark, d):
    return stored(derive.daily_bars(spark, d))


def _blocks(df, build, back=100, forward=0, keys=SYM):
    return in_blocks(df, keys, build, back=back, forward=forward, span=SPAN, block=512)


@query("lags_returns_ranges", f"""WITH {DB}, a AS (SELECT *, lag(close) OVER w AS pc, lag(close,20) OVER w AS c20, lag(close,3) OVER w AS c3, lead(close,6) OVER w AS f6, lead(close,1) OVER w AS f1, lead(close,7) OVER w AS f7 FROM db WINDOW w AS ({W1})),
b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr0, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr1, abs(close-pc) AS st, close/pc-1 AS r1, ln(close/pc) AS lr FROM a)
SELECT symbol, ts, {rx(r1='r1', lr='lr', d3='close-c3', fwd='f6/close-1', fwd_lag='f7/f1-1', tr_null='tr0', tr_range='tr1',
 atr14=win('avg','tr0',14,W1), rv_pop=win('stddev_pop','r1',48,W1), rv_samp=win('stddev_samp','lr',48,W1), er20='abs(close-c20)/nullif('+win('sum','st',20,W1)+',0)',
 vwap48=win('sum','close*volume',48,W1)+'/nullif('+win('sum','volume',48,W1)+',0)')} FROM b""")
def _(spark, d):
    def build(x, w):
        c, h, l, v = (F.col(k) for k in ("close", "high", "low", "volume"))
        pc = W.lag(c, w)
        x = x.withColumns({"r1": W.ret(c, w), "lr": W.log_ret(c, w), "tr_null": W.true_range(h, l, pc), "tr_range": W.true_range(h, l, pc, "range"), "st": F.abs(c - pc)})
        return x.withColumns({"d3": W.diff(c, w, 3), "fwd": W.forward_return(c, w, 6), "fwd_lag": W.forward_return(c, w, 6, 1),
                              "atr14": W.mean(F.col("tr_null"), w, 14), "rv_pop": W.std(F.col("r1"), w, 48), "rv_samp": W.std(F.col("lr"), w, 48, ddof=1),
                              "er20": W.efficiency_ratio(F.abs(W.diff(c, w, 20)), F.col("st"), w, 20), "vwap48": W.vwap(c * v, v, w, 48)})
    x = _blocks(_daily(spark, d), build, forward=8)
    return x.drop("open", "high", "low", "close", "volume", "st")


@query("rolling_ranks_quantiles", f"""WITH {DB}, a AS (SELECT *, abs(close/lag(close) OVER ({W1})-1) AS ar FROM db)
SELECT symbol, ts, {rx(rank40=rank_sql('ar',40,W1), rank_mp=rank_sql('ar',60,W1,20), q90=win('quantile_cont','ar',96,W1,extra=', 0.9'), q10_mp=win('quantile_cont','ar',96,W1,need=30,extra=', 0.1'), med20=win('quantile_cont','volume',20,W1,extra=', 0.5'),
 rank120=rank_sql('volume',120,W1), z='(close - '+win('avg','close',48,W1)+')/nullif('+win('stddev_pop','close',48,W1)+',0)')} FROM a""")
def _(spark, d):
    """The short forms run as Spark windows, the long ones in the rolling helper; both are checked."""
    rolls = [Roll("q90", "quantile", "ar", 96, 0.9), Roll("q10_mp", "quantile", "ar", 96, 0.1, 30), Roll("rank120", "rank", "volume", 120)]

    def build(x, w):
        c = F.col("close")
        x = x.withColumn("ar", F.abs(W.ret(c, w)))
        x = x.withColumns({"rank40": W.pct_rank(F.col("ar"), w, 40), "rank_mp": W.pct_rank(F.col("ar"), w, 60, 20),
                           "med20": W.quantile(F.col("volume"), .5, w, 20), "z": (c - W.mean(c, w, 48)) / F.nullif(W.std(c, w, 48), F.lit(0.0))})
        return long_rolling(x, SYM, rolls)
    return _blocks(_daily(spark, d), build, back=130).select("symbol", "ts", "rank40", "rank_mp", "q90", "q10_mp", "med20", "rank120", "z")


@query("ema_and_slope", f"""WITH {EB(14400)}, a AS (SELECT symbol, ts, list(close) OVER ({W1} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM eb),
e AS (SELECT symbol, ts, list_reduce(l, lambda a, x: a + (x - a)*2.0/21) AS ema FROM a)
SELECT symbol, ts, {rx(ema='ema', slope=f'ema - lag(ema, 3) OVER ({W1})')} FROM e""")
def _(spark, d):
    rolls = [Roll("ema", "ema", "close", 20), Roll("slope", "diff", "ema", 3)]
    b = stored(derive.event_bars(spark, d, 14400))
    x = in_blocks(b, SYM, lambda x, w: long_rolling(x, SYM, rolls), back=back_rows(rolls), span=SPAN, block=64)
    return x.select("symbol", "ts", "ema", "slope")


@query("prior_extremes_and_breaks", f"""WITH {DB}, a AS (SELECT *, CASE WHEN count(high) OVER p >= 12 THEN max(high) OVER p END AS ph, CASE WHEN count(low) OVER p >= 12 THEN min(low) OVER p END AS pl FROM db WINDOW p AS ({W1} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(close > ph, false) AS up, coalesce(close < pl, false) AS dn, lag(ph) OVER w AS ph1, lag(ph,2) OVER w AS ph2 FROM a WINDOW w AS ({W1}))
SELECT symbol, ts, {R('ph','pl', places=9)}, up, dn, (coalesce(lag(up) OVER w, false) AND coalesce(close <= ph1, false)) OR (coalesce(lag(up,2) OVER w, false) AND coalesce(close <= ph2, false)) AS failed_high FROM b WINDOW w AS ({W1})""", places=9)
def _(spark, d):
    def build(x, w):
        c = F.col("close")
        x = x.withColumns({"ph": W.prior_max(F.col("high"), w, 12), "pl": W.prior_min(F.col("low"), w, 12)})
        x = x.withColumns({"up": gt(c, F.col("ph")), "dn": lt(c, F.col("pl")), "ph1": W.lag(F.col("ph"), w), "ph2": W.lag(F.col("ph"), w, 2)})
        lagb = lambda k: F.coalesce(W.lag(F.col("up"), w, k), F.lit(False))
        return x.withColumn("failed_high", (lagb(1) & le(c, F.col("ph1"))) | (lagb(2) & le(c, F.col("ph2"))))
    return _blocks(_daily(spark, d), build).select("symbol", "ts", "ph", "pl", "up", "dn", "failed_high")


@query("state_changes", f"""WITH {DB}, a AS (SELECT *, sign(close - lag(close) OVER ({W1}))::DOUBLE AS s, volume > 200 AS hot FROM db),
b AS (SELECT *, coalesce(s <> lag(s) OVER w, true) AND coalesce(s <> 0, true) AS flip, coalesce(s = -1 AND lag(s) OVER w = 1, false) AS down, hot AND NOT coalesce(lag(hot) OVER w, false) AS onset,
 coalesce(max(hot::INT) OVER ({W1} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) > 0, false) AS recent6, coalesce(max(hot::INT) OVER ({W1} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) > 0, false) AS recent4,
 CASE WHEN count(*) OVER ({W1} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN min((NOT hot)::INT) OVER ({W1} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 ELSE false END AS calm5,
 coalesce(s = 1 AND lag(s) OVER w = 1 AND lag(s,2) OVER w = 1, false) AS up3,
 (volume > 180)::INT + coalesce(lag(volume,12) OVER w > 180, false)::INT + coalesce(lag(volume,24) OVER w > 180, false)::INT >= 2 AS cluster,
 coalesce(close > lag(close,12) OVER w AND lag(close,12) OVER w > lag(close,24) OVER w, false) AS chain,
 close - lag(close,12) OVER w - (lag(close,12) OVER w - lag(close,24) OVER w) AS accel FROM a WINDOW w AS ({W1}))
SELECT symbol, ts, flip, down, onset, recent6, recent4, calm5, up3, cluster, chain, {R('accel')} FROM b""")
def _(spark, d):
    def build(x, w):
        c, v = F.col("close"), F.col("volume")
        x = x.withColumns({"s": sign(W.diff(c, w)), "hot": gt(v, 200.0)})
        s, hot = F.col("s"), F.col("hot")
        hit = lambda k: (gt(W.lag(v, w, k) if k else v, 180.0)).cast("int")
        return x.withColumns({
            "flip": W.flip(s, w), "down": W.flip_down(s, w), "onset": W.onset(hot, w), "recent6": W.recent(hot, w, 6), "recent4": W.recent(hot, w, 4, shift=0),
            "calm5": W.sustained(~hot, w, 5), "up3": eq(s, 1.0) & eq(W.lag(s, w), 1.0) & eq(W.lag(s, w, 2), 1.0), "cluster": (hit(0) + hit(12) + hit(24)) >= 2,
            "chain": gt(c, W.lag(c, w, 12)) & gt(W.lag(c, w, 12), W.lag(c, w, 24)), "accel": W.diff(c, w, 12) - (W.lag(c, w, 12) - W.lag(c, w, 24))})
    return _blocks(_daily(spark, d), build).drop("open", "high", "low", "close", "volume", "s", "hot")


@query("run_lengths", f"""WITH {DB}, a AS (SELECT *, coalesce(sign(close - lag(close) OVER ({W1})), 0)::INT AS s, row_number() OVER ({W1}) AS rn FROM db),
b AS (SELECT *, CASE WHEN s = 0 OR s IS DISTINCT FROM lag(s) OVER ({W1}) THEN 1 ELSE 0 END AS brk, CASE WHEN volume > 150 THEN 0 ELSE 1 END AS vb FROM a),
c AS (SELECT *, sum(brk) OVER ({W1}) AS g, max(CASE WHEN vb = 1 THEN rn ELSE 0 END) OVER ({W1}) AS lastv FROM b)
SELECT symbol, ts, s * (row_number() OVER (PARTITION BY symbol, g ORDER BY ts))::DOUBLE AS signed_run, (rn - lastv)::DOUBLE AS busy_run FROM c""")
def _(spark, d):
    x = _blocks(_daily(spark, d), lambda x, w: x.withColumn("s", F.coalesce(sign(W.diff(F.col("close"), w)), F.lit(0.0))).withColumn("s1", W.lag(F.col("s"), w)))
    x = stored(running(stored(x), SYM, ["ts"], [Run("idx", "count", F.lit(1))], F.col("ts"), SPAN).withColumn("idx", F.col("idx") - 1))
    x = stored(run_length(x, SYM, ["ts"], ne(F.col("s"), 0.0) & eq(F.col("s"), F.col("s1")), "r", F.col("ts"), SPAN))
    x = run_length(x, SYM, ["ts"], F.col("volume") > 150, "busy_run", F.col("ts"), SPAN)
    return x.select("symbol", "ts", (F.col("s") * (F.col("r") + 1)).alias("signed_run"), "busy_run")


@query("rolling_correlation", f"""WITH {EB()}, {PAIR()}, a AS (SELECT pair, ts, coalesce(close_btc/lag(close_btc) OVER w - 1, 0) AS a, coalesce(close_eth/lag(close_eth) OVER w - 1, 0) AS b FROM pb WINDOW w AS (PARTITION BY pair ORDER BY ts))
SELECT pair, ts, round((coalesce(CASE WHEN count(*) OVER w >= 24 THEN corr(a, b) OVER w END, 0)) + 3.14159e-08, 6) + 0.0 AS corr24 FROM a WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    def build(x, w):
        x = x.withColumns({f"r_{a}": F.coalesce(W.ret(F.col(f"close_{a}"), w), F.lit(0.0)) for a in ("btc", "eth")})
        return x.withColumn("corr24", F.coalesce(W.corr(F.col("r_btc"), F.col("r_eth"), w, 24), F.lit(0.0)))
    return _blocks(stored(pair(spark, d)), build, keys=["pair"]).select("pair", "ts", "corr24")


@query("carried_changes", f"""WITH {EB()}, {SLOW}, {PAIR()}, j AS (SELECT pb.pair, pb.ts, sl.oi_contracts_btc AS oi FROM pb ASOF LEFT JOIN sl ON pb.pair = sl.pair AND pb.ts >= sl.ts)
SELECT pair, ts, round((CASE WHEN oi <> lag(oi) OVER (PARTITION BY pair ORDER BY ts) THEN oi/lag(oi) OVER (PARTITION BY pair ORDER BY ts) - 1 END) + 3.14159e-08, 6) + 0.0 AS chg FROM j""")
def _(spark, d):
    from barlab.operators.asof import asof_join
    j = stored(asof_join(stored(pair(spark, d)), slow(spark, d)["oi"], ["pair"], ["oi_contracts_btc"]))
    return _blocks(j, lambda x, w: x.withColumn("chg", W.carry_change(F.col("oi_contracts_btc"), w)), keys=["pair"]).select("pair", "ts", "chg")


@query("best_two_per_day", f"""WITH {EB()}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts//86400 ORDER BY volume DESC, ts) AS k FROM eb) SELECT symbol, ts, round((volume) + 3.14159e-08, 6)+0.0 AS volume FROM r WHERE k <= 2""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol", day_of(F.col("ts"))).orderBy(F.col("volume").desc(), "ts")
    return derive.event_bars(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 2").select("symbol", "ts", "volume")


_IDX = f"ix AS (SELECT *, row_number() OVER ({W1}) - 1 AS i FROM eb)"


@query("thinning", f"""WITH RECURSIVE {EB()}, {_IDX}, c AS (SELECT symbol, i FROM ix WHERE volume >= 3),
t AS (SELECT symbol, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(c.i) FROM c WHERE c.symbol = t.symbol AND c.i >= t.i + 7) AS i FROM t WHERE t.i IS NOT NULL)
SELECT ix.symbol, ix.ts FROM t JOIN ix ON t.symbol = ix.symbol AND t.i = ix.i""")
def _(spark, d):
    x = _blocks(stored(derive.event_bars(spark, d)), lambda x, w: x.withColumn("i", F.col("idx")))
    return thin(x.where("volume >= 3"), SYM, 7, pos="i", chunk=64, fan=4).select("symbol", "ts")


@query("two_tier_thinning", f"""WITH RECURSIVE {EB()}, {_IDX}, c AS (SELECT symbol, i, CASE WHEN volume >= 5 THEN 6 ELSE 24 END AS need FROM ix WHERE volume >= 3),
t AS (SELECT symbol, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(c.i) FROM c WHERE c.symbol = t.symbol AND c.i - t.i >= c.need) AS i FROM t WHERE t.i IS NOT NULL)
SELECT ix.symbol, ix.ts FROM t JOIN ix ON t.symbol = ix.symbol AND t.i = ix.i""")
def _(spark, d):
    x = _blocks(stored(derive.event_bars(spark, d)), lambda x, w: x.withColumn("i", F.col("idx")))
    return thin(x.where("volume >= 3"), SYM, F.when(F.col("volume") >= 5, 6).otherwise(24), pos="i", max_gap=24, chunk=64, fan=4).select("symbol", "ts")


@query("equity_and_drawdown", f"""WITH {DB}, a AS (SELECT symbol, ts, (close/lag(close) OVER ({W1}) - 1)/5000 AS r FROM db), e AS (SELECT *, exp(sum(ln(1+r)) OVER ({W1})) AS eq, sum(r) OVER ({W1}) AS ad FROM a WHERE r IS NOT NULL)
SELECT symbol, ts, {rx(equity='eq', drawdown=f'eq/max(eq) OVER ({W1}) - 1', added='ad', drop=f'max(ad) OVER ({W1}) - ad')} FROM e""")
def _(spark, d):
    x = stored(_blocks(_daily(spark, d), lambda x, w: x.withColumn("r", W.ret(F.col("close"), w) / 5000)).where("r is not null").select("symbol", "ts", "r"))
    c = drawdown(x, SYM, ["ts"], "r", F.col("ts"), SPAN).select("symbol", "ts", "equity", "drawdown")
    a = drawdown(x, SYM, ["ts"], "r", F.col("ts"), SPAN, compounded=False).select("symbol", "ts", F.col("equity").alias("added"), F.col("drawdown").alias("drop"))
    return c.join(a, ["symbol", "ts"])


@query("loss_streaks", f"""WITH {DB}, a AS (SELECT symbol, ts, close <= lag(close) OVER ({W1}) AS down FROM db), b AS (SELECT *, sum(CASE WHEN coalesce(down, false) THEN 0 ELSE 1 END) OVER ({W1}) AS g FROM a)
SELECT symbol, max(n) AS worst FROM (SELECT symbol, g, count(*) FILTER (down) AS n FROM b GROUP BY 1,2) GROUP BY 1""")
def _(spark, d):
    x = stored(_blocks(_daily(spark, d), lambda x, w: x.withColumn("down", le(F.col("close"), W.lag(F.col("close"), w)))).select("symbol", "ts", "down"))
    return max_streak(x, SYM, ["ts"], F.col("down"), "worst", F.col("ts"), SPAN)


# --- batch features ----------------------------------------------------------------------------------------
BF = f"""bf AS (SELECT symbol, ts, close, {win('avg','tr',14,W1)} AS atr14, abs(close - c20)/nullif({win('sum','st',20,W1)},0) AS er20, {win('stddev_samp','lr',48,W1)} AS rv48,
 {win('sum','tpv',48,W1)}/nullif({win('sum','volume',48,W1)},0) AS vwap48 FROM (SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr, abs(close-pc) AS st, ln(close/pc) AS lr, (high+low+close)/3*volume AS tpv
 FROM (SELECT *, lag(close) OVER ({W1}) AS pc, lag(close,20) OVER ({W1}) AS c20 FROM eb)))"""


@query("batch_features", f"WITH {EB()}, {BF} SELECT symbol, ts, {R('atr14','er20','rv48','vwap48')} FROM bf")
def _(spark, d):
    return feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10)


@query("features_long", f"WITH {EB()}, {BF} SELECT symbol, ts, f AS feature_name, 'v1' AS feature_version, round((v) + 3.14159e-08, 6) + 0.0 AS feature_value FROM (SELECT symbol, ts, unnest(['atr14','er20','rv48','vwap48']) AS f, unnest([atr14, er20, rv48, vwap48]) AS v FROM bf WHERE atr14 IS NOT NULL AND er20 IS NOT NULL AND rv48 IS NOT NULL AND vwap48 IS NOT NULL)")
def _(spark, d):
    return readers.unpivot_features(feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10))


@query("bars_with_features", f"WITH {EB()}, {BF} SELECT eb.symbol, eb.ts, round((eb.close) + 3.14159e-08, 6)+0.0 AS close, " + ", ".join(f"round((CASE WHEN rv48 IS NOT NULL AND vwap48 IS NOT NULL THEN {c} END) + 3.14159e-08, 6)+0.0 AS {c}" for c in ("atr14", "er20", "rv48", "vwap48")) + " FROM eb LEFT JOIN bf ON eb.symbol=bf.symbol AND eb.ts=bf.ts")
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    f = readers.unpivot_features(feat.batch_features(b, span=86400 * 10))
    return readers.bars_with_features(b, f).select("symbol", "ts", "close", "atr14", "er20", "rv48", "vwap48")


@query("signal_snapshots", f"""WITH {EB()}, {BF}, p AS (SELECT event_id AS position_id, event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT)//3600*3600 AS opened_at FROM events WHERE value > 30 AND event_id % 5 <> 0)
SELECT p.position_id, p.symbol, p.opened_at AS entry_ts, p.opened_at - 3600 AS signal_ts, round((eb.close) + 3.14159e-08, 6)+0.0 AS signal_close, {R('atr14','er20', t='bf')}, CASE WHEN er20 IS NULL THEN NULL WHEN er20 >= 0.35 THEN 'trend' WHEN er20 <= 0.25 THEN 'mean' ELSE 'uncertain' END AS regime
FROM p JOIN eb ON eb.symbol=p.symbol AND eb.ts=p.opened_at-3600 LEFT JOIN bf ON bf.symbol=p.symbol AND bf.ts=p.opened_at-3600""")
def _(spark, d):
    from barlab.functions.scalar import epoch_seconds, floor_to
    from barlab.sources.sinks import signal_snapshots
    b = stored(derive.event_bars(spark, d))
    e = derive.read(spark, d, "events").where("value > 30")
    p = e.select(F.col("event_id").alias("position_id"), F.col("event_type").alias("symbol"), floor_to(epoch_seconds(F.col("ts")), 3600).alias("opened_at"))
    done = e.where("event_id % 5 = 0").select(F.col("event_id").alias("position_id"))
    s = signal_snapshots(p, done, b, feat.batch_features(b, span=86400 * 10), offset_sec=3600)
    return s.select("position_id", "symbol", "entry_ts", "signal_ts", "signal_close", "atr14", "er20", "regime")


# --- the pair frame ------------------------------------------------------------------------------------------
PW = "PARTITION BY pair ORDER BY ts"
COARSE = f"""h0 AS (SELECT pair, ts//14400*14400 AS ts, arg_max(close_btc, ts) AS cb, arg_max(close_eth, ts) AS ce FROM pb GROUP BY 1, 2),
h1 AS (SELECT *, (ce/lag(ce,6) OVER ({PW}) - 1) - (cb/lag(cb,6) OVER ({PW}) - 1) AS spread, list_reduce(list(ce) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a + (x-a)*2.0/21) AS ee,
 list_reduce(list(cb) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a + (x-a)*2.0/21) AS eb_ FROM h0),
h2 AS (SELECT *, ee - lag(ee,3) OVER ({PW}) AS sl_e, eb_ - lag(eb_,3) OVER ({PW}) AS sl_b FROM h1),
h3 AS (SELECT *, sign(sl_e)::DOUBLE AS s, sign(sl_b)::DOUBLE AS sb, abs(sl_e) AS sa FROM h2),
h4 AS (SELECT pair, ts, s AS eth_slope_sign_1h, sb AS btc_slope_sign_1h, sa AS eth_slope_abs_1h, coalesce(s <> 0, true) AND coalesce(s = lag(s) OVER ({PW}), false) AS eth_slope_stable_2_1h,
 {win('quantile_cont','sa',24,PW,extra=', 0.7')} AS eth_slope_abs_q70_1h, {rank_sql('sa',24,PW)} AS eth_slope_abs_pct_1h, (sl_e - {win('avg','sl_e',24,PW)})/nullif({win('stddev_pop','sl_e',24,PW)},0) AS eth_slope_z_1h,
 {rank_sql('spread',48,PW)} AS spread_pct, coalesce(ce > ee, false) AS eth_above_ema20_1h FROM h3)"""
_HC = ["eth_slope_sign_1h", "btc_slope_sign_1h", "eth_slope_abs_1h", "eth_slope_abs_q70_1h", "eth_slope_abs_pct_1h", "eth_slope_z_1h", "spread_pct"]


@query("coarse_block", f"WITH {EB()}, {PAIR()}, {COARSE} SELECT pair, ts, {R(*_HC)}, eth_slope_stable_2_1h, eth_above_ema20_1h FROM h4")
def _(spark, d):
    return FR.coarse_block(stored(pair(spark, d)), CFG).select("pair", "ts", *_HC, "eth_slope_stable_2_1h", "eth_above_ema20_1h")


def _leg(a: str) -> dict[str, str]:
    return {f"ret1_{a}": f"c_{a}/pc_{a}-1", f"tr_{a}": f"CASE WHEN pc_{a} IS NOT NULL THEN greatest(high_{a}-low_{a}, abs(high_{a}-pc_{a}), abs(low_{a}-pc_{a})) END"}


L = 96
_f1 = f"""f0 AS (SELECT pb.*, h4.* EXCLUDE (pair, ts), close_btc AS c_btc, close_eth AS c_eth, lag(close_btc) OVER w AS pc_btc, lag(close_eth) OVER w AS pc_eth, lag(close_btc,20) OVER w AS c20_btc, lag(close_eth,20) OVER w AS c20_eth,
  lag(close_btc,48) OVER w AS c48_btc, lag(close_eth,48) OVER w AS c48_eth, lag(close_btc,12) OVER w AS c12_btc, lag(close_eth,12) OVER w AS c12_eth
  FROM pb JOIN h4 ON h4.pair = pb.pair AND h4.ts = pb.ts//14400*14400 WINDOW w AS (PARTITION BY pb.pair ORDER BY pb.ts)),
f1 AS (SELECT *, {", ".join(f"{e} AS {n}" for a in ("btc", "eth") for n, e in _leg(a).items())}, abs(c_btc-pc_btc) AS st_btc, abs(c_eth-pc_eth) AS st_eth, abs(c_btc/pc_btc-1) AS ar_btc, abs(c_eth/pc_eth-1) AS ar_eth FROM f0),
f2 AS (SELECT *, {", ".join(f"{win('avg', f'tr_{a}', 14, PW)} AS atr14_{a}, {win('stddev_pop', f'ret1_{a}', 48, PW)} AS rv48_{a}, abs(c_{a}-c20_{a})/nullif({win('sum', f'st_{a}', 20, PW)},0) AS er20_{a}, {win('sum', f'c_{a}*volume_{a}', 48, PW)}/nullif({win('sum', f'volume_{a}', 48, PW)},0) AS vwap48_{a}" for a in ("btc", "eth"))},
  {win('sum', 'c_btc*volume_btc', 24, PW)}/nullif({win('sum', 'volume_btc', 24, PW)},0) AS vwap_btc FROM f1),
f3 AS (SELECT *, c_btc - vwap48_btc AS dist_to_vwap48_btc, c_eth - vwap48_eth AS dist_to_vwap48_eth, c_btc - vwap_btc AS dev, er20_btc - er20_eth AS delta_er FROM f2),
f4 AS (SELECT *, dev/nullif({win('stddev_pop','dev',24,PW)},0) AS vwap_z, dist_to_vwap48_btc/nullif({win('stddev_pop','dist_to_vwap48_btc',L,PW)},0) AS dist_to_vwap48_z_btc,
  dist_to_vwap48_eth/nullif({win('stddev_pop','dist_to_vwap48_eth',L,PW)},0) AS dist_to_vwap48_z_eth,
  {rank_sql('atr14_btc',L,PW)} AS atr14_pct_btc, {rank_sql('rv48_btc',L,PW)} AS rv48_pct_btc, {rank_sql('volume_btc',L,PW)} AS volume_btc_pct, {rank_sql('ar_btc',L,PW)} AS ret1_abs_btc_pct,
  {win('quantile_cont','ar_btc',L,PW,extra=', 0.9')} AS ret1_abs_btc_q90, {win('quantile_cont','tr_btc',L,PW,extra=', 0.25')} AS tr_btc_q25 FROM f3)"""
FRAME = f"{EB()}, {PAIR()}, {COARSE}, {_f1}"
_FC = ["spread_pct", "eth_slope_sign_1h", "ret1_btc", "tr_btc", "atr14_btc", "rv48_btc", "er20_btc", "vwap48_btc", "atr14_eth", "rv48_eth", "er20_eth", "vwap48_eth", "vwap_btc", "vwap_z", "dist_to_vwap48_btc",
       "dist_to_vwap48_z_btc", "dist_to_vwap48_z_eth", "delta_er", "atr14_pct_btc", "rv48_pct_btc", "volume_btc_pct", "ret1_abs_btc_pct", "ret1_abs_btc_q90", "tr_btc_q25"]


@query("feature_frame", f"WITH {FRAME} SELECT pair, ts, {R(*_FC)} FROM f4")
def _(spark, d):
    return FR.frame(pair(spark, d), CFG).select("pair", "ts", *_FC)


@query("frame_without_lookahead", f"""WITH {EB()}, {PAIR()}, {COARSE} SELECT pb.pair, pb.ts, {R('eth_slope_sign_1h', 'spread_pct', t='h')} FROM pb ASOF LEFT JOIN (SELECT *, ts + 14400 AS until FROM h4) h ON pb.pair = h.pair AND pb.ts >= h.until""")
def _(spark, d):
    return FR.aligned(stored(pair(spark, d)), CFG, label="right").select("pair", "ts", "eth_slope_sign_1h", "spread_pct")


ALIGNED = f"{EB()}, {SLOW}, {PAIR()}, al AS (SELECT pb.pair, pb.ts, sl.* EXCLUDE (pair, ts) FROM pb ASOF LEFT JOIN sl ON pb.pair = sl.pair AND pb.ts >= sl.ts)"


@query("slow_feature_block", f"""WITH {ALIGNED}, a AS (SELECT *, long_liq_usd_btc + short_liq_usd_btc AS tl, coalesce(long_liq_usd_btc,0) AS ll, sign(funding_rate_btc)::DOUBLE AS fs, funding_rate_eth - funding_rate_btc AS fsp FROM al),
b AS (SELECT *, funding_rate_btc*24*365 AS funding_btc_ann, {rank_sql('funding_rate_btc',120,PW)} AS funding_btc_pct, (funding_rate_btc - {win('avg','funding_rate_btc',120,PW)})/nullif({win('stddev_pop','funding_rate_btc',120,PW)},0) AS funding_btc_z,
 fs AS funding_btc_sign, coalesce(fs <> lag(fs) OVER ({PW}), true) AND coalesce(fs <> 0, true) AS funding_btc_flip, {rank_sql('oi_contracts_btc',120,PW)} AS oi_btc_pct, {rank_sql('oi_contracts_eth',120,PW)} AS oi_eth_pct,
 CASE WHEN oi_contracts_btc <> lag(oi_contracts_btc) OVER ({PW}) THEN oi_contracts_btc/lag(oi_contracts_btc) OVER ({PW}) - 1 END AS oi_btc_chg, {rank_sql('fsp',120,PW)} AS funding_spread_pct,
 {rank_sql('ll',120,PW)} AS long_liq_btc_pct, CASE WHEN tl > 0 THEN ll/tl END AS liq_imbalance_btc FROM a)
SELECT pair, ts, {R('funding_btc_ann','funding_btc_pct','funding_btc_sign','oi_btc_pct','oi_btc_chg','funding_spread_pct','long_liq_btc_pct','liq_imbalance_btc')}, round((funding_btc_z) + 3.14159e-08, 4)+0.0 AS funding_btc_z, round((oi_eth_pct - oi_btc_pct) + 3.14159e-08, 6)+0.0 AS oi_spread_pct, funding_btc_flip,
 coalesce(funding_btc_pct >= 0.9, false) AS funding_btc_extreme_long, coalesce(funding_btc_pct <= 0.1, false) AS funding_btc_extreme_short, hmm_regime FROM b""")
def _(spark, d):
    x = FR.frame(pair(spark, d), CFG, slow(spark, d))
    return x.select("pair", "ts", "funding_btc_ann", "funding_btc_pct", F.round(F.col("funding_btc_z") + 3.14159e-08, 4).alias("funding_btc_z"), "funding_btc_sign", "funding_btc_flip", "oi_btc_pct", "oi_btc_chg",
                    "funding_spread_pct", "long_liq_btc_pct", "liq_imbalance_btc", "oi_spread_pct", "funding_btc_extreme_long", "funding_btc_extreme_short", "hmm_regime")


def _th():
    lg = lambda c, k: f"lag({c},{k}) OVER ({PW})"
    z = lambda c: f"coalesce({c},0)"
    return f"""WITH {EB()}, {SLOW}, {PAIR()}, {COARSE}, {_f1}, g0 AS (SELECT f4.*, sl.* EXCLUDE (pair, ts) FROM f4 ASOF LEFT JOIN sl ON f4.pair = sl.pair AND f4.ts >= sl.ts),
g1 AS (SELECT *, coalesce(spread_pct, 0.5) AS sp, coalesce(rv48_pct_btc, 0.5) AS rv, coalesce(funding_rate_btc, 0) AS f, oi_contracts_btc AS oi, coalesce(sign(ret1_btc), 0)::INT AS sg, {z('c_btc/c48_btc-1')} AS r4b, {z('c_eth/c48_eth-1')} AS r4e,
  {z('c_btc/c12_btc-1')} - {z('c_eth/c12_eth-1')} AS dv, {rank_sql('(long_liq_usd_btc + short_liq_usd_btc)',120,PW)} AS tlp, {rank_sql('long_liq_usd_btc',120,PW)} AS llp,
  {win('quantile_cont','ar_btc',24,PW,extra=', 0.3')} AS q30, (ts % 86400)//60/60.0 AS hr, coalesce(rv48_pct_btc < 0.2, false)::INT AS low, row_number() OVER ({PW}) AS rn FROM g0),
g2 AS (SELECT *, coalesce(oi - {lg('oi',12)}, 0) AS oic, CASE WHEN sg = 0 OR sg IS DISTINCT FROM lag(sg) OVER ({PW}) THEN 1 ELSE 0 END AS brk FROM g1),
g3 AS (SELECT *, sum(brk) OVER ({PW}) AS grp, {rank_sql('oic',24,PW,12)} AS oip FROM g2)
SELECT pair, ts, {rx(hour_sin='sin(2*pi()*hr/24)', hour_cos='cos(2*pi()*hr/24)', btc_eth_div_1h='dv', oi_velocity=f"oi - {lg('oi',12)} - ({lg('oi',12)} - {lg('oi',24)})",
 liq_imbalance_dir='coalesce(llp/nullif(tlp,0), 0.5) - 0.5', spread_chg_1h=f"sp - {lg('sp',12)}", ret_4h_btc='r4b', ret_4h_eth='r4e', eth_slope_4h='sign(r4e)::DOUBLE', btc_slope_4h='sign(r4b)::DOUBLE',
 vol_price_div='(coalesce(volume_btc_pct > 0.7, false) AND coalesce(ar_btc < q30, false))::INT::DOUBLE', rv_chg_1h=f"rv - {lg('rv',12)}", funding_chg_1h=f"f - {lg('f',12)}", funding_accel=f"f - {lg('f',12)} - ({lg('f',12)} - {lg('f',24)})",
 bar_dir_run='sg * (row_number() OVER (PARTITION BY pair, grp ORDER BY ts))::DOUBLE', oi_vol_ratio='coalesce(oip, 0.5)/(coalesce(volume_btc_pct, 0.5) + 0.01)',
 funding_pos_hours=f"(rn - max(CASE WHEN f > 0 THEN 0 ELSE rn END) OVER ({PW}))/12.0", funding_neg_hours=f"(rn - max(CASE WHEN f < 0 THEN 0 ELSE rn END) OVER ({PW}))/12.0")},
 CASE WHEN count(*) OVER ({PW} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) >= 48 THEN min(low) OVER ({PW} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) ELSE 0 END::BIGINT AS rv_compressed_4h,
 coalesce(oi > {lg('oi',12)} AND {lg('oi',12)} > {lg('oi',24)} AND {lg('oi',24)} > {lg('oi',36)}, false)::BIGINT AS oi_expanding_3h,
 (coalesce(tlp > 0, false)::INT + coalesce({lg('tlp',12)} > 0, false)::INT + coalesce({lg('tlp',24)} > 0, false)::INT >= 2)::BIGINT AS liq_cluster_2h FROM g3"""


@query("theory_features", _th())
def _(spark, d):
    x = FR.blocked_frame(pair(spark, d), CFG, slow(spark, d))
    return feat.theory_features(x, CFG.chunk, CFG.w_day, CFG.min_day).select("pair", "ts", *[c for c in feat.THEORY if c != "btc_eth_corr_2h"])


@query("feature_summary", f"""WITH {EB()}, {BF} SELECT symbol, feature, round((min(v)) + 3.14159e-08, 6)+0.0 AS min, round((max(v)) + 3.14159e-08, 6)+0.0 AS max, round((avg(v)) + 3.14159e-08, 6)+0.0 AS mean, count(*) FILTER (v IS NULL) AS missing FROM
 (SELECT symbol, unnest(['atr14','er20','rv48','vwap48']) AS feature, unnest([atr14, er20, rv48, vwap48]) AS v FROM bf) GROUP BY 1, 2""")
def _(spark, d):
    from barlab.plans.quality import feature_summary
    return feature_summary(feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10), readers.BATCH_FEATURES)


@query("feature_plausibility", f"""WITH {EB()}, {BF}, t AS (SELECT symbol, unnest([CASE WHEN er20 < 0.02 THEN -er20 ELSE er20 END]) AS er, atr14, rv48, vwap48, close FROM bf)
SELECT CASE WHEN f = '' THEN 'ok' ELSE f END AS flags, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN er < 0 OR er > 1 THEN 'er_out_of_bounds' END, CASE WHEN atr14 <= 0 OR rv48 <= 0 THEN 'atr_or_rv_nonpositive' END, CASE WHEN vwap48 <= 0 OR close <= 0 THEN 'vwap_or_close_nonpositive' END], lambda x: x IS NOT NULL), ',') AS f FROM t) GROUP BY 1""")
def _(spark, d):
    from barlab.plans.quality import plausibility
    f = feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10, keep=["close"])
    f = f.withColumn("er20", F.when(F.col("er20") < 0.02, -F.col("er20")).otherwise(F.col("er20")))
    return plausibility(f).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


@query("feature_coverage", f"""WITH {EB()}, {BF} SELECT * FROM (
 SELECT 'er20' AS feature, count(er20) AS valid, NULL::DOUBLE AS active_pct, round((avg(er20)) + 3.14159e-08, 6)+0.0 AS mean, round((max(er20)) + 3.14159e-08, 6)+0.0 AS max FROM bf
 UNION ALL SELECT 'high_er', count(er20), round((100.0*count(*) FILTER (er20 > 0.35)/count(er20)) + 3.14159e-08, 6)+0.0, NULL, NULL FROM bf)""")
def _(spark, d):
    from barlab.plans.quality import feature_coverage
    f = feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10)
    return feature_coverage(f.withColumn("high_er", F.when(F.col("er20").isNotNull(), (F.col("er20") > 0.35).cast("int"))), ["er20", "high_er"])
