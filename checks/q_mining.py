"""Feature mining and regime labelling."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.store import stored
from barlab.plans import frame as FR
from barlab.plans import mining as MN
from barlab.sources import derive

from .fixtures import CFG, EB, PAIR, SLOW, pair, slow
from .q_features import FRAME, PW, W1
from .registry import R, query, r6, rank_sql, rx, win

FEATS = ["delta_er", "dist_to_vwap48_btc", "er20_btc", "er20_eth", "ret1_btc"]
H = 6
_M0 = f"""m0 AS (SELECT *, lead(close_btc, {H}) OVER ({PW})/close_btc - 1 AS fwd_r_h FROM f4),
m AS (SELECT pair, ts, fwd_r_h, sign(fwd_r_h)::BIGINT AS target, {", ".join(FEATS)} FROM m0 WHERE fwd_r_h <> 0 AND {" AND ".join(f"{f} IS NOT NULL" for f in FEATS)})"""
_M = f"{FRAME}, {_M0}"


def _matrix(spark, d, regime=None, h=H):
    x = stored(FR.frame(pair(spark, d), CFG, {"regime": slow(spark, d)["regime"]} if regime else None, only={"close_btc", "hmm_regime", *FEATS}).select("pair", "ts", "close_btc", *FEATS, *(["hmm_regime"] if regime else [])))
    return MN.training_matrix(x, FEATS, h, regime, span=CFG.chunk)


@query("training_matrix", f"WITH {_M} SELECT pair, ts, target, {R('fwd_r_h', *FEATS)} FROM m")
def _(spark, d):
    return _matrix(spark, d)


@query("training_matrix_by_regime", f"""WITH {SLOW}, {FRAME}, {_M0.replace('FROM f4)', 'FROM f4 ASOF LEFT JOIN (SELECT pair AS sp_, ts AS st, hmm_regime FROM sl) s ON f4.pair = s.sp_ AND f4.ts >= s.st)').replace('WHERE fwd_r_h <> 0', "WHERE hmm_regime = 'RANGING' AND fwd_r_h <> 0")} SELECT pair, ts, target, {R('fwd_r_h', *FEATS)} FROM m""")
def _(spark, d):
    return _matrix(spark, d, "RANGING")


_F = """d AS (SELECT ts//86400 AS day, count(*) AS n FROM m GROUP BY 1), b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), cu AS (SELECT lo, lo + 10 + k*4 AS cut FROM b, range(50) r(k) WHERE lo + 10 + k*4 <= hi),
f0 AS (SELECT lo, cut, sum(n) FILTER (day < cut) AS n_train, coalesce(sum(n) FILTER (day >= cut), 0) AS n_test FROM cu JOIN d ON day < cut + 4 GROUP BY 1,2),
fo AS (SELECT row_number() OVER (ORDER BY cut) AS fold, lo*86400 AS train_start, cut*86400 AS train_end, (cut+4)*86400 AS test_end, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test FROM f0 WHERE n_train >= 100 AND n_test >= 30)"""
_F = _F.replace("f0 AS", "fd0 AS").replace("FROM f0", "FROM fd0")


def _folds(m):
    return MN.expanding_folds(m, 10, 4, 100, 30)


@query("expanding_folds", f"WITH {_M}, {_F} SELECT * FROM fo")
def _(spark, d):
    return _folds(stored(_matrix(spark, d)))


@query("sliding_folds", f"""WITH {_M}, lo AS (SELECT min(ts) AS lo FROM m), li AS (SELECT lo, max(ts) AS hi FROM m, lo WHERE ts < lo + 25*86400 GROUP BY 1), st AS (SELECT lo + k*3*86400 AS s FROM li, range(50) r(k) WHERE lo + k*3*86400 + 11*86400 <= hi),
c AS (SELECT s, count(*) FILTER (ts < s + 8*86400) AS n_train, count(*) FILTER (ts >= s + 8*86400) AS n_test FROM st JOIN m ON ts >= s AND ts < s + 11*86400 GROUP BY 1)
SELECT row_number() OVER (ORDER BY s) AS fold, s AS train_start, s + 8*86400 AS train_end, s + 11*86400 AS test_end, n_train, n_test FROM c WHERE n_train >= 50 AND n_test >= 20""")
def _(spark, d):
    return MN.sliding_folds(stored(_matrix(spark, d)), 25, 8, 3, 50, 20)


@query("fold_importance", f"WITH {_M}, {_F} SELECT fold, {len(FEATS)} AS features, true AS ranked_in_order, true AS sums_to_one FROM fo")
def _(spark, d):
    """Boosted trees per fold. The importances depend on the fit; SQL says what holds for any fit."""
    m = stored(_matrix(spark, d))
    i = MN.fold_importance(m, _folds(m), FEATS, trees=5, depth=2)
    ranks = F.array_sort(F.collect_list(F.struct("rank", (-F.col("importance")).alias("i"))))
    return i.groupBy("fold").agg(F.count(F.lit(1)).alias("features"), ((F.array_sort(F.transform(ranks, lambda x: x["i"])) == F.transform(ranks, lambda x: x["i"]))
                                 & (F.max("rank") == F.count(F.lit(1)))).alias("ranked_in_order"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


# importances that SQL can repeat: absolute correlation of feature and target on the test rows of a fold
_LONG = f"lo_ AS (SELECT fold, unnest([{', '.join(repr(f) for f in FEATS)}]) AS feature, unnest([{', '.join(FEATS)}]) AS v, fwd_r_h FROM m JOIN fo ON ts >= train_end AND ts < test_end)"
_IMP = f"{_F}, {_LONG}, im AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rank FROM (SELECT fold, feature, round(abs(corr(v, fwd_r_h)), 9) AS importance, round(corr(v, fwd_r_h), 9) AS signed FROM lo_ GROUP BY 1,2))"


def _imp(m, folds):
    from pyspark.sql import Window
    a = MN.in_folds(m, folds, "train_end").groupBy("fold").agg(*[F.round(F.corr(f, "fwd_r_h"), 9).alias(f) for f in FEATS])
    l = a.unpivot(["fold"], FEATS, "feature", "signed").withColumn("importance", F.abs("signed"))
    return l.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature")))


@query("stable_features", f"""WITH {_M}, {_IMP} SELECT feature, count(*) FILTER (rank <= 3) AS consistent_folds, {rx(mean_importance='sum(importance)/4')}, CASE WHEN sum(signed) > 0 THEN 'positive' ELSE 'negative' END AS direction, false AS ca_family FROM im GROUP BY 1 HAVING count(*) FILTER (rank <= 3) >= 2""")
def _(spark, d):
    m = stored(_matrix(spark, d))
    return MN.stable_features(_imp(m, _folds(m)), 4, min_folds=2, top=3)


_RK = f"""SELECT feature, avg(importance) AS mi, stddev_samp(importance) AS si, stddev_samp(importance)/(avg(importance)+1e-10) AS cv, avg(signed) AS ms, count(*) FILTER (signed > 0) AS np, count(*) AS nf FROM im GROUP BY 1"""


@query("importance_ranking", f"""WITH {_M}, {_IMP}, rk AS ({_RK}) SELECT feature, {rx(mean_importance='mi', std_importance='si', cv='cv', mean_signed='ms')}, np AS n_folds_positive, nf AS n_folds, CASE WHEN ms > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, coalesce(cv < 0.5, false) AS consistent FROM rk""")
def _(spark, d):
    m = stored(_matrix(spark, d))
    return MN.rank_importance(_imp(m, _folds(m)))


def _mh(h):
    t = _M0.replace(f"close_btc, {H})", f"close_btc, {h})")
    s = f"{t}, {_IMP}, rk AS ({_RK}), out_ AS (SELECT {h} AS h, feature, mi, coalesce(cv < 0.5, false) AS ok FROM rk)"
    for n in ("m0", "m", "d", "b", "cu", "fd0", "fo", "lo_", "im", "rk", "out_"):
        import re
        s = re.sub(rf"\b{n}\b(?= AS \()", f"{n}_{h}", s)
        s = re.sub(rf"(?<=FROM ){n}\b", f"{n}_{h}", s)
        s = re.sub(rf"(?<=JOIN ){n}\b", f"{n}_{h}", s)
    return s


@query("horizon_ranking", f"""WITH {FRAME}, {_mh(6)}, {_mh(12)}, u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY mi DESC, feature) AS rank FROM (SELECT * FROM out__6 UNION ALL SELECT * FROM out__12))
SELECT feature, coalesce(max(rank) FILTER (h=6), 99) AS rank_h6, coalesce(max(rank) FILTER (h=12), 99) AS rank_h12, {rx(mean_importance_all='avg(mi)', mean_rank_all='avg(rank)')}, count(*) FILTER (ok) AS n_horizons_consistent FROM u GROUP BY 1""")
def _(spark, d):
    out = None
    for h in (6, 12):
        m = stored(_matrix(spark, d, h=h))
        r = MN.rank_importance(_imp(m, _folds(m))).withColumn("h", F.lit(h))
        out = r if out is None else out.unionByName(r)
    return MN.rank_horizons(stored(out), [6, 12])


def _quads_sql():
    q = ", ".join(f"quantile_cont({f}, 0.7) AS {f}_hi, quantile_cont({f}, 0.3) AS {f}_lo" for f in FEATS)
    code = ", ".join(f"CASE WHEN {f} > {f}_hi THEN 'high' WHEN {f} < {f}_lo THEN 'low' END AS {f}_c" for f in FEATS)
    pairs = " UNION ALL ".join(f"SELECT fold, '{a}' AS f1, {a}_c AS dir1, '{b}' AS f2, {b}_c AS dir2, fwd_r_h FROM te" for i, a in enumerate(FEATS) for b in FEATS[i + 1:])
    return f"""{_F}, th AS (SELECT fold, {q} FROM m JOIN fo ON ts >= train_start AND ts < train_end GROUP BY 1), te AS (SELECT fo.fold, fwd_r_h, {code} FROM m JOIN fo ON ts >= train_end AND ts < test_end JOIN th ON th.fold = fo.fold),
qd AS (SELECT fold, f1, dir1, f2, dir2, count(*) AS n, avg(fwd_r_h) AS mean_fwd_r, CASE WHEN avg(fwd_r_h) > 0 THEN 'long' ELSE 'short' END AS direction FROM ({pairs}) WHERE dir1 IS NOT NULL AND dir2 IS NOT NULL GROUP BY 1,2,3,4,5 HAVING count(*) >= 4)"""


def _quads(spark, d):
    m = stored(_matrix(spark, d))
    return MN.quadrants(m, _folds(m), FEATS, min_n=4)


@query("quadrant_returns", f"WITH {_M}, {_quads_sql()} SELECT fold, f1, dir1, f2, dir2, n, direction, {R('mean_fwd_r')} FROM qd")
def _(spark, d):
    return _quads(spark, d)


@query("interaction_strength", f"WITH {_M}, {_quads_sql()} SELECT fold, f1, f2, count(*) AS corners, {rx(strength='var_pop(mean_fwd_r)*1000')} FROM qd GROUP BY 1,2,3")
def _(spark, d):
    return MN.interaction_strength(_quads(spark, d)).withColumn("strength", F.col("strength") * 1000)


@query("stable_pairs", f"""WITH {_M}, {_quads_sql()}, g AS (SELECT f1, dir1, f2, dir2, count(*) AS fold_count, count(*) FILTER (direction='long')*1.0/count(*) AS l, avg(mean_fwd_r) AS r, avg(n) AS an FROM qd GROUP BY 1,2,3,4)
SELECT f1, dir1, f2, dir2, fold_count, CAST(floor(an) AS BIGINT) AS mean_n, CASE WHEN l >= 0.67 THEN 'long' ELSE 'short' END AS direction, {rx(pct_consistent='greatest(l, 1-l)', mean_fwd_r='r')} FROM g WHERE fold_count >= 2 AND (l >= 0.67 OR 1-l >= 0.67)""")
def _(spark, d):
    return MN.stable_pairs(_quads(spark, d), min_folds=2)


_FAM = lambda f: f"CASE WHEN contains({f}, 'rv') OR contains({f}, 'atr') THEN 'volatility_state' WHEN contains({f}, 'funding') THEN 'funding_regime' WHEN contains({f}, 'vwap') OR contains({f}, 'dist') THEN 'mean_reversion' WHEN contains({f}, 'er20') OR contains({f}, 'delta_er') THEN 'efficiency' ELSE 'unknown' END"


@query("pair_suggestions", f"""WITH {_M}, {_quads_sql()}, g AS (SELECT f1, dir1, f2, dir2, count(*) AS fold_count, count(*) FILTER (direction='long')*1.0/count(*) AS l, avg(mean_fwd_r) AS r FROM qd GROUP BY 1,2,3,4),
s AS (SELECT *, greatest(l, 1-l) AS pc, CASE WHEN l >= 0.67 THEN 'long' ELSE 'short' END AS direction FROM g WHERE fold_count >= 3 AND (l >= 0.67 OR 1-l >= 0.67)),
k AS (SELECT *, row_number() OVER (ORDER BY fold_count DESC, pc DESC, abs(r) DESC, f1, dir1, f2, dir2) AS n, {_FAM('f1')} AS a, {_FAM('f2')} AS b FROM s WHERE round(pc, 2) >= 0.7)
SELECT 'H' || CAST(264 + n AS VARCHAR) AS suggested_id, f1, dir1, f2, dir2, direction, fold_count, {rx(pct_consistent='pc', mean_fwd_r='r')},
 'Enter ' || direction || ' BTC when ' || f1 || CASE dir1 WHEN 'high' THEN ' >70th pct' ELSE ' <30th pct' END || ' AND ' || f2 || CASE dir2 WHEN 'high' THEN ' >70th pct' ELSE ' <30th pct' END || ', gated by regime=RANGING' AS suggested_rule,
 CASE WHEN a = b THEN a ELSE 'composite_' || a || '_' || b END AS suggested_family, false AS ca_family FROM k WHERE n <= 8""")
def _(spark, d):
    return MN.suggest_pairs(MN.stable_pairs(_quads(spark, d), min_folds=2), 265, "RANGING", min_folds=3)


_RB = f"""WITH {SLOW}, {FRAME}, {_M0.replace('FROM f4)', 'FROM f4 ASOF LEFT JOIN (SELECT pair AS sp_, ts AS st, hmm_regime FROM sl) s ON f4.pair = s.sp_ AND f4.ts >= s.st)').replace('SELECT pair, ts, fwd_r_h', 'SELECT hmm_regime, pair, ts, fwd_r_h')},
c AS (SELECT * FROM (VALUES ('er20_btc','positive'), ('ret1_btc','negative')) v(feature, direction)), l AS (SELECT hmm_regime AS regime, fwd_r_h, feature, direction, CASE feature WHEN 'er20_btc' THEN er20_btc ELSE ret1_btc END AS v FROM m CROSS JOIN c),
q AS (SELECT feature, quantile_cont(v, 0.7) AS hi, quantile_cont(v, 0.3) AS lo FROM l GROUP BY 1),
rb AS (SELECT feature, direction, regime, count(*) AS n, CASE WHEN count(*) >= 20 THEN avg(fwd_r_h) END AS mean_fwd_r FROM l JOIN q USING (feature) WHERE regime IS NOT NULL AND CASE WHEN direction='positive' THEN v > hi ELSE v < lo END GROUP BY 1,2,3)"""


def _breakdown(spark, d):
    x = stored(FR.frame(pair(spark, d), CFG, {"regime": slow(spark, d)["regime"]}, only={"close_btc", "hmm_regime", *FEATS}).select("pair", "ts", "close_btc", "hmm_regime", *FEATS))
    m = stored(MN.training_matrix(x, FEATS, H, span=CFG.chunk).join(x.select("pair", "ts", "hmm_regime"), ["pair", "ts"]))
    c = spark.createDataFrame([("er20_btc", "positive"), ("ret1_btc", "negative")], "feature string, direction string")
    return MN.regime_breakdown(m, c)


@query("regime_breakdown", f"{_RB} SELECT feature, direction, regime, n, {R('mean_fwd_r')} FROM rb")
def _(spark, d):
    return _breakdown(spark, d)


@query("rule_suggestions", f"""{_RB}, best AS (SELECT feature, arg_max(regime, mean_fwd_r) AS best_regime FROM rb WHERE mean_fwd_r IS NOT NULL GROUP BY 1), st AS (SELECT feature, direction, sum(n) AS consistent_folds FROM rb GROUP BY 1,2),
s AS (SELECT *, row_number() OVER (ORDER BY consistent_folds DESC, feature) AS k FROM st LEFT JOIN best USING (feature))
SELECT 'H' || CAST(264 + k AS VARCHAR) AS suggested_id, feature, direction, CAST(consistent_folds AS BIGINT) AS consistent_folds, 'Enter long BTC when ' || feature || ' is ' || CASE WHEN direction='positive' THEN 'above 70th pct' ELSE 'below 30th pct' END || coalesce(', gated by regime=' || best_regime, '') AS suggested_rule,
 CASE feature WHEN 'er20_btc' THEN 'efficiency' ELSE 'unknown' END AS suggested_family, best_regime FROM s""")
def _(spark, d):
    rb = stored(_breakdown(spark, d))
    st = rb.groupBy("feature", "direction").agg(F.sum("n").alias("consistent_folds")).withColumn("mean_importance", F.lit(0.0))
    return MN.suggest(st, rb, 265)


HB = EB(3600)
_RF = f"""{HB}, r0 AS (SELECT *, lag(close) OVER ({W1}) AS pc, lag(close,20) OVER ({W1}) AS c20 FROM eb), r1 AS (SELECT *, ln(close/pc) AS lr, abs(close-pc) AS st, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr FROM r0),
r2 AS (SELECT *, {win('stddev_samp','lr',12,W1)} AS rv_1h, greatest(0, least(1, abs(close-c20)/nullif({win('sum','st',20,W1)},0))) AS er20_1h, {win('avg','tr',14,W1)} AS atr FROM r1),
rf AS (SELECT * FROM (SELECT symbol, ts, rv_1h, er20_1h, {rank_sql('atr',100,W1)} AS atr_pct_1h, 0.5 AS funding_pct_1h FROM r2) WHERE rv_1h IS NOT NULL AND er20_1h IS NOT NULL AND atr_pct_1h IS NOT NULL)"""


def _regime_feats(spark, d):
    return MN.regime_features(derive.event_bars(spark, d), w_rank=100, span=86400 * 10)


@query("regime_features", f"WITH {_RF} SELECT symbol, ts, {R('rv_1h','er20_1h','atr_pct_1h','funding_pct_1h')} FROM rf")
def _(spark, d):
    return _regime_feats(spark, d)


@query("regime_labels", f"""WITH {_RF}, d AS (SELECT symbol, ts//86400 AS day, count(*) AS n FROM rf GROUP BY 1, 2), b AS (SELECT symbol, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), cu AS (SELECT symbol, lo + 12 + k*6 AS cut FROM b, range(50) r(k) WHERE lo + 12 + k*6 <= hi),
f0 AS (SELECT symbol, cut, coalesce(sum(n) FILTER (day < cut), 0) AS n_train, coalesce(sum(n) FILTER (day >= cut), 0) AS n_test FROM cu JOIN d USING (symbol) WHERE day < cut + 6 GROUP BY 1, 2),
fo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cut) AS fold FROM f0 WHERE n_train >= 100 AND n_test >= 30)
SELECT fo.symbol, fo.fold, fo.cut*86400 AS model_train_end, count(*) AS n, true AS once, true AS rising FROM fo JOIN rf ON rf.symbol = fo.symbol AND rf.ts >= cut*86400 AND rf.ts < (cut + 6)*86400 GROUP BY 1, 2, 3""")
def _(spark, d):
    """Mixture states per symbol and fold. The labels depend on the fit; SQL says which rows are labelled, once each, by
    which fold, and that states rise with volatility."""
    f = stored(_regime_feats(spark, d))
    folds = MN.expanding_folds(f, 12, 6, 100, 30, keys=["symbol"])
    x = stored(MN.label_regimes(f, folds))
    by = ["symbol", "fold", "model_train_end"]
    m = x.groupBy(*by, "state_id").agg(F.avg("rv_1h").alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("u"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("state_id", "m"))), lambda s: s["m"])
    return m.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("u") == F.sum("n")).alias("once"), (F.array_sort(v) == v).alias("rising"))


@query("state_summary", f"""WITH {_RF}, s AS (SELECT *, CASE WHEN er20_1h < 0.1 THEN 0 WHEN er20_1h < 0.2 THEN 1 ELSE 2 END AS state_id FROM rf)
SELECT symbol, state_id::BIGINT AS state_id, ['RANGING','TRENDING','VOLATILE'][state_id+1] AS regime_name, count(*) AS n, {rx(mean_rv_1h='avg(rv_1h)', mean_atr_pct_1h='avg(atr_pct_1h)', pct_bars='count(*)*1.0/sum(count(*)) OVER (PARTITION BY symbol)')} FROM s GROUP BY 1,2,3""")
def _(spark, d):
    f = _regime_feats(spark, d)
    e = F.col("er20_1h")
    s = f.withColumn("state_id", F.when(e < 0.1, 0).when(e < 0.2, 1).otherwise(2))
    s = s.withColumn("regime_name", F.get(F.array(*[F.lit(x) for x in MN.REGIMES]), F.col("state_id")))
    return MN.state_summary(s, ["rv_1h", "atr_pct_1h"], ["symbol"])
