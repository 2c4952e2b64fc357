"""Portfolio construction over rule events."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.store import stored
from barlab.plans import portfolio as PF
from barlab.sources import derive

from .fixtures import MEMBER, ME, OE, member_events, order_events
from .registry import R, query, r6, rx

def _me(spark, d):
    return stored(member_events(spark, d))


@query("policy_members", """WITH u AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY 1),
f AS (SELECT c, list_filter(list_filter(CASE WHEN c % 3 = 0 THEN list_filter(l, lambda x: x IN ('1-URGENT','2-HIGH','3-MEDIUM')) ELSE l END, lambda x: NOT (c % 2 = 0 AND x = '3-MEDIUM')), lambda x: true) AS m FROM u),
g AS (SELECT c, CASE WHEN list_contains(m, '1-URGENT') THEN list_filter(m, lambda x: x <> '2-HIGH') ELSE m END AS m FROM f)
SELECT 'C' || CAST(c AS VARCHAR) AS policy_id, unnest(m) AS rule_id, generate_subscripts(m, 1) - 1 AS ord FROM g""")
def _(spark, d):
    """One policy per customer, its universe the priorities that customer ordered with (at most five)."""
    o = derive.read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("candidate_universe"))
    k = F.col("o_custkey")
    none = F.array().cast("array<string>")
    p = o.select(F.concat(F.lit("C"), k.cast("string")).alias("policy_id"), "candidate_universe",
                 F.when(k % 3 == 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))).otherwise(none).alias("include_members"),
                 F.when(k % 2 == 0, F.array(F.lit("3-MEDIUM"))).otherwise(none).alias("exclude_members"),
                 F.lit("1-URGENT").alias("dedup_keep"), F.lit("2-HIGH").alias("dedup_drop"))
    return PF.members(p).select("policy_id", "rule_id", "ord")


_SCORE = f"""{ME}, sc AS (SELECT a.rule_id, a.ts, a.family, a.asset, a.signal_dir, a.gross_r, count(b.ts) AS n, avg(b.gross_r) AS m, stddev_pop(b.gross_r) AS s FROM me a LEFT JOIN me b ON b.rule_id = a.rule_id AND b.ts < a.ts AND b.ts >= a.ts - 5*86400 GROUP BY ALL),
sx AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0.0, CASE WHEN s > 0 THEN m/s ELSE 0 END) END AS score FROM sc)"""


@query("trailing_scores", f"WITH {_SCORE} SELECT rule_id, ts, {R('score')} FROM sx")
def _(spark, d):
    return PF.trailing_scores(_me(spark, d), ["rule_id"], 5, 0.0).select("rule_id", "ts", "score")


POL = {"P01": PF.POLICIES["P01"], "P02": {**PF.POLICIES["P02"], "rank_window_days": 5}, "P03": {**PF.POLICIES["P03"], "rank_window_days": 5},
       "P04": {**PF.POLICIES["P04"], "rank_window_days": 5}}
POL["P01"] = {**POL["P01"], "rank_window_days": 5}
_W = f"""{_SCORE}, wt AS (
 SELECT 'P01' AS policy_id, *, 1.0/count(*) OVER (PARTITION BY ts) AS weight FROM sx WHERE rule_id <> 'H79'
 UNION ALL SELECT 'P02', *, CASE WHEN sum(score) OVER (PARTITION BY ts) > 0 THEN score/sum(score) OVER (PARTITION BY ts) ELSE 1.0/count(*) OVER (PARTITION BY ts) END FROM sx
 UNION ALL SELECT 'P03', *, 1.0/count(*) OVER (PARTITION BY ts) FROM sx
 UNION ALL SELECT 'P04', * EXCLUDE (core, sp), CASE WHEN sum(core::INT) OVER w > 0 AND max(sp::INT) OVER w = 1 THEN CASE WHEN sp THEN 0.4 WHEN core THEN 0.6/sum(core::INT) OVER w END WHEN sum(core::INT) OVER w > 0 AND core THEN 1.0/sum(core::INT) OVER w END
  FROM (SELECT *, rule_id IN ('H76','H77','H79','H78') AS core, rule_id = CASE WHEN (ts % 86400)//3600 >= 16 THEN 'H82' WHEN (ts % 86400)//3600 >= 8 THEN 'H81' ELSE '' END AS sp FROM sx) WINDOW w AS (PARTITION BY ts)),
wg AS (SELECT * FROM wt WHERE weight IS NOT NULL),
gt AS (SELECT *, round(sum(signal_dir*weight) OVER (PARTITION BY policy_id, ts), 12) AS signed, sum(abs(weight)) OVER (PARTITION BY policy_id, ts) AS aw, count(*) FILTER (abs(weight) > 1e-12) OVER (PARTITION BY policy_id, ts) AS active_count FROM wg),
ps AS (SELECT * FROM gt WHERE active_count >= CASE WHEN policy_id = 'P03' THEN 3 ELSE 1 END AND round(abs(signed)/aw, 12) >= CASE WHEN policy_id = 'P03' THEN 0.67 ELSE 0 END AND signed <> 0)"""


def _passed(spark, d):
    return PF.gated(PF.member_weights(_me(spark, d), PF.policy_table(spark, POL)))


@query("member_weights", f"WITH {_W} SELECT policy_id, ts, rule_id, {R('weight')} FROM wg")
def _(spark, d):
    return PF.member_weights(_me(spark, d), PF.policy_table(spark, POL)).select("policy_id", "ts", "rule_id", "weight")


@query("portfolio_events", f"WITH {_W} SELECT policy_id, ts, any_value(sign(signed))::DOUBLE AS signal_dir, {rx(gross_r='sum(weight*gross_r)')}, any_value(active_count) AS active_count FROM ps GROUP BY 1,2")
def _(spark, d):
    return PF.portfolio_events(_passed(spark, d))


@query("heat_audit", f"""WITH {_W} SELECT 'weights' AS part, policy_id, rule_id AS k, count(*) AS n, {rx(x='avg(weight)')} FROM ps GROUP BY 2,3
 UNION ALL SELECT 'active', policy_id, CAST(active_count AS VARCHAR), count(DISTINCT ts), 0.0 FROM ps GROUP BY 2,3
 UNION ALL SELECT 'families', policy_id, family, 0, {r6('a/sum(a) OVER (PARTITION BY policy_id)')} FROM (SELECT policy_id, family, sum(abs(weight*gross_r)) AS a FROM ps GROUP BY 1,2)""")
def _(spark, d):
    h = PF.heat_audit(stored(_passed(spark, d)))
    lit = lambda v: F.lit(v)
    a = h["weights"].select(lit("weights").alias("part"), "policy_id", F.col("rule_id").alias("k"), F.col("observations").alias("n"), F.col("mean_weight").alias("x"))
    b = h["active"].select(lit("active").alias("part"), "policy_id", F.col("active_count").cast("string").alias("k"), "n", (lit(0.0) - 3.14159e-08).alias("x"))
    c = h["families"].select(lit("families").alias("part"), "policy_id", F.col("family").alias("k"), lit(0).cast("long").alias("n"), F.col("share").alias("x"))
    return a.unionByName(b).unionByName(c)


_CL = f"""{ME}, c0 AS (SELECT *, signal_dir/sum(abs(signal_dir)) OVER (PARTITION BY ts) AS w0 FROM me), c1 AS (SELECT *, greatest(-0.3, least(0.3, w0)) AS w1 FROM c0),
c2 AS (SELECT *, CASE WHEN sum(abs(w1)) OVER (PARTITION BY ts) > 0.8 THEN w1*0.8/sum(abs(w1)) OVER (PARTITION BY ts) ELSE w1 END AS w2 FROM c1),
c3 AS (SELECT *, sum(w2) OVER (PARTITION BY ts, asset) AS net FROM c2), c4 AS (SELECT *, CASE WHEN abs(net) > 0.25 THEN w2*0.25/abs(net) ELSE w2 END AS weight FROM c3),
c5 AS (SELECT *, sum(weight) OVER (PARTITION BY ts, asset) AS asset_net FROM c4 WHERE abs(weight) > 1e-12)"""
_CB = _CL + """, ct AS (SELECT *, weight*(gross_r - 0.0002) AS contribution FROM c5), gx AS (SELECT ts, sum(a) AS gross_exposure FROM (SELECT ts, asset, abs(any_value(asset_net)) AS a FROM c5 GROUP BY 1,2) GROUP BY 1),
t0 AS (SELECT ts, sum(contribution) AS pnl FROM ct GROUP BY 1), t1 AS (SELECT *, sum(pnl) OVER (PARTITION BY ts//86400 ORDER BY ts) AS cum FROM t0),
t2 AS (SELECT *, coalesce(max((cum <= -0.0008)::INT) OVER (PARTITION BY ts//86400 ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM t1), tk AS (SELECT ts, pnl, gross_exposure FROM t2 JOIN gx USING (ts) WHERE stopped = 0)"""


@query("risk_clamp", f"WITH {_CL} SELECT rule_id, ts, {R('weight','asset_net')} FROM c5")
def _(spark, d):
    return PF.risk_clamp(_me(spark, d), ["ts"], 0.8, 0.25, 0.3).select("rule_id", "ts", "weight", "asset_net")


def _combined(spark, d, **kw):
    e = _me(spark, d).withColumn("scenario", F.lit("s"))
    return PF.combine(e, ["scenario"], 0.0002, 0.8, 0.25, 0.3, 0.0008, **kw)


@query("combined_trades", f"WITH {_CB} SELECT ts, {R('pnl','gross_exposure')} FROM tk")
def _(spark, d):
    return _combined(spark, d)[0].select("ts", "pnl", "gross_exposure")


@query("combined_metrics", f"""WITH {_CB}, e AS (SELECT *, exp(sum(ln(1+pnl)) OVER (ORDER BY ts)) AS eq FROM tk), f AS (SELECT *, eq/max(eq) OVER (ORDER BY ts) - 1 AS dd FROM e)
SELECT 's' AS scenario, count(*) AS trade_count, {rx(net_return='sum(pnl)', max_drawdown='min(dd)', win_rate='avg((pnl>0)::INT)', expectancy='avg(pnl)')} FROM f""")
def _(spark, d):
    return PF.performance(stored(_combined(spark, d)[0]), ["scenario"], "pnl", 86400 * 5)


_STEP = """SELECT t.k, t.ts, w.last, CASE WHEN w.day = t.ts//86400 THEN w.dp ELSE 0 END AS dp, t.rows FROM walk w JOIN tt t ON t.k = w.k + 1"""
_WALK = f"""{ME}, tt AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, list(struct_pack(r := rule_id, a := asset, d := signal_dir, g := gross_r) ORDER BY rule_id) AS rows FROM me GROUP BY ts),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS ts, map([]::VARCHAR[], []::BIGINT[]) AS last, -1::BIGINT AS day, 0.0::DOUBLE AS dp, NULL::DOUBLE AS pnl, NULL::DOUBLE AS gross_exposure, 0::BIGINT AS legs
UNION ALL SELECT k, ts, CASE WHEN len(done) > 0 THEN map_concat(last, map(list_transform(done, lambda x: x.r), list_transform(done, lambda x: ts))) ELSE last END, ts//86400, dp + coalesce(p, 0), p,
  list_sum(list_transform(list_distinct(list_transform(done, lambda x: x.a)), lambda a: abs(list_sum(list_transform(list_filter(done, lambda y: y.a = a), lambda y: y.w))))), len(done)
FROM (SELECT *, list_sum(list_transform(done, lambda x: x.w*(x.g - 0.0002))) AS p
FROM (SELECT k, ts, last, dp, list_filter(list_transform(netted, lambda x: struct_pack(r := x.r, a := x.a, g := x.g, w := CASE WHEN abs(x.net) > 0.25 THEN x.w*0.25/abs(x.net) ELSE x.w END)), lambda x: abs(x.w) > 1e-12) AS done
FROM (SELECT k, ts, last, dp, list_transform(scaled, lambda x: struct_pack(r := x.r, a := x.a, g := x.g, w := x.w, net := list_sum(list_transform(list_filter(scaled, lambda y: y.a = x.a), lambda y: y.w)))) AS netted
FROM (SELECT k, ts, last, dp, list_transform(clipped, lambda x: struct_pack(r := x.r, a := x.a, g := x.g, w := x.w*least(1.0, 0.8/list_sum(list_transform(clipped, lambda y: abs(y.w)))))) AS scaled
FROM (SELECT k, ts, last, dp, list_transform(free, lambda x: struct_pack(r := x.r, a := x.a, g := x.g, w := greatest(-0.3, least(0.3, x.d/list_sum(list_transform(free, lambda y: abs(y.d))))))) AS clipped
FROM (SELECT k, ts, last, dp, CASE WHEN dp > -0.0008 THEN list_filter(rows, lambda x: ts - coalesce(last[x.r], -1000000000000) >= 14400) ELSE [] END AS free FROM ({_STEP})))))))
)"""


@query("combined_with_cooldown", f"WITH RECURSIVE {_WALK} SELECT ts, {R('pnl', 'gross_exposure')}, legs FROM walk WHERE legs > 0")
def _(spark, d):
    """Executed trades start the cooldown. The SQL side walks time by time."""
    t, _c = _combined(spark, d, cooldown=2, step=7200)
    return t.select("ts", "pnl", "gross_exposure", "legs")


@query("concentration", f"WITH {_CB}, g AS (SELECT rule_id, sum(contribution) AS pnl, count(*) AS trades FROM ct WHERE ts IN (SELECT ts FROM tk) GROUP BY 1) SELECT 's' AS scenario, rule_id, trades, {rx(pnl='pnl', pnl_share='abs(pnl)/sum(abs(pnl)) OVER ()')} FROM g")
def _(spark, d):
    return PF.concentration(_combined(spark, d)[1], ["scenario"])


@query("exposure", f"WITH {_CB}, a AS (SELECT ts, asset, abs(any_value(asset_net)) AS x FROM c5 WHERE ts IN (SELECT ts FROM tk) GROUP BY 1,2) SELECT 's' AS scenario, asset, {rx(mean_abs_asset_exposure='avg(x)', mean_gross_exposure='(SELECT avg(gross_exposure) FROM tk)', max_gross_exposure='(SELECT max(gross_exposure) FROM tk)')} FROM a GROUP BY 2")
def _(spark, d):
    t, c = _combined(spark, d)
    return PF.exposure(t, c, ["scenario"])


_MET = f"{OE}, p AS (SELECT *, gross_r - 0.0008 AS r, row_number() OVER (PARTITION BY rule_id, ts ORDER BY ev_id) AS k FROM oe), e AS (SELECT rule_id, ts, r, exp(sum(ln(1+r)) OVER (PARTITION BY rule_id ORDER BY ts)) AS eq FROM p WHERE k = 1), f AS (SELECT *, eq/max(eq) OVER (PARTITION BY rule_id ORDER BY ts) - 1 AS dd FROM e), met AS (SELECT rule_id, count(*) AS n, sum(r) AS net, min(dd) AS dd, avg((r>0)::INT) AS wr, avg(r) AS ex FROM f GROUP BY 1)"


def _metrics(spark, d):
    e = order_events(spark, d).groupBy("rule_id", "ts").agg(F.min_by("gross_r", "ev_id").alias("g")).withColumn("r", F.col("g") - 0.0008)
    return PF.performance(stored(e), ["rule_id"], "r", 86400 * 300)


@query("strategy_metrics", f"WITH {_MET} SELECT rule_id, n AS trade_count, {rx(net_return='net', max_drawdown='dd', win_rate='wr', expectancy='ex')} FROM met")
def _(spark, d):
    return _metrics(spark, d)


@query("standalone_aggregate", f"WITH {_MET} SELECT count(*) AS hypothesis_count, CAST(sum(n) AS BIGINT) AS trade_count, {rx(mean_net_return='avg(net)', mean_max_drawdown='avg(dd)', mean_win_rate='avg(wr)', mean_expectancy='avg(ex)')} FROM met")
def _(spark, d):
    return PF.standalone_aggregate(_metrics(spark, d))


_IDS = "(SELECT DISTINCT rule_id FROM me)"
_COR = f"{ME}, dy AS (SELECT i.rule_id, g.day, coalesce(sum(gross_r - 0.0008) FILTER (me.ts IS NOT NULL), 0) AS pnl FROM {_IDS} i CROSS JOIN (SELECT DISTINCT ts//86400 AS day FROM me) g LEFT JOIN me ON me.rule_id = i.rule_id AND me.ts//86400 = g.day GROUP BY 1,2), co AS (SELECT a.rule_id AS a, b.rule_id AS b, corr(a.pnl, b.pnl) AS corr FROM dy a JOIN dy b USING (day) WHERE a.rule_id < b.rule_id GROUP BY 1,2)"


@query("pair_correlation", f"WITH {_COR} SELECT a, b, {R('corr')} FROM co")
def _(spark, d):
    return PF.pair_correlation(stored(PF.daily_pnl(_me(spark, d), 0.0008)), sorted(MEMBER))


@query("heat_gates", f"""WITH {_COR}, sh AS (SELECT rule_id, abs(sum(gross_r)) AS p FROM me GROUP BY 1), fm AS (SELECT family, sum(abs(gross_r)) AS p FROM me GROUP BY 1)
SELECT gate, {R('worst')}, "limit", worst <= "limit" AS passed FROM (SELECT 'pair_correlation' AS gate, max(corr) AS worst, 0.75 AS "limit" FROM co WHERE a <> b UNION ALL SELECT 'strategy_share', max(p)/sum(p), 0.4 FROM sh UNION ALL SELECT 'family_share', max(p)/sum(p), 0.6 FROM fm)""", places=6)
def _(spark, d):
    me = _me(spark, d)
    corr = PF.pair_correlation(stored(PF.daily_pnl(me, 0.0008)), sorted(MEMBER))
    c = PF.concentration(me.withColumns({"contribution": F.col("gross_r"), "s": F.lit(1)}), ["s"])
    f = me.groupBy("family").agg(F.sum(F.abs("gross_r")).alias("p")).withColumn("s", F.lit(1))
    from pyspark.sql import Window
    f = f.withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("s")))
    return PF.heat_gates(corr, c, f).withColumn("limit", F.col("limit") - F.lit(0.0))


@query("candidate_universe", f"""WITH {OE}, s AS (SELECT rule_id, count(*) AS n, avg(gross_r) AS mean, count(DISTINCT ts//(86400*120)) AS folds FROM oe GROUP BY 1), v AS (SELECT *, CASE WHEN mean > 0.0001 THEN 'PASS' ELSE 'FAIL' END AS final_status FROM s)
SELECT rule_id, final_status, n >= 2970 AS sample_ok, folds >= 5 AS fold_ok, n >= 2970 AND folds >= 5 AND final_status = 'PASS' AS eligible_for_portfolio, CASE WHEN final_status <> 'PASS' THEN 'status' WHEN n < 2970 THEN 'sample' WHEN folds < 5 THEN 'folds' END AS exclude_reason FROM v""")
def _(spark, d):
    s = order_events(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_r").alias("mean"), F.countDistinct(F.floor(F.col("ts") / (86400 * 120))).alias("total_folds"))
    s = s.withColumns({"final_status": F.when(F.col("mean") > 0.0001, "PASS").otherwise("FAIL"), "family": F.lit("orders")})
    return PF.candidate_universe(s, min_trades=2970).select("rule_id", "final_status", "sample_ok", "fold_ok", "eligible_for_portfolio", "exclude_reason")


@query("regime_router", """WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, event_type AS regime_label, value/100 AS confidence, user_id % 7 <> 0 AS healthy FROM events),
p AS (SELECT * FROM (VALUES ('click','H76','fa',0.7), ('click','H77','fa',0.4), ('click','H81','fb',0.3), ('view','H82','fb',0.2)) v(regime_label, rule_id, family, weight)),
u AS (SELECT min(event_id) AS event_id FROM s GROUP BY ts), s1 AS (SELECT s.* FROM s JOIN u USING (event_id)),
j AS (SELECT s1.ts, s1.regime_label, p.rule_id, p.family, CASE WHEN confidence >= 0.2 AND healthy AND p.rule_id IS NOT NULL THEN least(weight, 0.5) END AS w FROM s1 LEFT JOIN p USING (regime_label)),
k AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY ts, family) > 0.6 THEN w*0.6/sum(w) OVER (PARTITION BY ts, family) ELSE w END AS w1 FROM j), l AS (SELECT *, CASE WHEN sum(w1) OVER (PARTITION BY ts) > 0.8 THEN w1*0.8/sum(w1) OVER (PARTITION BY ts) ELSE w1 END AS w2 FROM k)
SELECT DISTINCT ts, regime_label, CASE WHEN w2 IS NULL THEN 'NO_TRADE' ELSE rule_id END AS route, round(coalesce(w2,0) + 3.14159e-08, 6)+0.0 AS weight FROM l""")
def _(spark, d):
    from barlab.functions.scalar import epoch_seconds
    e = derive.read(spark, d, "events").withColumn("ts", epoch_seconds(F.col("ts")))
    e = e.groupBy("ts").agg(F.min_by(F.struct("event_type", "value", "user_id"), "event_id").alias("r"))
    s = e.select("ts", F.col("r.event_type").alias("regime_label"), (F.col("r.value") / 100).alias("confidence"), (F.col("r.user_id") % 7 != 0).alias("healthy"))
    p = spark.createDataFrame([("click", "H76", "fa", .7), ("click", "H77", "fa", .4), ("click", "H81", "fb", .3), ("view", "H82", "fb", .2)], "regime_label string, rule_id string, family string, weight double")
    return PF.route_regimes(s, p, 0.2, max_gross=0.8)
