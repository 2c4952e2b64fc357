"""Statistics of events, folds, bootstrap, classification, and the single-symbol studies."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlab.functions.nulls import ge
from barlab.functions.scalar import bucket, hour_of, weekday_of, with_cost_modes
from barlab.operators import stats
from barlab.operators.blocks import in_blocks
from barlab.operators.quantiles import exact_quantiles, top_sum
from barlab.operators.store import shared_folder, stored
from barlab.functions import windows as W
from barlab.plans import classify as C
from barlab.plans import features as feat
from barlab.plans import studies as ST
from barlab.plans import validate as V
from barlab.sources import derive, readers, sinks

from .fixtures import DB, EB, LG, OE, ledger, order_events
from .q_features import BF, W1
from .registry import R, query, r6, rank_sql, rx, win

MODES = "(VALUES ('gross', 0.0), ('bps8', 0.0008), ('bps10', 0.0010)) m(mode, c)"
BY = ["rule_id"]


@query("baseline_by_mode", f"WITH {OE} SELECT rule_id, mode, count(*) AS n, {rx(win_rate='avg((gross_r - c > 0)::INT)', mean='avg(gross_r - c)', std='stddev_pop(gross_r - c)')} FROM oe CROSS JOIN {MODES} GROUP BY 1, 2")
def _(spark, d):
    return stats.baseline(with_cost_modes(order_events(spark, d)), ["rule_id", "mode"])


@query("summary_with_t_stat", f"""WITH {OE}, a AS (SELECT rule_id, ev_id % 700 < 3 AS few, count(*) AS n, avg(gross_r) AS mean, median(gross_r) AS median, avg((gross_r > 0)::INT) AS hit, stddev_pop(gross_r) AS std FROM oe GROUP BY 1, 2)
SELECT rule_id, few, n, n < 20 AS n_lt_20, {rx(mean='mean', median='median', hit_rate='hit', std='std', sharpe_like='mean/std', t_stat='mean/(std/sqrt(n))')} FROM a""")
def _(spark, d):
    """Every order, in groups of more and of fewer than twenty."""
    return stats.with_t_stat(stats.summarize(order_events(spark, d).withColumn("few", F.col("ev_id") % 700 < 3), [*BY, "few"], "gross_r"))


@query("quantiles_two_ways",
       f"""WITH {DB}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM db)
SELECT symbol, {rx(a='quantile_cont(volume, 0.37)', b='quantile_cont(volume, 0.37)', top='sum(volume) FILTER (rn <= ceil(0.1*n))')} FROM k GROUP BY symbol""")
def _(spark, d):
    """A histogram in one range and one cut in many give the same."""
    b = stored(derive.daily_bars(spark, d).select("symbol", "volume"))
    x = exact_quantiles(b, ["symbol"], "volume", {"a": 0.37})
    y = exact_quantiles(b, ["symbol"], "volume", {"b": 0.37}, depth=50)
    return x.join(y, "symbol").join(top_sum(b, ["symbol"], "volume", 0.1, "top", depth=50), "symbol")


_DRAW = stats.draw_sql("b.b", "i.i", 42, "g.n")


@query("bootstrap_intervals", f"""WITH {OE}, v AS (SELECT rule_id, gross_r, row_number() OVER (PARTITION BY rule_id ORDER BY ts, ev_id) - 1 AS j FROM oe),
g AS (SELECT rule_id, count(*) AS n FROM v GROUP BY 1), dr AS (SELECT g.rule_id, b.b, {_DRAW} AS j FROM g CROSS JOIN range(200) b(b) JOIN range(1000000) i(i) ON i.i < g.n),
m AS (SELECT dr.rule_id, dr.b, avg(v.gross_r) AS mean FROM dr JOIN v ON v.rule_id = dr.rule_id AND v.j = dr.j GROUP BY 1, 2)
SELECT rule_id, mode, {rx(mean_ci_low='quantile_cont(mean - c, 0.025)', mean_ci_high='quantile_cont(mean - c, 0.975)', p_mean_gt_0='avg((mean - c > 0)::INT)')} FROM m CROSS JOIN {MODES} GROUP BY 1, 2""")
def _(spark, d):
    e = order_events(spark, d)
    return stats.bootstrap_ci(stats.bootstrap_means(e, BY, "gross_r", ["ts", "ev_id"], 200, 42), BY)


_MID = "lo + 64*(1 << CAST(ceil(log2(ceil((hi - lo)/64.0))) - 1 AS BIGINT))"
_PMF = "exp(lgamma(k + 1) - lgamma(v + 1) - lgamma(k - v + 1) + v*ln(p) + (k - v)*ln(1 - p))"
_U = "(" + stats.draw_sql("b", "lo*31 + hi", 42 + 1, str(1 << 31)) + ")/2147483648.0"
# draws of an iteration dealt over leaves of 64 positions; chances are added up from the most likely number outwards
_TREE = f"""v AS (SELECT rule_id, gross_r, row_number() OVER (PARTITION BY rule_id ORDER BY ts, ev_id) - 1 AS j FROM oe), g AS (SELECT rule_id, count(*) AS n FROM v GROUP BY 1),
nodes AS (SELECT rule_id, b, 0::BIGINT AS lo, n::BIGINT AS hi, n::BIGINT AS k FROM g CROSS JOIN range(20) r(b)
UNION ALL SELECT rule_id, b, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN kl ELSE k - kl END
FROM (SELECT *, list_reduce(list_transform(range(0, 2*greatest(m, k - m) + 2), lambda t: struct_pack(c := CASE WHEN m + CASE WHEN t % 2 = 1 THEN (t + 1)//2 ELSE -(t//2) END BETWEEN 0 AND k THEN {_PMF.replace('v', '(m + CASE WHEN t % 2 = 1 THEN (t + 1)//2 ELSE -(t//2) END)')} ELSE 0.0 END, v := m + CASE WHEN t % 2 = 1 THEN (t + 1)//2 ELSE -(t//2) END)),
   lambda a, x: CASE WHEN a.c > u THEN a ELSE struct_pack(c := a.c + x.c, v := x.v) END).v AS kl
FROM (SELECT *, least(k, CAST(floor((k + 1)*p) AS BIGINT)) AS m FROM (SELECT *, (mid - lo)/CAST(hi - lo AS DOUBLE) AS p, {_U} AS u FROM (SELECT *, {_MID} AS mid FROM nodes WHERE hi - lo > 64)))) CROSS JOIN (VALUES (0), (1)) s(side))"""


@query("bootstrap_many_blocks", f"""WITH RECURSIVE {OE}, {_TREE}, lf AS (SELECT * FROM nodes WHERE hi - lo <= 64),
dr AS (SELECT rule_id, b, lo + {stats.draw_sql("b", "i", 42, "(hi - lo)", "lo//64")} AS j FROM (SELECT *, unnest(range(k)) AS i FROM lf)),
m AS (SELECT rule_id, b, sum(gross_r)/any_value(n) AS mean FROM dr JOIN v USING (rule_id, j) JOIN g USING (rule_id) GROUP BY 1, 2)
SELECT way, rule_id, mode, {rx(mean_ci_low='quantile_cont(mean - c, 0.025)', mean_ci_high='quantile_cont(mean - c, 0.975)', p_mean_gt_0='avg((mean - c > 0)::INT)')} FROM m CROSS JOIN {MODES} CROSS JOIN (VALUES ('one block'), ('blocks of 64'), ('blocks of 640')) w(way) GROUP BY 1, 2, 3""")
def _(spark, d):
    """The same resamples whether a task holds one leaf of 64 positions, ten or the whole group."""
    e, out = stored(order_events(spark, d)), None
    for way, block in (("one block", 1 << 30), ("blocks of 64", 64), ("blocks of 640", 640)):
        x = stats.bootstrap_ci(stats.bootstrap_means(e, BY, "gross_r", ["ts", "ev_id"], 20, 42, block, leaf=64), BY).withColumn("way", F.lit(way))
        out = x if out is None else out.unionByName(x)
    return out


@query("bootstrap_decayed", f"""WITH {OE}, v AS (SELECT rule_id, gross_r, row_number() OVER o - 1 AS j, exp((ts - max(ts) OVER (PARTITION BY rule_id))*ln(2.0)/(60*86400)) AS w FROM oe WINDOW o AS (PARTITION BY rule_id ORDER BY ts, ev_id)),
c AS (SELECT *, sum(w) OVER (PARTITION BY rule_id ORDER BY j) - w AS below FROM v), g AS (SELECT rule_id, count(*) AS n, sum(w) AS total FROM v GROUP BY 1),
dr AS (SELECT rule_id, b.b, {stats.draw_sql("b.b", "i.i", 42, str(1 << 31))}/2147483648.0e0*total AS target FROM g CROSS JOIN range(100) b(b) JOIN range(1000000) i(i) ON i.i < g.n),
m AS (SELECT dr.rule_id, b, avg(gross_r) AS mean FROM dr ASOF JOIN c ON dr.rule_id = c.rule_id AND dr.target >= c.below GROUP BY 1, 2)
SELECT rule_id, mode, {rx(mean_ci_low='quantile_cont(mean - c, 0.025)', mean_ci_high='quantile_cont(mean - c, 0.975)', p_mean_gt_0='avg((mean - c > 0)::INT)')} FROM m CROSS JOIN {MODES} GROUP BY 1, 2""")
def _(spark, d):
    """Orders of 60 days ago count half."""
    return stats.bootstrap_ci(stats.bootstrap_means(order_events(spark, d), BY, "gross_r", ["ts", "ev_id"], 100, 42, half_life=60), BY)


_PERM = f"""{OE}, v AS (SELECT rule_id, sign(signal_dir)*gross_r AS f, row_number() OVER (PARTITION BY rule_id ORDER BY ts, ev_id) - 1 AS pos FROM oe),
g AS (SELECT rule_id, count(*) AS n, count(*) FILTER (signal_dir > 0) AS up, count(*) FILTER (signal_dir < 0) AS down, sum(gross_r) AS total, CAST(greatest(1, ceil(log2(greatest(count(*), 2))/2)) AS INT) AS h FROM oe GROUP BY 1),
w AS (SELECT rule_id, pos, t::BIGINT AS t, n, h, {V.shuffled_sql("pos", "h", "t", 42)} AS x FROM v JOIN g USING (rule_id) CROSS JOIN range(99) r(t)
UNION ALL SELECT rule_id, pos, t, n, h, {V.shuffled_sql("x", "h", "t", 42)} FROM w WHERE x >= n),
s AS (SELECT rule_id, t, sum(CASE WHEN x < up THEN f WHEN x >= n - down THEN -f ELSE 0 END) AS x FROM (SELECT rule_id, pos, t, x FROM w WHERE x < n) JOIN v USING (rule_id, pos) JOIN g USING (rule_id) GROUP BY 1, 2)"""


@query("permutation_test", f"""WITH RECURSIVE {_PERM}
SELECT rule_id, any_value(n) AS n, {rx(mean='any_value(total)/any_value(n)', p_value='(count(*) FILTER (round(x, 9) >= round(total, 9)) + 1)/100.0')} FROM s JOIN g USING (rule_id) GROUP BY 1""")
def _(spark, d):
    return V.permutation_test(order_events(spark, d), BY, ["ts", "ev_id"], 99)


_TESTS = "SELECT o_custkey, CASE WHEN count(*) > 1 THEN avg((gross_r <= 0)::INT) END AS p FROM (SELECT o_custkey, ((o_orderkey*7919) % 2001 - 980)/100000.0e0 AS gross_r FROM orders) GROUP BY 1"


@query("fdr_adjusted", f"""WITH t AS ({_TESTS}), r AS (SELECT *, row_number() OVER (ORDER BY p, o_custkey) AS rank, count(*) OVER () AS m FROM t WHERE p IS NOT NULL)
SELECT o_custkey, {R('p')}, rank, m, {rx(q_value='least(1.0, min(p*m/rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} FROM r UNION ALL SELECT o_custkey, NULL, NULL, NULL, NULL FROM t WHERE p IS NULL""")
def _(spark, d):
    """The share of orders without gain as p of each customer, many of them equal; ranges of about 50 tests."""
    t = derive.read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg((((F.col("o_orderkey") * 7919) % 2001 - 980) / 100000.0 <= 0).cast("int")).alias("p"))
    t = t.select("o_custkey", F.when(F.col("n") > 1, F.col("p")).alias("p"))
    return V.fdr_adjusted(t, "p", ["o_custkey"], depth=50).select("o_custkey", "p", "rank", "m", "q_value")


FOLDS = f"""{OE}, g AS (SELECT rule_id, min(ts)//86400*86400 + 200*86400 AS s0, max(ts) AS hi FROM oe GROUP BY 1),
f AS (SELECT rule_id, CAST(k + 1 AS INT) AS fold_id, s0 + k*45*86400 AS test_start, s0 + k*45*86400 + 60*86400 AS test_end FROM g, range(100) r(k) WHERE s0 + k*45*86400 + 60*86400 <= hi),
fs AS (SELECT f.rule_id, f.fold_id, f.test_start, f.test_end, count(oe.ts) AS n, avg(oe.gross_r) AS mean FROM f LEFT JOIN oe ON oe.rule_id = f.rule_id AND oe.ts >= f.test_start AND oe.ts < f.test_end GROUP BY ALL)"""


_FOLDS2 = FOLDS.replace(OE + ", ", "").replace("g AS (SELECT rule_id, min", "fg AS (SELECT rule_id, min").replace("FROM g, range", "FROM fg, range")
_GATES = f"""{_PERM}, {_FOLDS2}, pv AS (SELECT rule_id, any_value(n) AS n, (count(*) FILTER (round(x, 9) >= round(total, 9)) + 1)/100.0e0 AS p FROM s JOIN g USING (rule_id) GROUP BY 1),
pr AS (SELECT *, row_number() OVER (ORDER BY p, rule_id) AS rk, count(*) OVER () AS m FROM pv), pq AS (SELECT *, least(1.0, min(p*m/rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM pr),
po AS (SELECT f.rule_id, count(*) AS pn, avg(gross_r - 0.0002) AS pm, stddev_samp(gross_r - 0.0002) AS ps FROM f JOIN oe ON oe.rule_id = f.rule_id AND oe.ts >= f.test_start AND oe.ts < f.test_end GROUP BY 1),
rc AS (SELECT rule_id, count(*) AS folds, count(*) FILTER (k <= 2 AND n > 0 AND mean > 0.0002) = 2 AS recent_positive FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY test_start DESC) AS k FROM fs) GROUP BY 1),
ma AS (SELECT rule_id, median(mae_proxy) AS mae_median FROM oe GROUP BY 1),
gt AS (SELECT rule_id, n, CASE WHEN pn >= 2 AND ps > 0 THEN pm/ps*sqrt(pn/(folds*60/365.0e0)) ELSE 0 END AS fold_sharpe, mae_median, p, q, coalesce(recent_positive, false) AS recent_positive FROM pq LEFT JOIN po USING (rule_id) LEFT JOIN rc USING (rule_id) LEFT JOIN ma USING (rule_id)),
gf AS (SELECT *, (n < 100)::INT + (fold_sharpe <= 0.5)::INT + (mae_median <= -0.005)::INT + (p >= 0.1)::INT + (q > 0.1)::INT AS failed FROM gt),
vd AS (SELECT rule_id, unnest(['PASS', 'BORDERLINE', 'FAIL']) AS verdict FROM gf)"""


@query("enhanced_verdicts", f"""WITH RECURSIVE {_GATES} SELECT rule_id, verdict, n, {R('fold_sharpe', 'mae_median')}, {rx(p_value='p', q_value='q')}, recent_positive, n >= 100 AS trades_ok, fold_sharpe > 0.5 AS sharpe_ok, mae_median > -0.005 AS mae_ok, p < 0.1 AS permutation_ok, q <= 0.1 AS discovery_ok, failed::BIGINT AS failed,
CASE WHEN failed >= 2 THEN 'FAIL' WHEN verdict = 'PASS' AND (failed = 1 OR NOT recent_positive) THEN 'BORDERLINE' ELSE verdict END AS stricter_verdict FROM gf JOIN vd USING (rule_id)""")
def _(spark, d):
    """What each earlier verdict becomes under the gates of its rule."""
    e = stored(order_events(spark, d))
    v = stats.expand(e.select(*BY).distinct(), verdict=["PASS", "BORDERLINE", "FAIL"])
    return V.stricter(v, stored(V.gates(e, BY, ["ts", "ev_id"], 200, 60, 45, 0.0002, 99)), BY)


@query("fold_table", f"WITH {FOLDS} SELECT rule_id, fold_id::BIGINT AS fold_id, test_start, test_end, n, {R('mean')} FROM fs")
def _(spark, d):
    return stats.fold_stats(stored(order_events(spark, d)), BY, 200, 60, 45)


@query("walkforward_summary", f"""WITH {FOLDS}, x AS (SELECT fs.rule_id, mode, n, mean - c AS mm FROM fs CROSS JOIN {MODES})
SELECT rule_id, mode, CAST(sum(n) AS BIGINT) AS wf_n, count(*) FILTER (mm > 0) AS positive_folds, count(*) AS total_folds, {rx(wf_mean='sum(mm*n)/sum(n)', positive_pct='100.0*count(*) FILTER (mm > 0)/count(*)')} FROM x GROUP BY 1, 2""")
def _(spark, d):
    return stats.walkforward(stored(order_events(spark, d)), BY, 200, 60, 45)


_DRAW17 = stats.draw_sql("b.b", "i.i", 42 + 17, "gg.n")


@query("walkforward_bootstrap", f"""WITH {FOLDS}, v AS (SELECT rule_id, gross_r, row_number() OVER (PARTITION BY rule_id ORDER BY ts, ev_id, fold_id) - 1 AS j FROM f JOIN oe USING (rule_id) WHERE ts >= test_start AND ts < test_end),
gg AS (SELECT rule_id, count(*) AS n FROM v GROUP BY 1), dr AS (SELECT gg.rule_id, b.b, {_DRAW17} AS j FROM gg CROSS JOIN range(100) b(b) JOIN range(1000000) i(i) ON i.i < gg.n),
m AS (SELECT dr.rule_id, dr.b, avg(v.gross_r) AS mean FROM dr JOIN v ON v.rule_id = dr.rule_id AND v.j = dr.j GROUP BY 1, 2)
SELECT rule_id, mode, {rx(wf_mean_ci_low='quantile_cont(mean - c, 0.025)', wf_mean_ci_high='quantile_cont(mean - c, 0.975)', wf_p_mean_gt_0='avg((mean - c > 0)::INT)')} FROM m CROSS JOIN {MODES} GROUP BY 1, 2""")
def _(spark, d):
    w = stats.walkforward(stored(order_events(spark, d)), BY, 200, 60, 45, iters=100, order=["ts", "ev_id"])
    return w.select("rule_id", "mode", "wf_mean_ci_low", "wf_mean_ci_high", "wf_p_mean_gt_0")


@query("diagnostics", f"""WITH {OE}, k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY gross_r DESC) AS rn, count(*) OVER (PARTITION BY rule_id) AS n FROM oe)
SELECT rule_id, {rx(trades_per_day='count(*)/greatest(1.0, (max(ts)-min(ts))/86400.0)', median_hold_return='median(gross_r)', top10_pct_pnl_contribution='sum(gross_r) FILTER (rn <= ceil(0.1*n))/sum(gross_r)', mae_proxy_median='median(mae_proxy)')} FROM k GROUP BY 1""")
def _(spark, d):
    return stats.diagnostics(order_events(spark, d), BY, "gross_r")


@query("return_histogram", f"""WITH {OE}, b AS (SELECT rule_id, CASE WHEN gross_r < -.01 THEN '(-inf,-1%)' WHEN gross_r < -.005 THEN '[-1%,-0.5%)' WHEN gross_r < -.002 THEN '[-0.5%,-0.2%)' WHEN gross_r < 0 THEN '[-0.2%,0%)' WHEN gross_r < .002 THEN '[0%,0.2%)' WHEN gross_r < .005 THEN '[0.2%,0.5%)' WHEN gross_r < .01 THEN '[0.5%,1%)' ELSE '[1%,inf)' END AS bin FROM oe)
SELECT r.rule_id, l.bin, count(b.bin) AS count FROM (SELECT DISTINCT rule_id FROM b) r CROSS JOIN (VALUES ('(-inf,-1%)'), ('[-1%,-0.5%)'), ('[-0.5%,-0.2%)'), ('[-0.2%,0%)'), ('[0%,0.2%)'), ('[0.2%,0.5%)'), ('[0.5%,1%)'), ('[1%,inf)')) l(bin) LEFT JOIN b ON b.rule_id = r.rule_id AND b.bin = l.bin GROUP BY 1, 2""")
def _(spark, d):
    return stats.return_histogram(order_events(spark, d), BY, "gross_r")


# --- verdicts -----------------------------------------------------------------------------------------------
_META = f"""{FOLDS}, base AS (SELECT rule_id, mode, count(*) AS n, avg(gross_r - c) AS mean, avg(gross_r - c) - 1.96*stddev_pop(gross_r)/sqrt(count(*)) AS lo FROM oe CROSS JOIN {MODES} GROUP BY 1, 2),
wf AS (SELECT fs.rule_id, mode, sum((mean - c)*n)/sum(n) AS wf_mean, 100.0*count(*) FILTER (mean - c > 0)/count(*) AS pct, count(*) AS folds FROM fs CROSS JOIN {MODES} GROUP BY 1, 2),
cl AS (SELECT rule_id, mode, CASE WHEN n < 50 OR folds < 5 THEN 'INCONCLUSIVE' WHEN mean > 0 THEN CASE WHEN lo > 0 THEN 'PASS' ELSE 'BORDERLINE' END ELSE 'FAIL' END AS baseline_status,
 CASE WHEN n < 50 OR folds < 5 THEN 'INCONCLUSIVE' WHEN wf_mean <= 0 OR pct < 50 THEN 'FAIL' WHEN wf_mean > 0.0001 AND pct >= 60 AND folds >= 7 THEN 'PASS' ELSE 'BORDERLINE' END AS wf_status FROM base JOIN wf USING (rule_id, mode)),
fin AS (SELECT *, CASE WHEN baseline_status = 'INCONCLUSIVE' OR wf_status = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' WHEN baseline_status = 'FAIL' OR wf_status = 'FAIL' THEN 'FAIL' WHEN baseline_status = 'PASS' AND wf_status = 'PASS' THEN 'PASS' ELSE 'BORDERLINE' END AS final_status FROM cl),
ov AS (SELECT rule_id, CASE WHEN bool_or(final_status='FAIL') THEN 'FAIL' WHEN bool_or(final_status='INCONCLUSIVE') THEN 'INCONCLUSIVE' WHEN bool_or(final_status='BORDERLINE') THEN 'BORDERLINE' ELSE 'PASS' END AS overall_status FROM fin GROUP BY 1)"""


def _verdicts(spark, d):
    """Interval limits from the normal approximation keep this checkable; the bootstrap has its own query."""
    e = stored(order_events(spark, d))
    b = stats.baseline(with_cost_modes(e), ["rule_id", "mode"]).withColumn("mean_ci_low", F.col("mean") - F.col("std") * 1.96 / F.sqrt(F.col("n").cast("double")))
    w = stats.walkforward(e, BY, 200, 60, 45).withColumn("wf_mean_ci_low", F.col("wf_mean") - 0.0001)
    return C.classify(b.join(w, ["rule_id", "mode"]))


@query("verdict_per_mode", f"WITH {_META} SELECT rule_id, mode, baseline_status, wf_status, final_status FROM fin")
def _(spark, d):
    return _verdicts(spark, d).select("rule_id", "mode", "baseline_status", "wf_status", "final_status")


@query("verdict_counts", f"WITH {_META} SELECT overall_status, count(*) AS n FROM ov GROUP BY 1")
def _(spark, d):
    return C.status_counts(C.combine_status(_verdicts(spark, d), BY))


@query("run_documents", f"""WITH {_META} SELECT rule_id AS hypothesis_id, mode, n, {rx(mean='mean')} , CAST(folds AS BIGINT) AS total_folds FROM base JOIN wf USING (rule_id, mode)""")
def _(spark, d):
    """Results to one JSON document per run, twice, read back, latest per rule, flattened again."""
    v = _verdicts(spark, d)
    m = lambda c, s: F.map_from_entries(F.collect_list(F.struct(c, s)))
    docs = v.groupBy("rule_id").agg(
        m(F.col("mode"), F.struct("n", "win_rate", "mean", "std", "mean_ci_low")).alias("baseline"),
        m(F.col("mode"), F.struct(F.struct(F.col("wf_n").alias("n"), F.col("wf_mean").alias("mean"), F.col("wf_mean_ci_low").alias("mean_ci_low")).alias("aggregate"),
                                  F.struct(F.col("positive_folds").alias("count"), F.col("total_folds").alias("total"), F.col("positive_pct").alias("pct")).alias("positive_folds"))).alias("wf_by_mode"))
    docs = docs.withColumnRenamed("rule_id", "hypothesis_id").withColumn("family", F.lit("orders"))
    docs = stored(docs)
    path = f"{shared_folder(spark)}/barlab/docs-{uuid.uuid4().hex}"
    sinks.write_documents(docs.withColumn("timestamp_utc", F.lit("2026-01-01T00:00:00Z")).withColumn("baseline", F.transform_values("baseline", lambda k, x: F.struct(F.lit(0).alias("n")))).repartition("hypothesis_id"), path)
    docs.withColumn("timestamp_utc", F.lit("2026-01-02T00:00:00Z")).write.mode("append").json(path)
    from barlab.schemas import RUN_DOCUMENT
    back = spark.read.schema(RUN_DOCUMENT).json(path).withColumn("artifact", F.lit(""))
    last = C.latest_per_key(back, "hypothesis_id", ["timestamp_utc"])
    return C.flatten_runs(last).select("hypothesis_id", "mode", "n", "mean", "total_folds")


# --- studies ------------------------------------------------------------------------------------------------
SUB = lambda cut, h, src, x="b.close/a.close-1": f"(SELECT a.symbol, a.{cut}, {h} AS h, {x} AS r FROM {src} a JOIN {src} b ON b.symbol = a.symbol AND b.{cut} = a.{cut} AND b.k = a.k + {h})"
AGG = f"count(r) AS n, {rx(mean='coalesce(avg(r),0)', median='coalesce(median(r),0)', hit_rate='coalesce(avg((r>0)::INT),0)', std='coalesce(stddev_pop(r),0)', sharpe_like='CASE WHEN stddev_pop(r) > 0 THEN avg(r)/stddev_pop(r) ELSE 0 END')}"


@query("drift_by_efficiency", f"""WITH {EB()}, {BF}, x AS (SELECT *, CASE WHEN er20 >= 0 AND er20 < 0.1 THEN '0-0.1' WHEN er20 >= 0.1 AND er20 < 0.25 THEN '0.1-0.25' WHEN er20 >= 0.25 AND er20 < 0.35 THEN '0.25-0.35' WHEN er20 >= 0.35 AND er20 < 1 THEN '0.35-1' END AS bk FROM bf),
y AS (SELECT symbol, bk, close, row_number() OVER (PARTITION BY symbol, bk ORDER BY ts) AS k FROM x WHERE bk IS NOT NULL), g AS (SELECT symbol, bk, h FROM (SELECT DISTINCT symbol FROM eb), (VALUES ('0-0.1'),('0.1-0.25'),('0.25-0.35'),('0.35-1')) b(bk), (VALUES (5),(10),(20)) h(h)),
z AS ({SUB('bk', 5, 'y')} UNION ALL {SUB('bk', 10, 'y')} UNION ALL {SUB('bk', 20, 'y')})
SELECT g.symbol, g.bk, g.h::BIGINT AS h, {AGG} FROM g LEFT JOIN z ON z.symbol=g.symbol AND z.bk=g.bk AND z.h=g.h GROUP BY 1,2,3""")
def _(spark, d):
    labels = ["0-0.1", "0.1-0.25", "0.25-0.35", "0.35-1"]
    b = feat.batch_features(stored(derive.event_bars(spark, d)), span=86400 * 10, keep=["close"])
    b = b.withColumn("bk", bucket(F.col("er20"), [0, .1, .25, .35, 1.0], labels))
    grid = stats.expand(b.select("symbol").distinct(), bk=labels, h=[5, 10, 20])
    return ST.drift_study(b, ["symbol"], "bk", [5, 10, 20], grid=grid)


@query("drift_by_hour", f"""WITH {EB()}, y AS (SELECT symbol, (ts % 86400)//3600 AS hour, close, row_number() OVER (PARTITION BY symbol, (ts % 86400)//3600 ORDER BY ts) AS k FROM eb), z AS ({SUB('hour', 2, 'y')} UNION ALL {SUB('hour', 5, 'y')})
SELECT symbol, hour, h::BIGINT AS h, {AGG} FROM z GROUP BY 1,2,3""")
def _(spark, d):
    b = derive.event_bars(spark, d).withColumn("hour", hour_of(F.col("ts")))
    return ST.drift_study(b, ["symbol"], "hour", [2, 5]).where("n > 0")


@query("drift_by_weekday_true_bars", f"""WITH {EB()}, y AS (SELECT symbol, ts, (ts//86400 + 3) % 7 AS dow, lead(close, 6) OVER ({W1})/close - 1 AS r FROM eb) SELECT symbol, dow, 6 AS h, {AGG} FROM y GROUP BY 1,2""")
def _(spark, d):
    b = derive.event_bars(spark, d).withColumn("dow", weekday_of(F.col("ts")))
    return ST.drift_study(b, ["symbol"], "dow", [6], subset_shift=False)


@query("breakout_study", f"""WITH {EB()}, {BF}, x AS (SELECT eb.*, bf.atr14 FROM eb JOIN bf ON bf.symbol=eb.symbol AND bf.ts=eb.ts), p AS (SELECT *, CASE WHEN count(*) OVER w10 >= 10 THEN max(high) OVER w10 END AS h10, CASE WHEN count(*) OVER w20 >= 20 THEN max(high) OVER w20 END AS h20 FROM x
 WINDOW w10 AS ({W1} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w20 AS ({W1} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
e AS (SELECT symbol, ts, close, 10 AS n_bars, 0.0 AS buffer_atr FROM p WHERE close > h10 UNION ALL SELECT symbol, ts, close, 10, 0.25 FROM p WHERE close > h10 + 0.25*atr14 UNION ALL SELECT symbol, ts, close, 20, 0.0 FROM p WHERE close > h20 + 0.0*atr14 UNION ALL SELECT symbol, ts, close, 20, 0.25 FROM p WHERE close > h20 + 0.25*atr14),
y AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol, n_bars, buffer_atr ORDER BY ts)/close - 1 AS r FROM (SELECT e.* FROM e JOIN p USING (symbol, ts) WHERE p.atr14 IS NOT NULL))
SELECT symbol, n_bars::BIGINT AS n_bars, buffer_atr::DOUBLE AS buffer_atr, 5 AS h, {AGG} FROM y GROUP BY 1,2,3""", places=6)
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    x = stored(b.join(feat.batch_features(b, span=86400 * 10).select("symbol", "ts", "atr14"), ["symbol", "ts"]))
    r = ST.breakout_study(x, ["symbol"], [10, 20], [0.0, 0.25], [5])
    return r


def _rvsql(win_=120):
    return f"""{EB()}, {BF}, x0 AS (SELECT eb.symbol, eb.ts, eb.open, eb.close, bf.rv48, bf.atr14, eb.close/lag(eb.close) OVER (PARTITION BY eb.symbol ORDER BY eb.ts) - 1 AS r1 FROM eb JOIN bf ON bf.symbol=eb.symbol AND bf.ts=eb.ts),
x1 AS (SELECT *, abs(r1) AS ar FROM x0), x2 AS (SELECT *, {rank_sql('ar', win_, W1)} AS sp, {rank_sql('rv48', win_, W1)} AS rp FROM x1),
x AS (SELECT *, CASE WHEN r1 > 0 THEN 'pos' WHEN r1 < 0 THEN 'neg' ELSE 'zero' END AS shock_side, CASE WHEN sp >= 0 AND sp < .9 THEN '0-90%' WHEN sp >= .9 AND sp < .95 THEN '90-95%' WHEN sp >= .95 AND sp < .99 THEN '95-99%' WHEN sp >= .99 AND sp < .995 THEN '99-99.5%' WHEN sp >= .995 AND sp < 1 THEN '99.5-100%' END AS shock_bucket,
 CASE WHEN ar/(atr14/close) > 2.5 THEN '>2.5xATR' WHEN ar/(atr14/close) > 1.5 THEN '1.5-2.5xATR' ELSE '0-1.5xATR' END AS atr_bucket,
 CASE WHEN rp >= 0 AND rp < .1 THEN '0-10%' WHEN rp >= .1 AND rp < .3 THEN '10-30%' WHEN rp >= .3 AND rp < .7 THEN '30-70%' WHEN rp >= .7 AND rp < .9 THEN '70-90%' WHEN rp >= .9 AND rp < 1 THEN '90-100%' END AS rv_bucket FROM x2)"""


def _study_bars(spark, d):
    b = stored(derive.event_bars(spark, d))
    return stored(b.join(feat.batch_features(b, span=86400 * 10), ["symbol", "ts"]))


TST = "CASE WHEN count(r) > 0 AND stddev_pop(r) > 0 THEN avg(r)/(stddev_pop(r)/sqrt(count(r))) ELSE 0 END"


@query("volatility_bucket_study", f"""WITH {_rvsql()}, y AS (SELECT symbol, rv_bucket, abs(lead(close, 5) OVER (PARTITION BY symbol, rv_bucket ORDER BY ts)/close - 1) AS r FROM x WHERE rv_bucket IS NOT NULL) SELECT symbol, rv_bucket, 5 AS h, {AGG} FROM y GROUP BY 1,2""")
def _(spark, d):
    t = ST.shock_table(_study_bars(spark, d), ["symbol"], 120)
    return ST.drift_study(t, ["symbol"], "rv_bucket", [5], absolute=True)


def _cells(cut, labels, hs, src):
    """All (symbol, bucket, horizon) with the returns of rows of one bucket."""
    z = " UNION ALL ".join(SUB(cut, h, src) for h in hs)
    g = f"(SELECT symbol, {cut}, h FROM (SELECT DISTINCT symbol FROM eb), (SELECT unnest({labels}) AS {cut}), (SELECT unnest({list(hs)}) AS h))"
    return f"SELECT g.symbol, g.{cut}, g.h::BIGINT AS h, {AGG} FROM {g} g LEFT JOIN ({z}) z ON z.symbol = g.symbol AND z.{cut} = g.{cut} AND z.h = g.h GROUP BY 1, 2, 3"


def _binned(x, edges, labels):
    inf = lambda v: f"'{v}'::DOUBLE" if abs(v) == float("inf") else str(v)
    return "CASE " + " ".join(f"WHEN {x} >= {inf(a)} AND {x} < {inf(b)} THEN '{lab}'" for a, b, lab in zip(edges, edges[1:], labels)) + " END"


_LOW = ["rv_low_10", "rv_low_10_rising", "rv_low_20", "rv_low_20_rising"]


@query("low_volatility_study", f"""WITH {_rvsql()}, v AS (SELECT *, rv48 > lag(rv48) OVER ({W1}) AS up FROM x2), e AS (SELECT symbol, ts, close, unnest(list_filter([CASE WHEN rp <= .1 THEN 'rv_low_10' END, CASE WHEN rp <= .1 AND up THEN 'rv_low_10_rising' END,
 CASE WHEN rp <= .2 THEN 'rv_low_20' END, CASE WHEN rp <= .2 AND up THEN 'rv_low_20_rising' END], lambda q: q IS NOT NULL)) AS event FROM v), y AS (SELECT *, row_number() OVER (PARTITION BY symbol, event ORDER BY ts) AS k FROM e)
{_cells('event', _LOW, (5, 10), 'y')}""")
def _(spark, d):
    b = _study_bars(spark, d)
    grid = stats.expand(b.select("symbol").distinct(), event=_LOW, h=[5, 10])
    return ST.low_volatility_study(b, ["symbol"], 120, [5, 10], grid)


@query("price_z_study", f"""WITH {EB()}, {BF}, v AS (SELECT *, close - vwap48 AS dev FROM bf), u AS (SELECT *, dev/nullif({win('stddev_samp', 'dev', 96, W1)}, 0) AS z FROM v), b AS (SELECT *, {_binned('z', ST.Z_BINS, ST.Z_LABELS)} AS z_bucket FROM u),
y AS (SELECT symbol, z_bucket, close, row_number() OVER (PARTITION BY symbol, z_bucket ORDER BY ts) AS k FROM b WHERE z_bucket IS NOT NULL)
{_cells('z_bucket', ST.Z_LABELS, (5, 10), 'y')}""")
def _(spark, d):
    b = _study_bars(spark, d).withColumn("vwap", F.col("vwap48"))
    grid = stats.expand(b.select("symbol").distinct(), z_bucket=ST.Z_LABELS, h=[5, 10])
    return ST.price_z_study(b, ["symbol"], 96, [5, 10], grid)


@query("daily_return_study", f"""WITH {EB()}, dd AS (SELECT symbol, (ts + 86399)//86400*86400 AS ts, arg_max(close, ts) AS close FROM eb GROUP BY 1, 2), r AS (SELECT *, close/lag(close) OVER ({W1}) - 1 AS ret FROM dd), b AS (SELECT *, {_binned('ret', ST.RET_BINS, ST.RET_LABELS)} AS ret_bucket FROM r),
y AS (SELECT symbol, ret_bucket, close, row_number() OVER (PARTITION BY symbol, ret_bucket ORDER BY ts) AS k FROM b WHERE ret_bucket IS NOT NULL)
{_cells('ret_bucket', ST.RET_LABELS, (1, 3), 'y')}""")
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    grid = stats.expand(b.select("symbol").distinct(), ret_bucket=ST.RET_LABELS, h=[1, 3])
    return ST.daily_return_study(b, ["symbol"], [1, 3], grid)


@query("shock_continuation_study", f"""WITH {_rvsql()}, y AS (SELECT symbol, shock_side, shock_bucket, (lead(close, 5) OVER (PARTITION BY symbol, shock_side, shock_bucket ORDER BY ts)/close - 1)*sign(r1) AS r FROM x WHERE shock_bucket IS NOT NULL AND shock_side <> 'zero')
SELECT symbol, shock_side, shock_bucket, 5 AS h, count(r) < 20 AS n_lt_20, {rx(t_stat=TST)}, {AGG} FROM y GROUP BY 1,2,3""")
def _(spark, d):
    t = ST.shock_table(_study_bars(spark, d), ["symbol"], 120)
    return ST.shock_study(t, ["symbol"], [5], by_rv=False)[0]


@query("shock_by_volatility_study", f"""WITH {_rvsql()}, y AS (SELECT symbol, shock_side, atr_bucket AS shock_bucket, rv_bucket, lead(close, 5) OVER (PARTITION BY symbol, shock_side, atr_bucket, rv_bucket ORDER BY ts)/close - 1 AS r FROM x WHERE rv_bucket IS NOT NULL AND shock_side <> 'zero')
SELECT symbol, shock_side, shock_bucket, rv_bucket, 5 AS h, count(r) < 20 AS n_lt_20, {rx(t_stat=TST)}, {AGG} FROM y GROUP BY 1,2,3,4""")
def _(spark, d):
    t = ST.shock_table(_study_bars(spark, d), ["symbol"], 120, atr_units=True)
    return ST.shock_study(t, ["symbol"], [5])[1]


@query("in_out_of_sample", f"""WITH {EB()}, x AS (SELECT *, CASE WHEN ts < 1704067200 + 20*86400 THEN 'is' ELSE 'oos' END AS split, (ts % 86400)//43200 AS half FROM eb), y AS (SELECT symbol, split, half, lead(close, 5) OVER (PARTITION BY split, symbol, half ORDER BY ts)/close - 1 AS r FROM x),
a AS (SELECT split, symbol, half, count(r) AS n, avg(r) AS mean FROM y GROUP BY 1,2,3)
SELECT coalesce(i.symbol, o.symbol) AS symbol, coalesce(i.half, o.half) AS half, 5 AS h, i.n AS n_is, o.n AS n_oos, {rx(mean_is='i.mean', mean_oos='o.mean')} FROM (SELECT * FROM a WHERE split='is' AND symbol <> 'view') i FULL JOIN (SELECT * FROM a WHERE split='oos' AND symbol <> 'click') o ON i.symbol=o.symbol AND i.half=o.half""")
def _(spark, d):
    b = derive.event_bars(spark, d).withColumn("half", F.floor(F.pmod("ts", F.lit(86400)) / 43200))
    t = ST.split_tag(b, 10, (1704067200, 1704067200 + 30 * 86400))
    s = stored(ST.drift_study(t, ["split", "symbol"], "half", [5]))
    return ST.in_out_compare(s.where("split = 'is' and symbol <> 'view'"), s.where("split = 'oos' and symbol <> 'click'"), ["symbol", "half", "h"], ["n", "mean"])


def _trades_sql(part="symbol", src="x1", extra=""):
    w = f"PARTITION BY {part} ORDER BY ts"
    return f"""t0 AS (SELECT *, {rank_sql('rv48', 96, w)} AS rp, ar/(atr14/close) AS sh FROM {src}),
t1 AS (SELECT *, lead(ts,1) OVER w AS entry_ts, lead(open,1) OVER w AS eo, lead(ts,4) OVER w AS x3, lead(open,4) OVER w AS o3, lead(ts,7) OVER w AS x6, lead(open,7) OVER w AS o6 FROM t0 WINDOW w AS ({w})),
t2 AS (SELECT {part}, ts AS signal_ts, r1, entry_ts, eo, 3 AS h, x3 AS exit_ts, o3 AS xo{extra} FROM t1 WHERE rp >= .3 AND rp < .9 AND sh >= .8 AND sh < 3 AND r1 <> 0 UNION ALL SELECT {part}, ts, r1, entry_ts, eo, 6, x6, o6{extra} FROM t1 WHERE rp >= .3 AND rp < .9 AND sh >= .8 AND sh < 3 AND r1 <> 0),
tr AS (SELECT *, CASE WHEN r1 < 0 THEN 'short' ELSE 'long' END AS side, CASE WHEN r1 < 0 THEN eo/xo - 1 ELSE xo/eo - 1 END - 2*3.0/10000 AS ret FROM t2 WHERE exit_ts IS NOT NULL)"""


KW = dict(window=96, horizons=[3, 6], variant="B", rv=(.3, .9), shock=(.8, 3.0), fee_bps=1.0, slip_bps=2.0)


@query("next_open_trades", f"WITH {_rvsql()}, {_trades_sql()} SELECT symbol, h::BIGINT AS h, signal_ts, entry_ts, exit_ts, side, {R('ret')} FROM tr")
def _(spark, d):
    t = ST.shock_trades(_study_bars(spark, d), ["symbol"], **KW)
    return t.select("symbol", "h", "signal_ts", "entry_ts", "exit_ts", "side", "ret")


@query("walkforward_trades", f"""WITH {_rvsql()}, fd AS (SELECT k + 1 AS fold_id, 1704067200 + k*4*86400 AS lo FROM range(20) r(k) WHERE 1704067200 + k*4*86400 + 14*86400 <= 1704067200 + 30*86400),
fx AS (SELECT x1.*, fd.fold_id, fd.lo FROM x1 JOIN fd ON ts >= lo AND ts < lo + 14*86400), {_trades_sql('symbol, fold_id', 'fx', ', lo')}
SELECT symbol, fold_id, h::BIGINT AS h, count(*) AS trades, {rx(mean_return='avg(ret)')} FROM tr WHERE signal_ts >= lo + 10*86400 AND signal_ts < lo + 14*86400 AND exit_ts < lo + 14*86400 GROUP BY 1,2,3""")
def _(spark, d):
    t = ST.walkforward_trades(_study_bars(spark, d), ["symbol"], (1704067200, 1704067200 + 30 * 86400), 10, 4, 4, **KW)
    return t.groupBy("symbol", "fold_id", "h").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_return"))


@query("trend_entry_screen", f"""WITH {EB()}, {BF}, x AS (SELECT eb.*, bf.atr14, bf.er20, bf.rv48, list_reduce(list(eb.close) OVER (PARTITION BY eb.symbol ORDER BY eb.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: a + (v-a)*2.0/13) AS ema,
  CASE WHEN count(*) OVER p >= 20 THEN max(eb.high) OVER p END AS lvl FROM eb JOIN bf ON bf.symbol=eb.symbol AND bf.ts=eb.ts WINDOW p AS (PARTITION BY eb.symbol ORDER BY eb.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, lag(rv48) OVER ({W1}) AS rv1, ema - lag(ema,3) OVER ({W1}) AS slope FROM x), z AS (SELECT *, {win('quantile_cont','rv1',60,W1,extra=', 0.9')} AS p90 FROM y)
SELECT symbol, ts, {rx(breakout_level='CASE WHEN brk THEN lvl END')}, ok AND brk AS candidate FROM (SELECT *, coalesce(close > lvl + 0.1*atr14, false) AND er20 IS NOT NULL AS brk, coalesce(er20 >= 0.35, false) AND NOT coalesce(er20 >= 0.9 AND er20 < 0.95, false) AND (p90 IS NULL OR NOT coalesce(rv48 >= p90, false)) AND coalesce(close > ema, false) AND coalesce(slope > 0, false) AS ok FROM z)""")
def _(spark, d):
    s = ST.trend_screen(_study_bars(spark, d), ["symbol"], lookback=20, atr_buffer=0.1, er_min=0.35, er_band=(.9, .95), rv_window=60, ema_span=12)
    return s.select("symbol", "ts", "breakout_level", "candidate")


@query("retest_screen", f"""WITH {EB()}, {BF}, x AS (SELECT eb.*, bf.atr14, bf.er20, CASE WHEN count(*) OVER p >= 20 THEN max(eb.high) OVER p END AS lvl FROM eb JOIN bf ON bf.symbol=eb.symbol AND bf.ts=eb.ts WINDOW p AS (PARTITION BY eb.symbol ORDER BY eb.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, coalesce(er20 >= 0.35, false) AS ok, coalesce(close > lvl, false) AND coalesce(er20 >= 0.35, false) AND atr14 IS NOT NULL AS brk FROM x), z AS (SELECT *, last_value(CASE WHEN brk THEN lvl END IGNORE NULLS) OVER ({W1} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS pl FROM y)
SELECT symbol, ts, {rx(breakout_level='pl')} FROM z WHERE ok AND coalesce(low <= pl + 3*atr14, false) AND coalesce(close >= pl, false)""")
def _(spark, d):
    s = ST.trend_screen(_study_bars(spark, d), ["symbol"], lookback=20, er_min=0.35, retest_bars=6, retest_band=3.0)
    return s.where("candidate").select("symbol", "ts", "breakout_level")


@query("reversion_screen", f"""WITH {EB()}, {BF}, x AS (SELECT *, close - vwap48 AS dev FROM bf), y AS (SELECT symbol, ts, dev/nullif({win('stddev_samp','dev',48,W1)},0) AS z FROM x) SELECT symbol, ts, {R('z')}, coalesce(z <= -1.5, false) AS candidate FROM y""")
def _(spark, d):
    return ST.reversion_screen(_study_bars(spark, d), ["symbol"]).select("symbol", "ts", "z", "candidate")


@query("screen_ablation", f"""WITH {EB()}, {BF}, x AS (SELECT eb.*, bf.atr14, bf.er20, CASE WHEN count(*) OVER p >= 20 THEN max(eb.high) OVER p END AS lvl, lead(eb.close, 4) OVER w/eb.close - 1 AS f FROM eb JOIN bf ON bf.symbol=eb.symbol AND bf.ts=eb.ts WINDOW p AS (PARTITION BY eb.symbol ORDER BY eb.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY eb.symbol ORDER BY eb.ts)),
v AS (SELECT symbol, 'plain' AS variant, f AS r FROM x WHERE er20 >= .35 AND close > lvl AND atr14 IS NOT NULL UNION ALL SELECT symbol, 'buffered', f FROM x WHERE er20 >= .35 AND close > lvl + 0.2*atr14 UNION ALL SELECT symbol, 'strict', f FROM x WHERE er20 >= .45 AND close > lvl AND atr14 IS NOT NULL)
SELECT symbol, variant, 4 AS h, {AGG} FROM v GROUP BY 1,2""")
def _(spark, d):
    return ST.ablation(_study_bars(spark, d), ["symbol"], {"plain": {}, "buffered": {"atr_buffer": 0.2}, "strict": {"er_min": 0.45}}, 4)
