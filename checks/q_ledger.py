"""Ledger analytics."""
from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators.store import stored
from barlab.plans import ledger as LD
from barlab.plans import portfolio as PF

from .fixtures import LG, OE, ledger, order_events
from .registry import R, query, r6, rx

BY = ["strategy"]
ORDER = ["exit_ts", "trade_id"]
_RR = "rr AS (SELECT *, coalesce(pnl/nullif(risk_usd,0), pnl/nullif(atr*1.2,0)) AS r FROM lg)"


@query("trade_summary", f"""WITH {LG}, {_RR}, e AS (SELECT *, sum(pnl) OVER w AS eq, sum((pnl > 0)::INT) OVER w AS g FROM rr WINDOW w AS (PARTITION BY strategy ORDER BY exit_ts, trade_id)),
dd AS (SELECT strategy, max(pk - eq) AS dd FROM (SELECT *, max(eq) OVER (PARTITION BY strategy ORDER BY exit_ts, trade_id) AS pk FROM e) GROUP BY 1), st AS (SELECT strategy, max(n) AS streak FROM (SELECT strategy, g, count(*) FILTER (pnl <= 0) AS n FROM e GROUP BY 1,2) GROUP BY 1)
SELECT strategy, count(*) AS trades, any_value(streak) AS max_loss_streak, {rx(win_rate='avg((pnl>0)::INT)', avg_r='avg(r)', avg_win_r='avg(r) FILTER (pnl>0)', avg_loss_r='avg(r) FILTER (pnl<=0)', profit_factor='sum(pnl) FILTER (pnl>0)/abs(sum(pnl) FILTER (pnl<=0))', expectancy='avg(r)', ending_equity='10000+sum(pnl)', max_drawdown='any_value(dd)')} FROM rr JOIN dd USING (strategy) JOIN st USING (strategy) GROUP BY 1""")
def _(spark, d):
    return LD.trade_summary(ledger(spark, d), BY, order=ORDER)


@query("exit_reason_breakdown", f"WITH {LG} SELECT strategy, exit_reason, count(*) AS count, {rx(sum_pnl='sum(pnl)', mean_pnl='avg(pnl)')} FROM lg GROUP BY 1,2")
def _(spark, d):
    return LD.exit_reasons(ledger(spark, d), BY)


@query("regime_performance", f"WITH {LG}, {_RR} SELECT CASE WHEN er >= .35 THEN 'trend' WHEN er <= .25 THEN 'mean' ELSE 'uncertain' END AS entry_regime, count(*) AS count, {rx(win_rate='avg((pnl>0)::INT)', avg_r='avg(r)')} FROM rr GROUP BY 1")
def _(spark, d):
    return LD.regime_performance(ledger(spark, d))


_ST = "exit_reason = 'exit_stop_hit'"


@query("stop_statistics", f"""WITH {LG} SELECT strategy, {rx(stop_rate=f'avg(({_ST})::INT)', mean_r=f'avg(r_multiple) FILTER ({_ST})', median_r=f'median(r_multiple) FILTER ({_ST})', median_bars_to_stop=f'median(bars_to_stop) FILTER ({_ST})')}, count(*) FILTER ({_ST}) AS stops,
 {", ".join(f'count(*) FILTER ({_ST} AND bars_to_stop BETWEEN {a} AND {b}) AS "stop_{n}"' for n, (a, b) in LD.STOP_BUCKETS.items())} FROM lg GROUP BY 1""")
def _(spark, d):
    return LD.stop_stats(ledger(spark, d), BY)


@query("trade_quality", f"WITH {LG} SELECT strategy, {rx(avg_hold_bars='avg(exit_ts-entry_ts)/300', total_r='sum(r_multiple)', mae_mean='avg(mae_r)', mfe_mean='avg(mfe_r)', mae_median='median(mae_r)', mfe_median='median(mfe_r)')} FROM lg GROUP BY 1")
def _(spark, d):
    return LD.trade_quality(ledger(spark, d), BY)


@query("daily_trade_metrics", f"""WITH {LG}, a AS (SELECT strategy, exit_ts//86400 AS exit_day, count(*) AS trades, sum(net_return) AS dr, sum(pnl) AS dp, arg_max(equity_after, (exit_ts, trade_id)) AS ee, avg((net_return>0)::INT) AS wr, avg(net_return) AS mr, sum(exit_ts-entry_ts)/86400.0 AS ex FROM lg GROUP BY 1,2)
SELECT strategy, exit_day, trades, {rx(day_return='dr', day_pnl='dp', equity_end='ee', win_rate='wr', mean_return='mr', exposure_time='ex', peak_equity='max(ee) OVER w', drawdown='ee/max(ee) OVER w - 1')} FROM a WINDOW w AS (PARTITION BY strategy ORDER BY exit_day)""")
def _(spark, d):
    return LD.daily_metrics(ledger(spark, d), BY)


@query("trade_arithmetic_audit", f"""WITH {LG}, p AS (SELECT a.trade_id, 10000 + coalesce((SELECT sum(b.pnl) FROM lg b WHERE b.strategy = a.strategy AND b.exit_ts < a.entry_ts), 0) AS eq FROM lg a),
c AS (SELECT lg.*, p.eq, abs(eq*0.01) AS risk, abs(eq*0.01)/(atr*1.2) AS q FROM lg JOIN p USING (trade_id)), z AS (SELECT *, (entry_price*q + exit_price*q)*3.0/10000 AS cost FROM c)
SELECT trade_id, {rx(equity_at_entry='eq', x_qty='q', x_cost='cost', x_pnl='q*(exit_price-entry_price)-cost', x_r='(q*(exit_price-entry_price)-cost)/greatest(risk,1e-9)')}, abs(q*(exit_price-entry_price)-cost-pnl) > 5 AS pnl_mismatch FROM z""")
def _(spark, d):
    a = LD.audit_arithmetic(ledger(spark, d), BY, 0.01, 3.0, 10000.0, tol=5.0)
    return a.select("trade_id", "equity_at_entry", "x_qty", "x_cost", "x_pnl", "x_r", "pnl_mismatch")


@query("equity_by_horizon", f"WITH {LG} SELECT bars_to_stop AS h, count(*) AS trades, {rx(win_rate='avg((net_return>0)::INT)', mean_return='avg(net_return)', std_return='stddev_pop(net_return)', sharpe_like='avg(net_return)/stddev_pop(net_return)', final_equity_r='1+sum(net_return)', median_return='median(net_return)')} FROM lg GROUP BY 1")
def _(spark, d):
    t = ledger(spark, d).withColumnRenamed("bars_to_stop", "h")
    return LD.equity_by_horizon(t, ["h"], ret="net_return")


@query("equity_curve", f"WITH {LG} SELECT strategy, exit_ts, trade_id AS source_id, row_number() OVER w AS trade_id, {rx(equity_r='1+sum(net_return) OVER w')} FROM lg WINDOW w AS (PARTITION BY strategy ORDER BY exit_ts, lg.trade_id)")
def _(spark, d):
    t = stored(ledger(spark, d).select("strategy", "exit_ts", F.col("trade_id").alias("source_id"), "net_return"))
    return LD.equity_curve(t, BY, order=["exit_ts", "source_id"], ret="net_return").select("strategy", "exit_ts", "source_id", "trade_id", "equity_r")


@query("monthly_stability", f"WITH {OE} SELECT rule_id, strftime(make_timestamp(ts*1000000), '%Y-%m') AS month, count(*) AS trades, {rx(net_return='sum(gross_r-0.0008)', mean_return='avg(gross_r-0.0008)', win_rate='avg((gross_r-0.0008>0)::INT)')} FROM oe GROUP BY 1,2")
def _(spark, d):
    return PF.monthly(order_events(spark, d).withColumn("net", F.col("gross_r") - 0.0008), ["rule_id"], "net")
