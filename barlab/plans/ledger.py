"""Analytics and audits of trade ledgers."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import day_of, trade_cost, trend_regime
from ..operators.prefix import drawdown, max_streak, running, Run
from ..operators.quantiles import exact_quantiles
from ..operators.store import stored

MONTH = 86400 * 30


def with_r(trades: DataFrame, atr_mult: float = 1.2) -> DataFrame:
    """R multiple: pnl over risked money, or over 1.2 ATR where the risk is unknown."""
    risk = F.nullif(F.col("risk_usd"), F.lit(0.0))
    return trades.withColumn("r", F.coalesce(F.col("pnl") / risk, F.col("pnl") / F.nullif(F.col("atr") * atr_mult, F.lit(0.0))))


def trade_summary(trades: DataFrame, by: Sequence[str], initial: float = 10000.0, order: Sequence[str] = ("exit_ts",)) -> DataFrame:
    """Win rate, R statistics, profit factor, additive drawdown, loss streak and ending equity."""
    by = list(by)
    t = stored(with_r(trades))
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    lost = F.abs(F.sum(F.when(loss, F.col("pnl"))))
    a = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.avg("r").alias("avg_r"),
        F.avg(F.when(win, F.col("r"))).alias("avg_win_r"), F.avg(F.when(loss, F.col("r"))).alias("avg_loss_r"),
        F.when(lost > 0, F.sum(F.when(win, F.col("pnl"))) / lost).alias("profit_factor"),
        (F.lit(initial) + F.sum("pnl")).alias("ending_equity"))
    dd = drawdown(t, by, list(order), "pnl", F.col("exit_ts"), MONTH, compounded=False).groupBy(*by).agg(
        F.max("drawdown").alias("max_drawdown"))
    st = max_streak(t, by, list(order), loss, "max_loss_streak", F.col("exit_ts"), MONTH)
    return a.join(dd, by).join(st, by).withColumn("expectancy", F.col("avg_r"))


def exit_reasons(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*by, "exit_reason").agg(F.count(F.lit(1)).alias("count"), F.sum("pnl").alias("sum_pnl"), F.avg("pnl").alias("mean_pnl"))


def regime_performance(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    t = with_r(trades)
    return t.groupBy(*by, trend_regime(F.col("er")).alias("entry_regime")).agg(
        F.count(F.lit(1)).alias("count"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("avg_r"))


# Edges of the bars-to-stop buckets
STOP_BUCKETS = {"1": (1, 1), "2-3": (2, 3), "4-6": (4, 6), "7-10": (7, 10), "11-20": (11, 20), "21+": (21, 1 << 30)}


def stop_stats(trades: DataFrame, by: Sequence[str], reason: str = "exit_stop_hit") -> DataFrame:
    by = list(by)
    stop = F.col("exit_reason") == reason
    b = F.when(stop, F.col("bars_to_stop"))
    a = trades.groupBy(*by).agg(
        F.avg(stop.cast("double")).alias("stop_rate"), F.count(F.when(stop, 1)).alias("stops"),
        F.coalesce(F.avg(F.when(stop, F.col("r_multiple"))), F.lit(0.0)).alias("mean_r"),
        *[F.count(F.when(b.between(lo, hi), 1)).alias(f"stop_{k}") for k, (lo, hi) in STOP_BUCKETS.items()])
    s = trades.where(stop)
    m = exact_quantiles(s, by, F.col("bars_to_stop").cast("double"), {"median_bars_to_stop": .5}).join(
        exact_quantiles(s, by, "r_multiple", {"median_r": .5}), by)
    return a.join(m, by, "left").na.fill(0.0, ["median_bars_to_stop", "median_r"])


def trade_quality(trades: DataFrame, by: Sequence[str], step: int = 300) -> DataFrame:
    by = list(by)
    a = trades.groupBy(*by).agg((F.avg(F.col("exit_ts") - F.col("entry_ts")) / step).alias("avg_hold_bars"),
                                F.sum("r_multiple").alias("total_r"), F.avg("mae_r").alias("mae_mean"), F.avg("mfe_r").alias("mfe_mean"))
    for c in ("mae", "mfe"):
        a = a.join(exact_quantiles(trades, by, f"{c}_r", {f"{c}_median": .5}), by, "left")
    return a


def daily_metrics(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per exit day: trades, return, pnl, last equity, win rate, exposure, running peak and drawdown."""
    by = list(by)
    hold = F.greatest(F.col("exit_ts") - F.col("entry_ts"), F.lit(0))
    d = trades.groupBy(*by, day_of(F.col("exit_ts")).alias("exit_day")).agg(
        F.count("net_return").alias("trades"), F.sum("net_return").alias("day_return"), F.sum("pnl").alias("day_pnl"),
        F.max_by("equity_after", F.struct("exit_ts", "trade_id")).alias("equity_end"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("net_return").alias("mean_return"),
        (F.sum(hold) / 86400.0).alias("exposure_time"))
    # one row per day and account from here on
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("exit_day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("peak_equity", F.max("equity_end").over(w))
    return d.withColumn("drawdown", F.col("equity_end") / F.col("peak_equity") - 1.0)


def audit_arithmetic(trades: DataFrame, account: Sequence[str], risk_pct: float, bps: float, initial: float,
                     atr_mult: float = 1.2, tol: float = 1e-6) -> DataFrame:
    """Recompute cost, pnl, R and equity of every trade from its stored inputs. Equity before a trade is
    the initial equity plus the pnl of trades that *exited* before it entered; entries and exits go on one
    time line, so the running sum is one two-level pass instead of a query per trade."""
    account = list(account)
    t = trades.withColumn("_t", F.col("entry_ts")).withColumn("_k", F.lit(0))
    x = trades.select(*account, F.col("exit_ts").alias("_t"), F.lit(1).alias("_k"), F.col("pnl").alias("_p"))
    u = stored(t.unionByName(x, allowMissingColumns=True))
    u = running(u, account, ["_t", "_k"], [Run("_prior", "sum", F.col("_p"), inclusive=False)], F.col("_t"), MONTH)
    d = u.where("_k = 0").withColumn("equity_at_entry", F.lit(initial) + F.coalesce("_prior", F.lit(0.0)))
    sd = F.col("atr") * atr_mult
    d = d.withColumns({"x_risk": F.abs(F.col("equity_at_entry") * risk_pct)})
    d = d.withColumn("x_qty", F.when(sd > 0, F.col("x_risk") / sd).otherwise(0.0))
    cost = trade_cost(F.col("entry_price"), F.col("x_qty"), bps) + trade_cost(F.col("exit_price"), F.col("x_qty"), bps)
    d = d.withColumn("x_cost", cost)
    d = d.withColumn("x_pnl", F.col("x_qty") * (F.col("exit_price") - F.col("entry_price")) - F.col("x_cost"))
    d = d.withColumns({"x_r": F.col("x_pnl") / F.greatest(F.col("x_risk"), F.lit(1e-9)),
                       "x_equity_after": F.col("equity_at_entry") + F.col("x_pnl")})
    return d.withColumn("pnl_mismatch", F.abs(F.col("x_pnl") - F.col("pnl")) > tol).drop("_t", "_k", "_p", "_prior")


def equity_by_horizon(trades: DataFrame, by: Sequence[str], order: Sequence[str] = ("exit_ts",), ret: str = "ret") -> DataFrame:
    """Additive equity curve 1 + cumulative return and its summary per horizon."""
    by = list(by)
    t = stored(trades)
    s = F.stddev_pop(ret)
    a = t.groupBy(*by).agg(
        F.count(ret).alias("trades"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), F.avg(ret).alias("mean_return"),
        s.alias("std_return"), F.when(s == 0, 0.0).otherwise(F.avg(ret) / s).alias("sharpe_like"),
        (F.lit(1.0) + F.sum(ret)).alias("final_equity_r"))
    return a.join(exact_quantiles(t, by, ret, {"median_return": .5}), by)


def equity_curve(trades: DataFrame, by: Sequence[str], order: Sequence[str] = ("exit_ts",), ret: str = "ret") -> DataFrame:
    d = running(trades, by, list(order), [Run("_c", "sum", F.col(ret)), Run("trade_id", "count", F.lit(1))], F.col("exit_ts"), MONTH)
    return d.withColumn("equity_r", F.lit(1.0) + F.col("_c")).drop("_c")
