"""Portfolios over rule events: membership, weights, gates, risk clamps, metrics."""
from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T

from ..functions.scalar import day_of, hour_of, id_number, month_label
from ..operators.prefix import drawdown
from ..operators.replay import replayed
from ..operators.store import stored
from ..sources.readers import small

DAY = 86400
POLICY_DDL = ("policy_id string, candidate_universe array<string>, include_members array<string>, "
              "exclude_members array<string>, dedup_keep string, dedup_drop string, weighting_mode string, "
              "rank_window_days int, score_clip_floor double, fallback_weighting string, "
              "consensus_threshold double, min_active_members int, core_set array<string>, "
              "session_map map<string,string>, core_weight_share double, specialist_weight_share double, "
              "fallback_mode string")

# The four published portfolio policies
_UNIVERSE = ["H76", "H77", "H79", "H81", "H78", "H82"]
POLICIES = {
    "P01": dict(candidate_universe=_UNIVERSE, dedup_keep="H77", dedup_drop="H79"),
    "P02": dict(candidate_universe=_UNIVERSE, weighting_mode="rank_weight", rank_window_days=30),
    "P03": dict(candidate_universe=_UNIVERSE, consensus_threshold=0.67, min_active_members=3),
    "P04": dict(candidate_universe=_UNIVERSE, weighting_mode="session_blend",
                core_set=["H76", "H77", "H79", "H78"],
                session_map={"08:00-16:00": "H81", "16:00-24:00": "H82"}),
}
_DEFAULTS = dict(candidate_universe=[], include_members=[], exclude_members=[], dedup_keep="", dedup_drop="",
                 weighting_mode="equal_weight_active", rank_window_days=30, score_clip_floor=0.0,
                 fallback_weighting="equal_weight_active", consensus_threshold=0.0, min_active_members=1,
                 core_set=[], session_map={}, core_weight_share=0.60, specialist_weight_share=0.40,
                 fallback_mode="core_only_equal_weight")


def policy_table(spark: SparkSession, policies: dict[str, dict] = POLICIES) -> DataFrame:
    for k, p in policies.items():
        if not p.get("candidate_universe"):
            raise ValueError(f"{k} missing candidate_universe")
        unknown = set(p) - set(_DEFAULTS)
        if unknown:
            raise ValueError(f"{k} has unknown fields {sorted(unknown)}")
    names = [f.split()[0] for f in POLICY_DDL.split(", ")]
    rows = [Row(**{n: ({**_DEFAULTS, **p, "policy_id": k})[n] for n in names}) for k, p in policies.items()]
    return spark.createDataFrame(rows, POLICY_DDL)


def members(policies: DataFrame) -> DataFrame:
    """Effective members per policy in order: include, exclude, drop the near-duplicate, unique."""
    c = F.col
    m = F.filter("candidate_universe", lambda x: (F.size("include_members") == 0) | F.array_contains(c("include_members"), x))
    d = policies.withColumn("_m", F.filter(m, lambda x: ~F.array_contains(c("exclude_members"), x)))
    drop = (c("dedup_drop") != "") & (c("dedup_keep") != "") & F.array_contains(c("_m"), c("dedup_keep"))
    d = d.withColumn("_m", F.array_distinct(F.filter("_m", lambda x: ~(drop & (x == c("dedup_drop"))))))
    return d.select(*policies.columns, F.posexplode("_m").alias("ord", "rule_id"))


def trailing_scores(events: DataFrame, by: Sequence[str], days: int, clip: float, ts: str = "ts",
                    ret: str = "gross_r") -> DataFrame:
    """Mean over deviation of the events in [ts - days, ts), at least ``clip``; 0 without history.

    The window looks back a bounded time, so rows are cut into time blocks of that length and each row
    also goes to the next block as history: the windows of one busy rule run in parallel.
    """
    span = days * 86400
    k = F.floor(F.col(ts) / span)
    d = events.withColumn("_tb", F.explode(F.array(k, k + 1))).withColumn("_own", F.col("_tb") == k)
    w = Window.partitionBy(*by, "_tb").orderBy(ts).rangeBetween(-span, -1)
    m, s = F.avg(ret).over(w), F.stddev_pop(ret).over(w)
    score = (F.when(F.count(ret).over(w) == 0, 0.0)
             .otherwise(F.greatest(F.lit(clip), F.when(s > 0, m / s).otherwise(0.0))))
    return d.withColumn("score", score).where("_own").drop("_tb", "_own")


def member_weights(events: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per (policy, ts, active member) with its weight. ``events`` has rule_id, family, ts,
    signal_dir, gross_r. Groups here are the members of one policy at one time, so they stay small."""
    c = F.col
    mem = members(policies).drop("candidate_universe", "include_members", "exclude_members", "dedup_keep", "dedup_drop")
    horizon = {r[0] for r in policies.select("rank_window_days").distinct().collect()}
    clips = {r[0] for r in policies.select("score_clip_floor").distinct().collect()}
    e = None
    for d in sorted(horizon):      # usually one window length and one floor in a policy set
        for f in sorted(clips):
            part = (trailing_scores(events, ["rule_id"], d, f)
                    .withColumns({"rank_window_days": F.lit(d), "score_clip_floor": F.lit(f)}))
            e = part if e is None else e.unionByName(part)
    e = e.join(small(mem), ["rule_id", "rank_window_days", "score_clip_floor"]).where(c("signal_dir") != 0)
    w = Window.partitionBy("policy_id", "ts")
    n = F.count(F.lit(1)).over(w)
    pos = F.greatest(c("score"), F.lit(0.0))
    total = F.sum(pos).over(w)
    equal = 1.0 / n
    ranked = F.when(total > 0, pos / total).when(c("fallback_weighting") == "equal_weight_active", equal).otherwise(0.0)
    # session blend: core members share one part, the specialist of the hour takes the other
    h = hour_of(c("ts"))
    start = lambda x: F.split(x["key"], "[:-]")[0].cast("int")
    end = lambda x: F.split(x["key"], "[:-]")[2].cast("int")
    now = F.get(F.filter(F.array_sort(F.map_entries("session_map")), lambda x: (start(x) <= h) & (h < end(x))), F.lit(0))["value"]
    e = e.withColumns({"_core": F.array_contains("core_set", c("rule_id")), "_spec": F.coalesce(now == c("rule_id"), F.lit(False))})
    n_core = F.sum(c("_core").cast("int")).over(w)
    spec_on = F.max(c("_spec").cast("int")).over(w) == 1
    blend = (F.when((n_core > 0) & spec_on, F.when(c("_spec"), c("specialist_weight_share"))
                    .when(c("_core"), c("core_weight_share") / n_core))
             .when((n_core > 0) & (c("fallback_mode") == "core_only_equal_weight") & c("_core"), 1.0 / n_core))
    weight = (F.when(c("weighting_mode") == "session_blend", blend)
              .when(c("weighting_mode") == "rank_weight", ranked).otherwise(equal))
    return e.withColumn("weight", weight).where(c("weight").isNotNull()).select(
        "policy_id", "ts", "rule_id", "family", "signal_dir", "gross_r", "weight", "consensus_threshold",
        "min_active_members")


def gated(weights: DataFrame) -> DataFrame:
    """Member rows of the portfolio events that pass: enough active members, enough agreement, and a
    non-zero signed weight."""
    c = F.col
    w = Window.partitionBy("policy_id", "ts")
    signed = F.sum(F.signum("signal_dir") * c("weight")).over(w)
    absw = F.sum(F.abs("weight")).over(w)
    active = F.sum((F.abs("weight") > 1e-12).cast("int")).over(w)
    d = weights.withColumns({"signed": F.round(signed, 12), "active_count": active,
                             "consensus": F.when(absw > 0, F.abs(signed) / absw).otherwise(0.0)})
    return d.where((c("active_count") >= F.greatest("min_active_members", F.lit(1)))
                   & (F.round("consensus", 12) >= c("consensus_threshold")) & (c("signed") != 0))


def portfolio_events(passed: DataFrame) -> DataFrame:
    return passed.groupBy("policy_id", "ts").agg(
        F.signum(F.first("signed")).alias("signal_dir"), F.sum(F.col("weight") * F.col("gross_r")).alias("gross_r"),
        F.first("active_count").alias("active_count"))


# --- combined run ------------------------------------------------------------------------------------
def risk_clamp(rows: DataFrame, at: Sequence[str], max_gross: float, max_asset: float, max_weight: float,
               asset: str = "asset", direction: str = "signal_dir") -> DataFrame:
    """Weights of simultaneous trades: direction over the sum of absolute directions, clipped per
    strategy, scaled to the gross cap, then scaled per asset to the net cap. Zero weights are dropped.
    ``gross_exposure`` is the sum of absolute *net* asset exposures."""
    w, wa = Window.partitionBy(*at), Window.partitionBy(*at, asset)
    denom = F.sum(F.abs(direction)).over(w)
    d = rows.withColumn("_w", F.when(denom > 0, F.greatest(F.lit(-max_weight), F.least(F.lit(max_weight), F.col(direction) / denom))))
    d = d.where(F.col("_w").isNotNull()).withColumn("_g", F.sum(F.abs("_w")).over(w))
    d = d.withColumn("_w", F.when(F.col("_g") > max_gross, F.col("_w") * max_gross / F.col("_g")).otherwise(F.col("_w")))
    d = d.withColumn("_net", F.sum("_w").over(wa))
    d = d.withColumn("weight", F.when(F.abs("_net") > max_asset, F.col("_w") * max_asset / F.abs("_net")).otherwise(F.col("_w")))
    d = d.where(F.abs("weight") > 1e-12).withColumn("asset_net", F.sum("weight").over(wa))
    first = F.row_number().over(wa.orderBy(F.col("rule_id"))) == 1
    return (d.withColumn("_one", F.when(first, F.abs("asset_net")).otherwise(0.0))
            .withColumn("gross_exposure", F.sum("_one").over(w)).drop("_w", "_g", "_net", "_one"))


def daily_stop(trades: DataFrame, scenario: Sequence[str], stop: float) -> DataFrame:
    """Drop trades after the day's cumulative pnl first reached -stop. ``trades`` has ts and pnl per
    (scenario, ts). A day's rows are one window: at most the bars of a day."""
    w = Window.partitionBy(*scenario, day_of(F.col("ts"))).orderBy("ts")
    d = trades.withColumn("_cum", F.sum("pnl").over(w))
    breach = F.max((F.col("_cum") <= -abs(stop)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("_b", F.coalesce(breach, F.lit(0))).where("_b = 0").drop("_b", "_cum")


def combine(events: DataFrame, scenario: Sequence[str], cost: float, max_gross: float = 1.0, max_asset: float = 0.75,
            max_weight: float = 0.5, stop: float = 0.02, cooldown: int = 0, step: int = 300,
            signed_weights: bool = True) -> tuple[DataFrame, DataFrame]:
    """(trades, contributions) of all strategies traded together.

    ``signed_weights`` keeps the published arithmetic: the weight carries the direction and multiplies a
    return that already carries it, so a short's contribution changes sign; False uses absolute weights.
    """
    scenario = list(scenario)
    if cooldown:
        rows, _ = cooldown_walk(events, scenario, cooldown * step, cost, max_gross, max_asset, max_weight, stop, signed_weights)
    else:
        rows = risk_clamp(events, [*scenario, "ts"], max_gross, max_asset, max_weight)
    wgt = F.col("weight") if signed_weights else F.abs("weight")
    rows = stored(rows.withColumn("contribution", wgt * (F.col("gross_r") - cost)))
    t = rows.groupBy(*scenario, "ts").agg(F.sum("contribution").alias("pnl"), F.first("gross_exposure").alias("gross_exposure"),
                                          F.count(F.lit(1)).alias("legs"))
    t = t if cooldown else daily_stop(t, scenario, stop)
    return t, rows.join(t.select(*scenario, "ts"), [*scenario, "ts"], "left_semi")


def cooldown_walk(events, scenario, secs, cost, max_gross, max_asset, max_weight, stop, signed_weights) -> tuple[DataFrame, int]:
    """(clamped rows of the executed trades, replay rounds). An executed trade keeps its rule out for ``secs``, and a
    day's losses keep out the rest of the day, so later candidates depend on earlier trades. Days are replayed in
    parallel; what a day hands over is the last trade of each rule that still cools down at the next day's start."""
    schema = T.StructType([*events.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("weight", "asset_net", "gross_exposure")]])

    def walk(p: pd.DataFrame, last: dict[str, int]) -> tuple[pd.DataFrame, dict[str, int]]:
        p = p.sort_values(["ts", "rule_id"], ignore_index=True)
        rule, asset = p["rule_id"].tolist(), pd.factorize(p["asset"])[0]
        direction, ret = p["signal_dir"].to_numpy(float), p["gross_r"].to_numpy(float)
        times, first = np.unique(p["ts"].to_numpy(), return_index=True)
        kept, found, pnl = [], [], 0.0
        for ts, a, b in zip(times.tolist(), first.tolist(), [*first[1:].tolist(), len(p)]):
            if pnl <= -abs(stop):
                break
            free = np.array([i for i in range(a, b) if ts - last.get(rule[i], ts - secs) >= secs], dtype=int)
            total = np.abs(direction[free]).sum()
            if not total > 0:
                continue
            w = np.clip(direction[free] / total, -max_weight, max_weight)
            w *= min(1.0, max_gross / np.abs(w).sum())
            net = np.abs(np.bincount(asset[free], weights=w))[asset[free]]
            w = np.where(net > max_asset, w * max_asset / np.where(net > 0, net, 1.0), w)
            live = np.abs(w) > 1e-12
            free, w = free[live], w[live]
            if not len(free):
                continue
            nets = np.bincount(asset[free], weights=w)
            last.update(dict.fromkeys((rule[i] for i in free), ts))
            pnl += float(((w if signed_weights else np.abs(w)) * (ret[free] - cost)).sum())
            kept.append(free)
            found.append(np.stack([w, nets[asset[free]], np.full(len(w), np.abs(nets).sum())]))
        kept, found = (np.concatenate(kept), np.concatenate(found, axis=1)) if kept else (np.zeros(0, int), np.zeros((3, 0)))
        return p.iloc[kept].assign(weight=found[0], asset_net=found[1], gross_exposure=found[2]), last

    day = F.floor(F.col("ts") / DAY).cast("long")
    return replayed(events.withColumn("_day", day), scenario, "_day", walk, schema, lambda s, d: s["value"] > d * DAY - secs)


# --- metrics -----------------------------------------------------------------------------------------
def performance(ret: DataFrame, by: Sequence[str], col: str, span: int = 86400 * 30) -> DataFrame:
    """Trades, net return, win rate, expectancy and compounded maximum drawdown."""
    d = drawdown(ret, by, ["ts"], col, F.col("ts"), span)
    return d.groupBy(*by).agg(
        F.count(col).alias("trade_count"), F.sum(col).alias("net_return"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(col) > 0).cast("double")).alias("win_rate"), F.avg(col).alias("expectancy"))


def monthly(ret: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return ret.groupBy(*by, month_label(F.col("ts")).alias("month")).agg(
        F.count(col).alias("trades"), F.sum(col).alias("net_return"), F.avg(col).alias("mean_return"),
        F.avg((F.col(col) > 0).cast("double")).alias("win_rate"))


def standalone_aggregate(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("hypothesis_count"), F.sum("trade_count").alias("trade_count"),
        F.avg("net_return").alias("mean_net_return"), F.avg("max_drawdown").alias("mean_max_drawdown"),
        F.avg("win_rate").alias("mean_win_rate"), F.avg("expectancy").alias("mean_expectancy"))


def daily_pnl(events: DataFrame, cost: float, key: str = "rule_id") -> DataFrame:
    return events.groupBy(key, day_of(F.col("ts")).alias("day")).agg(F.sum(F.col("gross_r") - cost).alias("pnl"))


def daily_wide(daily: DataFrame, ids: Sequence[str], key: str = "rule_id") -> DataFrame:
    """One row per day, one column per strategy, missing days 0."""
    return daily.groupBy("day").pivot(key, list(ids)).agg(F.sum("pnl")).na.fill(0.0)


def pair_correlation(daily: DataFrame, ids: Sequence[str], key: str = "rule_id") -> DataFrame:
    """Correlation of daily pnl for each pair of strategies, a before b in ``ids``. One pass accumulates the k x k
    moment matrix, k being the number of strategies in the catalogue; no pair rows are formed per day."""
    ids = list(ids)
    wide = daily_wide(daily, ids, key)
    v = VectorAssembler(inputCols=ids, outputCol="v").transform(wide).select("v")
    m = Correlation.corr(v, "v").head()[0].toArray()
    rows = [(a, b, 0.0 if m[i][j] != m[i][j] else float(m[i][j])) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j]
    return daily.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def concentration(contrib: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of absolute pnl and trades per strategy."""
    s = contrib.groupBy(*by, "rule_id").agg(F.sum("contribution").alias("pnl"), F.count(F.lit(1)).alias("trades"))
    w = Window.partitionBy(*by)
    t = F.sum(F.abs("pnl")).over(w)
    return s.withColumn("pnl_share", F.when(t > 0, F.abs("pnl") / t).otherwise(0.0))


def exposure(trades: DataFrame, contrib: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and maximum gross exposure per scenario, mean absolute net exposure per asset."""
    g = trades.groupBy(*by).agg(F.avg("gross_exposure").alias("mean_gross_exposure"), F.max("gross_exposure").alias("max_gross_exposure"))
    a = contrib.groupBy(*by, "ts", "asset").agg(F.abs(F.first("asset_net")).alias("x")).groupBy(*by, "asset").agg(
        F.avg("x").alias("mean_abs_asset_exposure"))
    return a.join(g, list(by))


def heat_audit(passed: DataFrame) -> dict[str, DataFrame]:
    """Mean weights per strategy, distribution of active counts, normalised family shares."""
    w = passed.groupBy("policy_id", "rule_id").agg(
        F.avg("weight").alias("mean_weight"), F.avg(F.abs("weight")).alias("mean_abs_weight"), F.count(F.lit(1)).alias("observations"))
    n = passed.select("policy_id", "ts", "active_count").distinct().groupBy("policy_id", "active_count").agg(
        F.count(F.lit(1)).alias("n"))
    c = F.col("weight") * F.col("gross_r")
    f = passed.groupBy("policy_id", "family").agg(F.sum(c).alias("pnl"), F.sum(F.abs(c)).alias("abs_pnl"))
    t = F.sum("abs_pnl").over(Window.partitionBy("policy_id"))
    f = f.withColumn("share", F.when(t > 0, F.col("abs_pnl") / t).otherwise(0.0))
    return {"weights": w, "active": n, "families": f}


def heat_gates(corr: DataFrame, conc: DataFrame, families: DataFrame, max_corr=0.75, max_strategy=0.40,
               max_family=0.60) -> DataFrame:
    """One row per gate: worst value, limit, pass."""
    one = lambda d, x, name, lim: d.agg(F.max(x).alias("worst")).select(
        F.lit(name).alias("gate"), F.coalesce("worst", F.lit(0.0)).alias("worst"), F.lit(lim).alias("limit"))
    g = one(corr.where("a <> b"), F.col("corr"), "pair_correlation", max_corr)
    g = g.unionByName(one(conc, F.col("pnl_share"), "strategy_share", max_strategy))
    g = g.unionByName(one(families, F.col("share"), "family_share", max_family))
    return g.withColumn("passed", F.col("worst") <= F.col("limit"))


def candidate_universe(runs: DataFrame, statuses: Iterable[str] = ("PASS",), min_trades: int = 50,
                       min_folds: int = 5) -> DataFrame:
    """Readiness flags per rule; order by eligible first, family, rule number."""
    d = runs.withColumns({"sample_ok": F.col("n") >= min_trades, "fold_ok": F.col("total_folds") >= min_folds})
    ok = F.col("sample_ok") & F.col("fold_ok") & F.col("final_status").isin(list(statuses))
    reason = (F.when(~F.col("final_status").isin(list(statuses)), "status").when(~F.col("sample_ok"), "sample")
              .when(~F.col("fold_ok"), "folds"))
    d = d.withColumns({"eligible_for_portfolio": ok, "exclude_reason": reason})
    return d.orderBy(F.col("eligible_for_portfolio").desc(), "family", id_number(F.col("rule_id")))


def route_regimes(states: DataFrame, policy: DataFrame, threshold: float, max_strategy: float = 0.5,
                  max_family: float = 0.6, max_gross: float = 1.0) -> DataFrame:
    """(ts, regime_label, confidence, healthy) -> allowed strategies with capped weights, or one NO_TRADE
    row. ``policy`` has regime_label, rule_id, family, weight."""
    live = (F.col("confidence") >= threshold) & F.coalesce("healthy", F.lit(False))
    d = states.withColumn("_on", F.coalesce(live, F.lit(False)))
    j = d.join(small(policy), ["regime_label"], "left")
    w, wf = Window.partitionBy("ts"), Window.partitionBy("ts", "family")
    j = j.withColumn("_w", F.when(F.col("_on") & F.col("rule_id").isNotNull(), F.least(F.col("weight"), F.lit(max_strategy))))
    fam = F.sum("_w").over(wf)
    j = j.withColumn("_w", F.when(fam > max_family, F.col("_w") * max_family / fam).otherwise(F.col("_w")))
    g = F.sum("_w").over(w)
    j = j.withColumn("_w", F.when(g > max_gross, F.col("_w") * max_gross / g).otherwise(F.col("_w")))
    out = j.select("ts", "regime_label", F.when(F.col("_w").isNotNull(), F.col("rule_id")).otherwise("NO_TRADE").alias("route"),
                   F.coalesce("_w", F.lit(0.0)).alias("weight"))
    return out.distinct()
