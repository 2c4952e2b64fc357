"""Verdicts per (rule, cost mode) and per rule."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SEVERITY = {"PASS": 0, "BORDERLINE": 1, "INCONCLUSIVE": 2, "FAIL": 3}


def classify(df: DataFrame, min_n: int = 50, min_folds: int = 5) -> DataFrame:
    """Adds baseline_status, wf_status, final_status and reason. Input columns: n, mean, mean_ci_low,
    total_folds, positive_pct, wf_mean, wf_mean_ci_low."""
    c = F.col
    n, folds = F.coalesce("n", F.lit(0)), F.coalesce("total_folds", F.lit(0))
    pct = F.coalesce("positive_pct", F.lit(0.0))
    few, short, missing = n < min_n, folds < min_folds, c("wf_mean").isNull()
    base = (F.when(c("mean") > 0, F.when(c("mean_ci_low") > 0, "PASS").otherwise("BORDERLINE")).otherwise("FAIL"))
    wf_bad = (c("wf_mean") <= 0) | (pct < 50.0)
    wf_good = F.coalesce(c("wf_mean_ci_low") > 0, F.lit(False)) & (pct >= 60.0) & (folds >= 7)
    base_s = F.when(few | short, "INCONCLUSIVE").otherwise(base)
    wf_s = (F.when(few | short | missing, "INCONCLUSIVE").when(wf_bad, "FAIL").when(wf_good, "PASS")
            .otherwise("BORDERLINE"))
    d = df.withColumns({"baseline_status": base_s, "wf_status": wf_s})
    both = lambda v: (c("baseline_status") == v) & (c("wf_status") == v)
    final = (F.when(few | short | missing, "INCONCLUSIVE")
             .when((c("baseline_status") == "FAIL") | (c("wf_status") == "FAIL"), "FAIL")
             .when(both("PASS"), "PASS").otherwise("BORDERLINE"))
    reason = (F.when(few, f"baseline_n_lt_{min_n}").when(short, f"fold_count_lt_{min_folds}")
              .when(missing, "wf_aggregate_missing")
              .when(wf_bad, "non_positive_wf_or_fold_support_lt_50")
              .when(wf_good, "wf_ci_above_zero_and_fold_support_ge_60_with_ge7_folds")
              .otherwise("positive_wf_with_weak_ci_or_fold_support"))
    return d.withColumns({"final_status": final, "reason": reason})


def severity(status: Column) -> Column:
    out = None
    for k, v in SEVERITY.items():
        out = F.when(status == k, v) if out is None else out.when(status == k, v)
    return out


def combine_status(df: DataFrame, by: Sequence[str], status: str = "final_status") -> DataFrame:
    """Worst status per group."""
    worst = F.max_by(F.col(status), severity(F.col(status)))
    return df.groupBy(*by).agg(worst.alias("overall_status"))


def status_counts(df: DataFrame, status: str = "overall_status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def latest_per_key(df: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The newest record per key; a tie keeps the larger later field."""
    cols = [x for x in df.columns if x != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*version)).alias("_r")).select(key, "_r.*")


def flatten_runs(docs: DataFrame, modes: Sequence[str] = ("gross", "bps8", "bps10")) -> DataFrame:
    """Run documents -> one row per (rule, mode) with the columns ``classify`` reads."""
    m = F.explode(F.array(*[F.lit(x) for x in modes]))
    d = docs.withColumn("mode", m)
    b, w = F.element_at("baseline", F.col("mode")), F.element_at("wf_by_mode", F.col("mode"))
    return d.select("hypothesis_id", "timestamp_utc", "artifact", "mode", b["n"].alias("n"), b["mean"].alias("mean"),
                    b["mean_ci_low"].alias("mean_ci_low"), w["positive_folds"]["total"].alias("total_folds"),
                    w["positive_folds"]["pct"].alias("positive_pct"), w["aggregate"]["mean"].alias("wf_mean"),
                    w["aggregate"]["mean_ci_low"].alias("wf_mean_ci_low"))
