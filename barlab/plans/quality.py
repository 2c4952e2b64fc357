"""Data quality: rejection, gaps, constraints, parity, document audits."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import lag_status
from ..operators.prefix import Run, running
from ..sources.readers import small


def reject_reason(step: int, lo: Column | int | None = None, hi: Column | int | None = None) -> Column:
    ts = F.col("ts")
    out = F.when(F.pmod(ts, F.lit(step)) != 0, "misaligned")
    if lo is not None:
        out = out.when((ts < lo) | (ts > hi), "out_of_chunk")
    bad = F.lit(False)
    for c in ("open", "high", "low", "close"):
        bad = bad | F.coalesce(F.col(c) <= 0, F.lit(True))
    return out.when(bad, "non_positive_price")


def ingest_counters(tagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per run of rows tagged inserted, upserted or rejected, with the time range accepted."""
    ok = F.col("outcome") != "rejected"
    return tagged.groupBy(*by).agg(
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("inserted", "upserted", "rejected")],
        F.min(F.when(ok, F.col("ts"))).alias("min_ts"), F.max(F.when(ok, F.col("ts"))).alias("max_ts"))


def gaps(bars: DataFrame, step: int, keys: Sequence[str] = ("symbol",), span: int = 86400 * 14) -> DataFrame:
    """Stretches of missing bars: (keys, gap_start, gap_end, missing). The previous time is carried over
    chunk borders by the running operator, so no task sees a whole symbol."""
    d = running(bars.select(*keys, "ts"), keys, ["ts"], [Run("prev", "max", F.col("ts"), inclusive=False)], F.col("ts"), span)
    d = d.where(F.col("ts") - F.col("prev") > step)
    return d.select(*keys, (F.col("prev") + step).alias("gap_start"), (F.col("ts") - step).alias("gap_end"),
                    ((F.col("ts") - F.col("prev")) / step - 1).cast("long").alias("missing"))


def missing_bars(bars: DataFrame, step: int, keys: Sequence[str] = ("symbol",), span: int = 86400 * 14) -> DataFrame:
    """Every absent grid time, expanded from the gaps found (not from a full grid)."""
    g = gaps(bars, step, keys, span)
    return g.select(*keys, F.explode(F.sequence("gap_start", "gap_end", F.lit(step))).alias("ts"))


def quality_summary(bars: DataFrame, step: int, as_of: Column | int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars present and expected, gap flag, source lag and its status, per key."""
    a = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    a = a.withColumn("expected", ((F.col("max_ts") - F.col("min_ts")) / step + 1).cast("long"))
    a = a.withColumns({"gap": F.col("bars") < F.col("expected"), "lag_seconds": (F.lit(as_of) if isinstance(as_of, int) else as_of) - F.col("max_ts")})
    return a.withColumn("lag_status", lag_status(F.col("lag_seconds")))


def source_available(bars: DataFrame, required: DataFrame) -> DataFrame:
    """Row count per required symbol; absent symbols show 0."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    d = required.join(n, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("available", F.col("n") > 0)


def stale_legs(bars: DataFrame, pairs: DataFrame, limit: int = 300) -> DataFrame:
    """Block a pair while its lead leg is behind its base leg by more than ``limit`` seconds."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    a, b = (last.withColumnsRenamed({"symbol": s, "last_ts": f"{s}_ts"}) for s in ("base", "lead"))
    d = pairs.join(small(a), "base").join(small(b), "lead")
    d = d.withColumn("lag_seconds", F.col("base_ts") - F.col("lead_ts"))
    return d.withColumn("blocked", F.col("lag_seconds") > limit)


def plausibility(features: DataFrame) -> DataFrame:
    """Flags for feature values that cannot be right; 'ok' when none."""
    f = F.array_compact(F.array(
        F.when((F.col("er20") < 0) | (F.col("er20") > 1), F.lit("er_out_of_bounds")),
        F.when((F.col("atr14") <= 0) | (F.col("rv48") <= 0), F.lit("atr_or_rv_nonpositive")),
        F.when((F.col("vwap48") <= 0) | (F.col("close") <= 0), F.lit("vwap_or_close_nonpositive"))))
    return features.withColumn("flags", F.when(F.size(f) > 0, F.concat_ws(",", f)).otherwise("ok"))


def feature_summary(joined: DataFrame, names: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """min, max, mean and missing count per feature, long form."""
    a = joined.groupBy(*by).agg(*[x for n in names for x in (
        F.min(n).alias(f"{n}|min"), F.max(n).alias(f"{n}|max"), F.avg(n).alias(f"{n}|mean"),
        F.count(F.when(F.col(n).isNull(), 1)).alias(f"{n}|missing"))])
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}|min").alias("min"), F.col(f"{n}|max").alias("max"),
                             F.col(f"{n}|mean").alias("mean"), F.col(f"{n}|missing").alias("missing")) for n in names])
    return a.select(*by, F.explode(arr).alias("f")).select(*by, "f.*")


def feature_coverage(x: DataFrame, names: Sequence[str]) -> DataFrame:
    """Valid rows, share of active rows for near-binary features, mean and maximum for the others."""
    ends = x.agg(*[e for n in names for e in (F.min(n).alias(f"{n}|lo"), F.max(n).alias(f"{n}|hi"))]).first()
    few = {}  # at most three values: no two between the smallest and the largest differ
    for n in names:
        inner = F.when((F.col(n) > F.lit(ends[f"{n}|lo"])) & (F.col(n) < F.lit(ends[f"{n}|hi"])), F.col(n))
        few[n] = F.coalesce(F.min(inner) == F.max(inner), F.lit(True))
    a = x.agg(*[e for n in names for e in (
        F.count(n).alias(f"{n}|valid"), few[n].alias(f"{n}|few"), F.count(F.when(F.col(n) > 0, 1)).alias(f"{n}|active"),
        F.avg(n).alias(f"{n}|mean"), F.max(n).alias(f"{n}|max"))])
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}|valid").alias("valid"),
                             F.when(F.col(f"{n}|few"), F.col(f"{n}|active") * 100.0 / F.nullif(F.col(f"{n}|valid"), F.lit(0))).alias("active_pct"),
                             F.when(~F.col(f"{n}|few"), F.col(f"{n}|mean")).alias("mean"),
                             F.when(~F.col(f"{n}|few"), F.col(f"{n}|max").cast("double")).alias("max")) for n in names])
    return a.select(F.explode(arr).alias("f")).select("f.*")


# --- constraints -------------------------------------------------------------------------------------
def check_rows(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Rows that break CHECK or NOT NULL rules: (keys, rule). A rule that is null does not fail."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(bad).alias("rule"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_reference(df: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key is absent from the parent."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(p, key, "left_anti")


# --- two sources -------------------------------------------------------------------------------------
def fingerprint(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free content hash per group: rows are formatted with 8 decimals, hashed, and folded with
    commutative aggregates, so it needs no sort and no single writer."""
    line = F.concat_ws("|", *[F.format_string("%.8f", F.col(c)) if t == "double" else F.col(c).cast("string")
                              for c, t in ((c, dict(df.dtypes)[c]) for c in cols)])
    h = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")  # 60 bits
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash_xor"),
                               F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def key_parity(a: DataFrame, b: DataFrame, by: Sequence[str], key: str, sample: int = 10) -> DataFrame:
    """Per group: keys of ``a`` missing in ``b`` and the reverse, with the smallest few of each as a
    sample. The sample is taken after a per-group top-n, not from a collected set."""
    x = a.select(*by, key).distinct()
    y = b.select(*by, key).distinct()
    miss = x.join(y, [*by, key], "left_anti").withColumn("_d", F.lit("missing"))
    extra = y.join(x, [*by, key], "left_anti").withColumn("_d", F.lit("extra"))
    u = miss.unionByName(extra)
    w = Window.partitionBy(*by, "_d").orderBy(key)
    top = u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    s = top.groupBy(*by).agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("_d") == d, F.col(key)))).cast("array<string>"), ",").alias(f"{d}_sample") for d in ("missing", "extra")])
    n = u.groupBy(*by).agg(*[F.count(F.when(F.col("_d") == d, 1)).alias(f"{d}_count") for d in ("missing", "extra")])
    base = x.select(*by).distinct().unionByName(y.select(*by).distinct()).distinct()
    return (base.join(n, list(by), "left").join(s, list(by), "left")
            .na.fill(0, ["missing_count", "extra_count"]).na.fill("", ["missing_sample", "extra_sample"]))


def table_parity(a: DataFrame, b: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Counts, range, content hash and key differences of two copies of one table."""
    def side(d, n):
        r = d.groupBy(*by).agg(F.min(ts).alias(f"{n}_min"), F.max(ts).alias(f"{n}_max"))
        f = fingerprint(d, by, cols).withColumnsRenamed({"n": f"{n}_count", "hash_xor": f"{n}_xor", "hash_sum": f"{n}_sum"})
        return r.join(f, list(by))
    d = side(a, "a").join(side(b, "b"), list(by), "full_outer").join(key_parity(a, b, by, ts), list(by), "left")
    return d.withColumn("identical", F.coalesce((F.col("a_xor") == F.col("b_xor")) & (F.col("a_sum") == F.col("b_sum")) & (F.col("a_count") == F.col("b_count")), F.lit(False)))


def dataset_fingerprint(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Common range of several symbols: latest start, earliest end, smallest count."""
    per = bars.where(F.col("symbol").isin(list(symbols))).groupBy("symbol").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.max("lo").alias("start_ts"), F.min("hi").alias("end_ts"), F.min("n").alias("bar_count"))


def reconcile(expected: DataFrame, actual: DataFrame, by: Sequence[str], tol: int, span: int = 86400 * 30) -> DataFrame:
    """i-th expected against i-th actual trade per key: matched, mismatched, length gap. Positions come
    from the two-level running count; the sides join on (key, position)."""
    by = list(by)
    pos = lambda d: running(d, by, ["entry_ts", "exit_ts"], [Run("i", "count", F.lit(1))], F.col("entry_ts"), span)
    e = pos(expected).select(*by, "i", *[F.col(c).alias(f"e_{c}") for c in ("entry_ts", "exit_ts", "signal_dir")])
    a = pos(actual).select(*by, "i", *[F.col(c).alias(f"a_{c}") for c in ("entry_ts", "exit_ts", "signal_dir")])
    j = e.join(a, [*by, "i"], "full_outer")
    both = F.col("e_entry_ts").isNotNull() & F.col("a_entry_ts").isNotNull()
    ok = ((F.abs(F.col("e_entry_ts") - F.col("a_entry_ts")) <= tol) & (F.abs(F.col("e_exit_ts") - F.col("a_exit_ts")) <= tol)
          & (F.col("e_signal_dir") == F.col("a_signal_dir")))
    return j.groupBy(*by).agg(
        F.count("e_entry_ts").alias("expected"), F.count("a_entry_ts").alias("actual"),
        F.count(F.when(both & ok, 1)).alias("matches"), F.count(F.when(both & ~ok, 1)).alias("mismatches"),
        F.count(F.when(~both, 1)).alias("length_gap"))


# --- documents ---------------------------------------------------------------------------------------
# What a run document must hold, and the names of the failures below
TOP_KEYS = ["hypothesis_id", "timestamp_utc", "dataset", "baseline", "walkforward", "mode_classification"]
DATASET_KEYS = ["timeframe", "start_ts", "end_ts", "bar_count", "db_path", "db_last_modified"]
MODES = ["gross", "bps8", "bps10"]
SPLIT = {"train_days": 60, "test_days": 15, "step_days": 15}
BASE_KEYS = ["n", "mean", "ci_low", "ci_high", "p_mean_gt_0"]
AGG_KEYS = ["n", "mean", "mean_ci_low", "mean_ci_high", "p_mean_gt_0"]
FOLD_KEYS = ["count", "pct", "total"]
CLASS_KEYS = ["baseline_status", "wf_status", "final_status"]
# path of an object -> reason when something else stands there
OBJECTS = {"dataset": "dataset_type", "baseline": "baseline_type", "walkforward": "walkforward_type", "walkforward.split": "walkforward_split_type",
           "walkforward.modes": "walkforward_modes_type", "mode_classification": "mode_classification_type"}


def audit_documents(docs: DataFrame, top_keys: Sequence[str] = TOP_KEYS) -> DataFrame:
    """(artifact, body) JSON text -> failure rows (artifact, reason, detail). A JSON null is a present key."""
    d = docs.select("artifact", F.try_parse_json("body").alias("v"))
    at = lambda p: F.try_variant_get("v", f"$.{p}", "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(at(p)), F.lit(""))
    has = lambda p: at(p).isNotNull()
    obj = lambda p: F.startswith(kind(p), F.lit("OBJECT"))
    arr = lambda p: F.startswith(kind(p), F.lit("ARRAY"))
    text = lambda p: kind(p) == "STRING"
    number = lambda p: kind(p).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    parsed = F.col("v").isNotNull()
    checks: list[tuple[Column, str, Column]] = [(~parsed, "json_parse", F.lit(""))]
    add = lambda c, reason, detail: checks.append((parsed & c, reason, detail if isinstance(detail, Column) else F.lit(detail)))
    for k in top_keys:
        add(~has(k), "missing_top_key", k)
    for p, reason in OBJECTS.items():
        add(has(p) & ~obj(p), reason, f"{p} must be object")
    add(~arr("dataset.primary_symbols"), "missing_dataset_symbols", "dataset.primary_symbols is required")
    for k in DATASET_KEYS:
        add(~has(f"dataset.{k}"), "missing_dataset_key", k)
    add(has("dataset.bar_count") & ~number("dataset.bar_count"), "dataset_bar_count_type", "bar_count must be numeric")
    for k, v in SPLIT.items():
        p = f"walkforward.split.{k}"
        same = number(p) & F.coalesce(F.try_variant_get("v", f"$.{p}", "double") == v, F.lit(False))
        got = F.coalesce(F.try_variant_get("v", f"$.{p}", "string"), F.lit("None"))
        add((obj("walkforward.split") | ~has("walkforward.split")) & ~same, "walkforward_split_mismatch", F.concat(F.lit(f"{k} expected {v}, got "), got))
    for m in MODES:
        b, w, c = f"baseline.{m}", f"walkforward.modes.{m}", f"mode_classification.{m}"
        add(~obj(b), "missing_baseline_mode", m)
        for k in BASE_KEYS:
            add(obj(b) & ~has(f"{b}.{k}"), "missing_baseline_metric", f"{m}.{k}")
        add(~obj(w), "missing_wf_mode", m)
        for part, none, lacks, keys in ((f"{w}.aggregate", "missing_wf_aggregate", "missing_wf_aggregate_metric", AGG_KEYS),
                                        (f"{w}.positive_folds", "missing_positive_folds", "missing_positive_folds_metric", FOLD_KEYS)):
            add(obj(w) & ~obj(part), none, m)
            for k in keys:
                add(obj(w) & obj(part) & ~has(f"{part}.{k}"), lacks, f"{m}.{k}")
        add(obj(w) & ~arr(f"{w}.folds"), "missing_folds_list", m)
        add(obj(w) & ~obj(c), "missing_mode_classification_mode", m)
        for k in CLASS_KEYS:
            add(obj(w) & obj(c) & ~text(f"{c}.{k}"), "missing_mode_classification_metric", f"{m}.{k}")
    bad = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("reason"), x.alias("detail"))) for c, r, x in checks]))
    return d.select("artifact", F.explode(bad).alias("f")).select("artifact", "f.*")
