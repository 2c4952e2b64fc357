"""Feature mining: training matrices, folds, per-fold models, stability tables, regime labels."""
from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import windows as W
from ..functions.nulls import zero_to_null
from ..functions.scalar import day_of, hour_of, weekday_of
from ..operators import mixture as MX
from ..operators.asof import asof_join
from ..operators.blocks import in_blocks
from ..operators.rolling import Roll, back_rows, long_rolling
from ..operators.store import stored
from ..sources.readers import small

SPAN = 86400 * 30
REGIMES = ["RANGING", "TRENDING", "VOLATILE"]
# Features of the cross-asset family, and the family that a part of a feature's name stands for
CROSS_ASSET = ["spread_pct", "eth_slope_sign_1h", "btc_slope_sign_1h", "eth_slope_abs_pct_1h", "eth_slope_z_1h"]
FAMILY_OF = [("volatility_state", ["rv", "atr"]), ("funding_regime", ["funding"]), ("mean_reversion", ["vwap", "dist"]),
             ("efficiency", ["er20", "delta_er"]), ("session", ["hour", "day", "weekend"]), ("cross_asset_regime", ["spread", "slope"])]


def family_of(feature: Column) -> Column:
    out = None
    for name, parts in FAMILY_OF:
        hit = reduce(lambda a, b: a | b, [F.contains(feature, F.lit(p)) for p in parts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def family_of_pair(f1: Column, f2: Column) -> Column:
    a, b = family_of(f1), family_of(f2)
    return F.when(a == b, a).when((a == "cross_asset_regime") | (b == "cross_asset_regime"), "cross_asset_regime").otherwise(F.concat_ws("_", F.lit("composite"), a, b))


def training_matrix(frame: DataFrame, features: Sequence[str], horizon: int, regime: str | None = None,
                    span: int = SPAN, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Forward return and its sign with session features. The regime filter comes after the target, so
    the target is computed on the whole series; flat bars and rows with missing features drop out."""
    keys = list(keys)
    d = in_blocks(frame, keys, lambda d, w: d.withColumn("fwd_r_h", W.forward_return(F.col("close_btc"), w, horizon)),
                  forward=horizon, span=span)
    d = d.withColumns({"hour_of_day": hour_of(F.col("ts")), "day_of_week": weekday_of(F.col("ts"))})
    d = d.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    if regime:
        d = d.where(F.col("hmm_regime") == regime)
    d = d.withColumn("target", F.signum("fwd_r_h").cast("int")).where("target <> 0")
    return d.na.drop(subset=list(features)).select(*keys, "ts", "fwd_r_h", "target", *features)


def expanding_folds(m: DataFrame, train: int, step: int, min_train: int = 500, min_test: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Folds that train on everything before the cut and test ``step`` days after it, numbered within ``keys``. Counts per
    day are computed once; the fold table is a few rows a key. A key with too few days has no fold."""
    D, by = 86400, [*keys, "_all"]
    days = stored(m.groupBy(*keys, day_of(F.col("ts")).alias("d")).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0)))
    ends = days.groupBy(*by).agg(F.min("d").cast("long").alias("lo"), F.max("d").cast("long").alias("hi"))
    # the fold whose test days hold a day; -1: before the first cut. A fold trains on all days of lower folds.
    k = F.greatest(F.floor((F.col("d") - (F.col("lo") + train)) / step), F.lit(-1))
    per = days.join(ends, by).groupBy(*by, k.cast("long").alias("id")).agg(F.sum("n").alias("n"))
    last = F.floor((F.col("hi") - F.col("lo") - train) / step)
    cuts = ends.where(F.col("lo") + train <= F.col("hi")).select(*by, "lo", F.explode(F.sequence(F.lit(-1).cast("long"), last)).alias("id"))
    f = cuts.join(per, [*by, "id"], "left").withColumn("n_test", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    f = f.withColumn("n_train", F.sum("n_test").over(run)).where("id >= 0")
    f = f.select(*by, "lo", (F.col("id") * step + F.col("lo") + train).alias("cut"), "n_train", "n_test")
    f = f.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    w = Window.partitionBy(*by).orderBy("cut")
    return f.select(*keys, F.row_number().over(w).alias("fold"), (F.col("lo") * D).alias("train_start"), (F.col("cut") * D).alias("train_end"),
                    ((F.col("cut") + step) * D).alias("test_end"), "n_train", "n_test")


def sliding_folds(m: DataFrame, window_days: int, train: int = 60, step: int = 20, min_train: int = 500,
                  min_test: int = 100) -> DataFrame:
    """Sliding folds inside the first ``window_days``; the rest stays a locked hold-out."""
    D = 86400
    lo = m.agg(F.min("ts")).first()[0] or 0
    hi = m.where(F.col("ts") < lo + window_days * D).agg(F.max("ts")).first()[0] or 0
    span = (train + step) * D
    last = (hi - span - lo) // (step * D) if lo + span <= hi else -1
    # the folds of a row follow from its distance to the first time
    off = F.col("ts") - lo
    k0, k1 = F.greatest(F.lit(0), F.floor((off - span) / (step * D)) + 1), F.least(F.lit(last), F.floor(off / (step * D)))
    n = m.select("ts", F.explode(F.when(k0 <= k1, F.sequence(k0, k1))).alias("k"))
    n = n.withColumn("train_start", F.col("k") * (step * D) + lo)
    n = n.withColumns({"train_end": F.col("train_start") + train * D, "test_end": F.col("train_start") + span})
    n = n.groupBy("train_start", "train_end", "test_end").agg(
        F.count(F.when(F.col("ts") < F.col("train_end"), 1)).alias("n_train"), F.count(F.when(F.col("ts") >= F.col("train_end"), 1)).alias("n_test"))
    n = n.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    w = Window.partitionBy(F.lit(0)).orderBy("train_start")
    return n.select(F.row_number().over(w).alias("fold"), "train_start", "train_end", "test_end", "n_train", "n_test")


def in_folds(m: DataFrame, folds: DataFrame, start: str = "train_start") -> DataFrame:
    """Rows once per fold whose [start, test_end) holds them, with the fold's columns. Folds are a calendar: a short
    list, held in the plan, so there is no join."""
    cols = ["fold", "train_start", "train_end", "test_end"]
    every = [F.struct(*[F.lit(int(r[c])).cast("int" if c == "fold" else "long").alias(c) for c in cols]) for r in folds.select(*cols).collect()]
    if not every:
        return m.limit(0).select("*", *[F.lit(0).cast("int" if c == "fold" else "long").alias(c) for c in cols])
    hit = F.filter(F.array(*every), lambda f: (F.col("ts") >= f[start]) & (F.col("ts") < f["test_end"]))
    return m.select("*", F.explode(hit).alias("_f")).select(*m.columns, "_f.*")


def fold_importance(m: DataFrame, folds: DataFrame, features: Sequence[str], label: str = "fwd_r_h", trees: int = 20,
                    depth: int = 3, top: int = 15) -> DataFrame:
    """Per fold: boosted trees fitted by Spark on the training rows, feature importances, and the sign of
    the correlation of each feature with the prediction on the test rows. Folds are a short list; each fit
    is a distributed job."""
    spark = m.sparkSession
    features = list(features)
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    filled = m.na.fill(0.0, features)
    out = []
    for f in folds.orderBy("fold").collect():
        tr = filled.where((F.col("ts") >= f.train_start) & (F.col("ts") < f.train_end))
        te = filled.where((F.col("ts") >= f.train_end) & (F.col("ts") < f.test_end))
        model = GBTRegressor(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05,
                             subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42).fit(asm.transform(tr))
        pred = model.transform(asm.transform(te))
        c = pred.agg(*[F.corr(x, "prediction").alias(x) for x in features]).first()
        imp = model.featureImportances.toArray()
        out += [(int(f.fold), x, float(imp[i]), 0.0 if c[x] is None else float(c[x])) for i, x in enumerate(features)]
    d = spark.createDataFrame(out, "fold int, feature string, importance double, signed double")
    rn = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature"))
    return d.withColumns({"rank": rn, "direction": F.when(F.col("signed") > 0, "positive").otherwise("negative")}).where(F.col("rank") <= top)


def stable_features(imp: DataFrame, n_folds: int, min_folds: int = 5, top: int = 10) -> DataFrame:
    """Features in the top ten of enough folds: mean importance, net direction, whether of the cross-asset family."""
    return (imp.groupBy("feature").agg(
        F.count(F.when(F.col("rank") <= top, 1)).alias("consistent_folds"), (F.sum("importance") / n_folds).alias("mean_importance"),
        F.when(F.sum("signed") > 0, "positive").otherwise("negative").alias("direction"))
        .withColumn("ca_family", F.col("feature").isin(CROSS_ASSET))
        .where(F.col("consistent_folds") >= min_folds).orderBy(F.col("consistent_folds").desc(), F.col("mean_importance").desc()))


def rank_importance(imp: DataFrame) -> DataFrame:
    """Mean, deviation, variation and direction of importances across folds."""
    m, s = F.avg("importance"), F.stddev_samp("importance")
    cv = s / (m + 1e-10)
    return imp.groupBy("feature").agg(
        m.alias("mean_importance"), s.alias("std_importance"), cv.alias("cv"), F.avg("signed").alias("mean_signed"),
        F.count(F.when(F.col("signed") > 0, 1)).alias("n_folds_positive"), F.count(F.lit(1)).alias("n_folds"),
        F.when(F.avg("signed") > 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.coalesce(cv < 0.5, F.lit(False)).alias("consistent"))


def rank_horizons(ranked: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per feature with its rank per horizon (99 where absent), mean rank and importance, and the
    number of horizons where it is consistent. ``ranked`` has h, feature, mean_importance, consistent."""
    r = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy(F.col("mean_importance").desc(), "feature")))
    return r.groupBy("feature").agg(
        *[F.coalesce(F.max(F.when(F.col("h") == h, F.col("rank"))), F.lit(99)).alias(f"rank_h{h}") for h in horizons],
        F.avg("mean_importance").alias("mean_importance_all"), F.avg("rank").alias("mean_rank_all"),
        F.count(F.when(F.col("consistent"), 1)).alias("n_horizons_consistent"))


# --- quadrants ----------------------------------------------------------------------------------------
def quadrants(m: DataFrame, folds: DataFrame, features: Sequence[str], hi: float = 0.70, lo: float = 0.30,
              min_n: int = 30, ret: str = "fwd_r_h") -> DataFrame:
    """Mean forward return of test rows in the four corners of every feature pair, with thresholds from
    the training rows of the fold. One row per (fold, f1, dir1, f2, dir2).

    Thresholds are exact order statistics per (fold, feature). Rows are turned into a code per feature
    (high, low, neither); a pair then needs one grouped count per corner, over a list of pairs fixed by
    the feature names, with map-side partials.
    """
    features = list(features)
    from ..operators.quantiles import exact_quantiles
    d = stored(in_folds(m, folds).select("fold", (F.col("ts") < F.col("train_end")).alias("train"), F.col(ret).alias("_r"), *features))
    lab = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x")
    q = exact_quantiles(d.where("train").select("fold", lab).select("fold", "x.*"), ["fold", "feature"], "v", {"hi": hi, "lo": lo})
    t = q.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("hi", "lo")))).alias("lim"))
    te = d.where(~F.col("train")).join(small(t), "fold")  # one row per fold
    code = {f: F.when(F.col(f) > F.element_at("lim", F.lit(f))["hi"], "high").when(F.col(f) < F.element_at("lim", F.lit(f))["lo"], "low") for f in features}
    te = te.select("fold", "_r", *[c.alias(f) for f, c in code.items()])
    pairs = list(combinations(sorted(features), 2))
    corner = F.array_compact(F.array(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
        F.lit(a).alias("f1"), F.col(a).alias("dir1"), F.lit(b).alias("f2"), F.col(b).alias("dir2"))) for a, b in pairs]))
    c = te.select("fold", "_r", F.explode(corner).alias("p")).groupBy("fold", "p").agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean_fwd_r"))
    return c.where(F.col("n") >= min_n).select("fold", "p.*", "n", "mean_fwd_r", F.when(F.col("mean_fwd_r") > 0, "long").otherwise("short").alias("direction"))


def interaction_strength(quads: DataFrame) -> DataFrame:
    """Pairs by the spread between the returns of their corners, per fold."""
    return quads.groupBy("fold", "f1", "f2").agg(F.var_pop("mean_fwd_r").alias("strength"), F.count(F.lit(1)).alias("corners"))


def stable_pairs(quads: DataFrame, min_folds: int = 3, min_share: float = 0.67) -> DataFrame:
    """Corners seen in enough folds with an agreed direction. Pairs are keyed in name order, so each
    corner counts once per fold."""
    swap = F.col("f1") > F.col("f2")
    k = {"a": F.least("f1", "f2"), "da": F.when(swap, F.col("dir2")).otherwise(F.col("dir1")),
         "b": F.greatest("f1", "f2"), "db": F.when(swap, F.col("dir1")).otherwise(F.col("dir2"))}
    d = quads.withColumns(k).dropDuplicates(["fold", "a", "da", "b", "db"])
    n = F.count(F.lit(1))
    long_ = F.count(F.when(F.col("direction") == "long", 1)) / n
    g = d.groupBy("a", "da", "b", "db").agg(n.alias("fold_count"), long_.alias("_l"), F.avg("mean_fwd_r").alias("mean_fwd_r"), F.floor(F.avg("n")).alias("mean_n"))
    g = g.withColumns({"direction": F.when(F.col("_l") >= min_share, "long").when(1 - F.col("_l") >= min_share, "short"),
                       "pct_consistent": F.greatest(F.col("_l"), 1 - F.col("_l"))})
    return (g.where((F.col("fold_count") >= min_folds) & F.col("direction").isNotNull()).drop("_l")
            .withColumnsRenamed({"a": "f1", "da": "dir1", "b": "f2", "db": "dir2"})
            .orderBy(F.col("fold_count").desc(), F.col("pct_consistent").desc(), F.abs("mean_fwd_r").desc()))


def regime_breakdown(m: DataFrame, cands: DataFrame, regime: str = "hmm_regime", ret: str = "fwd_r_h", min_n: int = 20) -> DataFrame:
    """Mean forward return of each candidate's condition (upper or lower 30 %) by regime; fewer than
    ``min_n`` rows give no mean. ``cands`` has feature, direction (a few rows)."""
    from ..operators.quantiles import exact_quantiles
    c = {r.feature: r.direction for r in cands.select("feature", "direction").collect()}
    lab = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"), F.col(f).cast("double").alias("v")) for f, d in c.items()])).alias("x")
    d = stored(m.select(F.col(regime).alias("regime"), F.col(ret).alias("_r"), lab).select("regime", "_r", "x.*"))
    q = exact_quantiles(d, ["feature"], "v", {"hi": .70, "lo": .30})
    j = d.join(small(q), "feature")  # one row per candidate
    hit = F.when(F.col("direction") == "positive", F.col("v") > F.col("hi")).otherwise(F.col("v") < F.col("lo"))
    g = j.where(hit & F.col("regime").isin(REGIMES)).groupBy("feature", "direction", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("_m"))
    return g.select("feature", "direction", "regime", "n", F.when(F.col("n") >= min_n, F.col("_m")).alias("mean_fwd_r"))


def suggest(stable: DataFrame, by_regime: DataFrame, next_id: int, min_folds: int = 6, top: int = 5) -> DataFrame:
    """Numbered rule candidates from the most consistent features outside the cross-asset family, each with its best
    regime."""
    best = by_regime.where("mean_fwd_r is not null").groupBy("feature").agg(F.max_by("regime", "mean_fwd_r").alias("best_regime"))
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("consistent_folds").desc(), F.col("mean_importance").desc(), "feature"))
    s = stable.where((F.col("consistent_folds") >= min_folds) & ~F.col("feature").isin(CROSS_ASSET)).withColumn("_n", rn).where(F.col("_n") <= top).join(best, "feature", "left")
    f = F.col("feature")
    word = F.when(F.col("direction") == "positive", "above 70th pct").otherwise("below 30th pct")
    return s.select(F.concat(F.lit("H"), (F.lit(next_id - 1) + F.col("_n")).cast("string")).alias("suggested_id"), "feature", "direction", "consistent_folds",
                    F.concat(F.lit("Enter long BTC when "), f, F.lit(" is "), word, F.coalesce(F.concat(F.lit(", gated by regime="), F.col("best_regime")), F.lit(""))).alias("suggested_rule"),
                    family_of(f).alias("suggested_family"), "best_regime")


def suggest_pairs(stable: DataFrame, next_id: int, regime: str | None = None, min_folds: int = 4, min_share: float = 0.70, top: int = 8) -> DataFrame:
    """Numbered two-feature candidates from the most stable corners (``stable_pairs``)."""
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("fold_count").desc(), F.col("pct_consistent").desc(), F.abs("mean_fwd_r").desc(), "f1", "dir1", "f2", "dir2"))
    s = stable.where((F.col("fold_count") >= min_folds) & (F.round("pct_consistent", 2) >= min_share)).withColumn("_n", rn).where(F.col("_n") <= top)
    word = lambda d: F.when(F.col(d) == "high", ">70th pct").otherwise("<30th pct")
    rule = F.concat(F.lit("Enter "), "direction", F.lit(" BTC when "), "f1", F.lit(" "), word("dir1"), F.lit(" AND "), "f2", F.lit(" "), word("dir2"),
                    F.lit(f", gated by regime={regime}" if regime else ""))
    return s.select(F.concat(F.lit("H"), (F.lit(next_id - 1) + F.col("_n")).cast("string")).alias("suggested_id"), "f1", "dir1", "f2", "dir2", "direction",
                    "fold_count", "pct_consistent", "mean_fwd_r", rule.alias("suggested_rule"), family_of_pair(F.col("f1"), F.col("f2")).alias("suggested_family"),
                    (F.col("f1").isin(CROSS_ASSET) | F.col("f2").isin(CROSS_ASSET)).alias("ca_family"))


# --- regimes -------------------------------------------------------------------------------------------
def regime_features(hourly: DataFrame, funding: DataFrame | None = None, keys: Sequence[str] = ("symbol",), w_rank: int = 200,
                    compat_er: bool = False, span: int = 86400 * 60) -> DataFrame:
    """Hourly volatility, efficiency, ATR rank and funding rank. ``compat_er`` keeps the published mix of
    units in the efficiency ratio (price change over log path, clipped at 1)."""
    keys = list(keys)
    d = hourly
    if funding is not None:
        d = asof_join(stored(hourly), funding, keys, ["funding_rate"], span=span)
    rolls = [Roll("atr_pct_1h", "rank", "_atr", w_rank)] + ([Roll("funding_pct_1h", "rank", "funding_rate", w_rank)] if funding is not None else [])

    def build(x, w):
        c = F.col("close")
        pc = W.lag(c, w)
        x = x.withColumns({"_lr": F.log(c / pc), "_tr": W.true_range(F.col("high"), F.col("low"), pc, first="range"), "_st": F.abs(c - pc)})
        net = F.abs(W.diff(c, w, 20))
        path = W.total(F.abs(F.col("_lr")) if compat_er else F.col("_st"), w, 20)
        er = F.greatest(F.lit(0.0), F.least(F.lit(1.0), net / zero_to_null(path)))
        x = x.withColumns({"rv_1h": W.std(F.col("_lr"), w, 12, ddof=1), "er20_1h": er, "_atr": W.mean(F.col("_tr"), w, 14)})
        return long_rolling(x, keys, rolls)
    x = in_blocks(stored(d), keys, build, back=back_rows(rolls) + 40, span=span)
    if funding is None:
        x = x.withColumn("funding_pct_1h", F.lit(0.5))
    cols = ["rv_1h", "er20_1h", "atr_pct_1h", "funding_pct_1h"]
    return x.na.drop(subset=cols).select(*keys, "ts", *cols)


def label_regimes(feats: DataFrame, folds: DataFrame, cols: Sequence[str] = ("rv_1h", "er20_1h", "atr_pct_1h", "funding_pct_1h"),
                  k: int = 3, key: str = "symbol") -> DataFrame:
    """Walk-forward state labels, one model per (symbol, fold): standardise on the training rows, fit a k-component
    Gaussian mixture there, decode the test rows, and renumber states by rising mean volatility. A mixture stands in
    for the hidden Markov model (same emissions, no transition matrix). ``folds`` has the key, fold, train_start,
    train_end and test_end, a few rows a key. All models are fitted together (``mixture.fit``): the number of jobs does not
    grow with symbols or folds. No fold, no rows."""
    cols = list(cols)
    cal = folds.select(key, F.col("fold").cast("int").alias("fold"), "train_start", F.col("train_end").cast("long").alias("model_train_end"), "test_end")
    x = feats.select(key, "ts", *cols).join(small(cal), key)
    t, cut = F.col("ts"), F.col("model_train_end")
    models = MX.fit(x.where((t >= F.col("train_start")) & (t < cut)), [key, "fold"], cols, k)
    out = stored(MX.decode(x.where((t >= cut) & (t < F.col("test_end"))).select(key, "ts", *cols, "fold", "model_train_end"),
                           models, [key, "fold"], cols, k, "_s"))
    m = out.groupBy(key, "fold", "_s").agg(F.avg(cols[0]).alias("_m"))
    m = m.withColumn("state_id", F.row_number().over(Window.partitionBy(key, "fold").orderBy("_m", "_s")) - 1)
    names = F.array(*[F.lit(x) for x in REGIMES])
    j = out.join(small(m.drop("_m")), [key, "fold", "_s"])  # k rows per model
    return j.withColumn("regime_name", F.coalesce(F.get(names, F.col("state_id")), F.lit("UNKNOWN"))).drop("_s")


def state_summary(labelled: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows and feature means per state."""
    g = labelled.groupBy(*by, "state_id", "regime_name").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    t = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return g.withColumn("pct_bars", F.col("n") / t)
