"""Two-level operators against straightforward pandas on random series with gaps and nulls."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barlab.functions import windows as W
from barlab.operators import prefix
from barlab.operators.asof import asof_join, asof_join_many
from barlab.operators.blocks import in_blocks
from barlab.operators.prefix import Run, drawdown, max_streak, row_index, run_length, running
from barlab.operators.quantiles import exact_quantiles, ranked, top_sum
from barlab.operators.rolling import Roll, back_rows, long_rolling
from barlab.operators.stats import bootstrap_ci, bootstrap_means, folds, walkforward
from barlab.operators.thin import thin


def series(seed=0, n=900, keys=("a", "b"), nulls=0.15):
    r = np.random.default_rng(seed)
    out = []
    for i, k in enumerate(keys):
        m = n if i == 0 else n // 3  # one hot key
        ts = np.sort(r.choice(n * 4, m, replace=False)) * 60
        v = r.normal(size=m).round(3)
        v[r.random(m) < nulls] = np.nan
        out.append(pd.DataFrame({"k": k, "ts": ts, "v": v}))
    return pd.concat(out, ignore_index=True)


def frame(spark, p):
    d = spark.createDataFrame(p)
    for c, t in d.dtypes:
        if t == "double":
            d = d.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return d


def back(d, *order):
    return d.toPandas().sort_values(list(order)).reset_index(drop=True)


def greedy(idx, need):
    out, last = [], -10 ** 9
    for i, g in zip(idx, need):
        if i - last >= g:
            out.append(int(i))
            last = i
    return out


def test_thinning_golden(spark):
    d = spark.createDataFrame([(i,) for i in (1, 2, 5, 6, 7, 12, 13, 20)], "idx long").withColumn("k", F.lit(1))
    assert sorted(r.idx for r in thin(d, ["k"], 5).collect()) == [1, 6, 12, 20]


@pytest.mark.parametrize("density,gap,chunk,fan", [(0.05, 9, 32, 2), (0.5, 7, 16, 3), (1.0, 5, 8, 4), (0.9, 24, 64, 2)])
def test_thinning_matches_walk(spark, density, gap, chunk, fan):
    r = np.random.default_rng(int(density * 100) + gap)
    rows = [(k, int(i), int(r.choice([min(6, gap), gap]))) for k in "ab" for i in np.flatnonzero(r.random(1500) < density)]
    p = pd.DataFrame(rows, columns=["k", "idx", "need"])
    d = spark.createDataFrame(p)
    one = thin(d, ["k"], gap, chunk=chunk, fan=fan).toPandas()
    two = thin(d, ["k"], F.col("need"), max_gap=gap, chunk=chunk, fan=fan).toPandas()
    for k, g in p.groupby("k"):
        assert sorted(one[one.k == k].idx) == greedy(g.idx, [gap] * len(g))
        assert sorted(two[two.k == k].idx) == greedy(g.idx, g.need)


def test_running_values(spark):
    p = series()
    d = running(frame(spark, p), ["k"], ["ts"], [
        Run("n", "count", F.lit(1)), Run("s", "sum", F.col("v")), Run("mx", "max", F.col("v")), Run("mn", "min", F.col("v")),
        Run("l", "last", F.col("v")), Run("before", "max", F.col("v"), inclusive=False)], F.col("ts"), 3600)
    g, e = back(d, "k", "ts"), p.groupby("k").v
    assert (g.n == p.groupby("k").cumcount() + 1).all()
    np.testing.assert_allclose(g.s, p.v.fillna(0).groupby(p.k).cumsum().where(g.s.notna()))
    np.testing.assert_allclose(g.mx, e.cummax().groupby(p.k).ffill())
    np.testing.assert_allclose(g.mn, e.cummin().groupby(p.k).ffill())
    np.testing.assert_allclose(g.l, e.ffill())
    np.testing.assert_allclose(g.before, e.cummax().groupby(p.k).ffill().groupby(p.k).shift())


def chunk_sizes(d, keys, order, ts, span, depth):
    """Rows of each chunk that ``running`` would form."""
    d = d.withColumn("_chunk", F.array(F.floor(ts / span).cast("long")))
    hot = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), prefix._sketch(prefix._numbers(d, order)[0]).alias("_sk")).where(F.col("_n") > depth)
    d, ranges = prefix.in_ranges(d, [*keys, "_chunk"], order, hot, depth)
    return [r["count"] for r in d.groupBy(*keys, "_chunk", *ranges).count().collect()]


def test_running_values_of_a_million_rows_in_one_second(spark):
    n = 1_000_000
    d = spark.range(n).select(F.lit("hot").alias("k"), (F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(77)).alias("ts"), F.concat(F.lit("e"), F.lpad(F.col("id"), 8, "0")).alias("tag"),
                              (F.col("id") * 7919 % 1_000_003).alias("no"), (F.col("id") % 1000).alias("v"))
    d = d.unionByName(d.where("no % 100000 = 7").withColumn("k", F.lit("cold")))
    g = running(d, ["k"], ["ts", "no"], [Run("n", "count", F.lit(1)), Run("s", "sum", F.col("v"))], F.col("ts"), 10 ** 7)
    order = Window.partitionBy("k").orderBy("ts", "no")
    want = d.withColumns({"n": F.count(F.lit(1)).over(order), "s": F.sum("v").over(order)})
    assert g.exceptAll(want).isEmpty() and g.count() == want.count()
    sizes = chunk_sizes(d, ["k"], ["ts", "no"], F.col("ts"), 10 ** 7, 20_000)
    assert max(sizes) < 60_000 and sum(sizes) == d.count() and len(sizes) > 40


@pytest.mark.parametrize("depth", [1, 7, 100])
def test_running_values_in_ranges_of_any_depth(spark, depth):
    """Ties in the first order column, strings, nulls and dates in the next ones."""
    r = np.random.default_rng(depth)
    p = pd.DataFrame({"k": r.choice(["a", "b"], 600, p=[.9, .1]), "ts": np.where(r.random(600) < .5, 5, r.integers(0, 300, 600)), "s": r.choice(["", "é", "same prefix 1", "same prefix 2", None], 600),
                      "v": r.integers(-5, 9, 600)}).reset_index(names="no")
    d = spark.createDataFrame(p).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("no") % 3).cast("int"))).withColumn("big", F.when(F.col("no") % 4 > 0, F.lit(1 << 60) + F.col("no") % 2))
    order = ["ts", "day", "big", "s", "no"]
    g = running(d, ["k"], order, [Run("n", "count", F.lit(1)), Run("s1", "sum", F.col("v"), inclusive=False), Run("mx", "max", F.col("v")), Run("l", "last", F.when(F.col("v") > 0, F.col("no")))], F.col("ts"), 100, depth)
    w = Window.partitionBy("k").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumns({"n": F.count(F.lit(1)).over(upto), "s1": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), "mx": F.max("v").over(upto),
                          "l": F.last(F.when(F.col("v") > 0, F.col("no")), ignorenulls=True).over(upto)})
    assert g.exceptAll(want).isEmpty() and g.count() == 600


def test_running_values_in_more_ranges_than_rows_are_compared_with(spark, monkeypatch):
    """Few values and a null in the first order column, every row three times: chunks come from a sort, not from cut points."""
    monkeypatch.setattr(prefix, "in_ranges", lambda *a: pytest.fail("rows held against every cut point"))
    d = spark.range(8000).select(F.when(F.col("id") % 40 > 0, "hot").otherwise("cold").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("ts"), F.concat(F.lit("same text up to here "), F.col("id") * 7919 % 8009).alias("s"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 101 - 50).alias("v")).withColumn("copy", F.explode(F.lit([1, 2, 3]))).drop("copy")
    order, depth = ["ts", "s"], 20
    runs = [Run("n", "count", F.lit(1)), Run("total", "sum", F.col("v")), Run("before", "max", F.col("v"), inclusive=False), Run("lo", "min", F.col("v")), Run("l", "last", F.when(F.col("v") > 40, F.col("s")))]
    g = running(d, ["k"], order, runs, F.lit(0), 1, depth)
    w = Window.partitionBy("k").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumns({"n": F.count(F.lit(1)).over(upto), "total": F.sum("v").over(upto), "before": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), "lo": F.min("v").over(upto),
                          "l": F.last(F.when(F.col("v") > 40, F.col("s")), ignorenulls=True).over(upto)})
    assert g.columns == want.columns and g.exceptAll(want).isEmpty() and g.count() == 24000
    sizes = [r["count"] for r in prefix.by_position(d, ["k"], order, depth).groupBy("k", prefix.CHUNK).count().collect()]
    assert max(sizes) == depth and sum(sizes) == 24000


def test_streaks_and_drawdown(spark):
    p = series(3, nulls=0)
    d = row_index(frame(spark, p), ["k"], ["ts"], F.col("ts"), 3600)
    g = back(run_length(d, ["k"], ["ts"], F.col("v") > 0, "len", F.col("ts"), 3600), "k", "ts")
    want, worst = [], {}
    for k, q in p.groupby("k"):
        c = 0
        for v in q.v:
            c = c + 1 if v > 0 else 0
            want.append(c)
            worst[k] = max(worst.get(k, 0), c)
    assert list(g.len) == want
    assert {r.k: r.w for r in max_streak(d, ["k"], ["ts"], F.col("v") > 0, "w", F.col("ts"), 3600).collect()} == worst
    x = back(drawdown(frame(spark, p.assign(r=p.v / 100)), ["k"], ["ts"], "r", F.col("ts"), 3600), "k", "ts")
    eq = (1 + p.v / 100).groupby(p.k).cumprod()
    np.testing.assert_allclose(x.drawdown, eq / eq.groupby(p.k).cummax() - 1, atol=1e-12)


def test_asof_takes_rows_with_null_payload(spark):
    p, r = series(1), series(2, n=120)
    got = back(asof_join(frame(spark, p), frame(spark, r.rename(columns={"v": "w"})), ["k"], ["w"], span=3600), "k", "ts")
    want = pd.merge_asof(p.sort_values("ts"), r.rename(columns={"v": "w"}).sort_values("ts"), on="ts", by="k").sort_values(["k", "ts"])
    np.testing.assert_allclose(got.w, want.w)


def test_asof_many_series_and_index(spark):
    p, r, q = series(1), series(2, n=120), series(5, n=60)
    got = back(asof_join_many(frame(spark, p), {"x": frame(spark, r.rename(columns={"v": "w"})), "y": frame(spark, q.rename(columns={"v": "u"}))},
                              ["k"], span=3600, index="idx"), "k", "ts")
    for c, s in (("w", r), ("u", q)):
        want = pd.merge_asof(p.sort_values("ts"), s.rename(columns={"v": c}).sort_values("ts"), on="ts", by="k").sort_values(["k", "ts"])
        np.testing.assert_allclose(got[c], want[c])
    assert (got.idx == p.groupby("k").cumcount()).all()


@pytest.mark.parametrize("block", [40, 64, 1000])
def test_blocks_equal_plain_window(spark, block):
    p = series(7)
    d = frame(spark, p)

    def cols(x, w):
        v = F.col("v")
        return x.withColumns({"m": W.mean(v, w, 12), "s": W.std(v, w, 20), "pm": W.prior_max(v, w, 12), "f": W.forward_return(v, w, 5, 1),
                              "rk": W.pct_rank(v, w, 15, 5), "fl": W.flip(F.signum(v), w), "q": W.quantile(v, .3, w, 9, 3)})
    a = back(in_blocks(d, ["k"], cols, back=25, forward=6, span=3600, block=block), "k", "ts")
    b = back(cols(d, Window.partitionBy("k").orderBy("ts")), "k", "ts")
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])


def test_long_rolling_matches_pandas(spark):
    p = series(9, nulls=0)
    rolls = [Roll("r", "rank", "v", 60), Roll("q", "quantile", "v", 60, .8, 20), Roll("e", "ema", "v", 5), Roll("d", "diff", "e", 3), Roll("sd", "std", "v", 30)]
    g = back(in_blocks(frame(spark, p), ["k"], lambda x, w: long_rolling(x, ["k"], rolls), back=back_rows(rolls), span=3600, block=150), "k", "ts")
    by = p.groupby("k").v
    np.testing.assert_allclose(g.r, by.transform(lambda s: s.rolling(60).rank(pct=True)))
    np.testing.assert_allclose(g.q, by.transform(lambda s: s.rolling(60, min_periods=20).quantile(.8)))
    ema = by.transform(lambda s: s.ewm(span=5, adjust=False).mean())
    np.testing.assert_allclose(g.e, ema, atol=1e-12)
    np.testing.assert_allclose(g.d, ema.groupby(p.k).diff(3), atol=1e-12)


def test_quantiles_with_heavy_ties(spark):
    r = np.random.default_rng(4)
    p = pd.DataFrame({"k": r.choice(["a", "b"], 4000, p=[.9, .1]), "v": r.choice([0.0, 0.0, 0.0, 1.5, 2.5, -1.0], 4000) + (r.random(4000) < .2) * r.normal(size=4000)})
    qs = {"q0": 0.0, "q3": .3, "q5": .5, "q97": .97, "q1": 1.0}
    g = exact_quantiles(spark.createDataFrame(p), ["k"], "v", qs, depth=50).toPandas().set_index("k").sort_index()
    for n, q in qs.items():
        np.testing.assert_allclose(g[n], p.groupby("k").v.quantile(q).sort_index())
    t = top_sum(spark.createDataFrame(p), ["k"], "v", .1, "t", depth=50).toPandas().set_index("k").t
    for k, s in p.groupby("k").v:
        n = int(np.ceil(.1 * len(s)))
        assert abs(t[k] - s.sort_values().tail(n).sum()) < 1e-9


def test_quantiles_of_a_million_equal_values(spark):
    """Ties are one row of the histogram; many different values are cut in ranges; null keys and empty tables give nothing."""
    n = 1_000_000
    same = spark.range(n).select(F.lit("t").alias("k"), F.lit(2.5).alias("v"))
    wide = spark.range(3000).select(F.lit("w").alias("k"), (F.col("id") * 7919 % 3000).cast("double").alias("v"))
    odd = spark.createDataFrame([(None, 1.0), ("n", None), ("o", 4.0)], "k string, v double")
    df = same.unionByName(wide).unionByName(odd)
    g = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": .1, "b": .5}, depth=200).collect()}
    assert set(g) == {"t", "w", "o"} and (g["t"].a, g["t"].b, g["o"].b) == (2.5, 2.5, 4.0)
    np.testing.assert_allclose([g["w"].a, g["w"].b], [299.9, 1499.5])
    t = {r.k: r.t for r in top_sum(df, ["k"], "v", .1, "t", depth=200).collect()}
    assert t == {"t": 250_000.0, "w": float(sum(range(2700, 3000))), "o": 4.0}
    assert ranked(same, ["k"], "v").count() == 1 and exact_quantiles(df.limit(0), ["k"], "v", {"a": .5}).count() == 0
    assert exact_quantiles(wide.select("v"), [], "v", {"a": .5}).collect()[0].a == 1499.5


def test_bootstrap_blocks_keep_the_distribution(spark):
    r = np.random.default_rng(6)
    p = pd.DataFrame({"k": "a", "ts": range(3000), "gross_r": r.normal(.001, .01, 3000)})
    d = spark.createDataFrame(p)
    one = bootstrap_ci(bootstrap_means(d, ["k"], "gross_r", ["ts"], 400, 1), ["k"]).where("mode = 'gross'").first()
    many = bootstrap_means(d, ["k"], "gross_r", ["ts"], 400, 1, block=256)
    m = np.array(many.first().means)
    ref = r.choice(p.gross_r.to_numpy(), (400, 3000)).mean(1)
    assert len(m) == 400
    assert abs(m.mean() - p.gross_r.mean()) < 4e-5 and abs(m.std() / ref.std() - 1) < .2
    assert abs(one.mean_ci_low - np.quantile(ref, .025)) < 1e-4


def test_walkforward_counts_empty_folds(spark):
    D = 86400
    ts = [0, 61 * D, 62 * D, 100 * D, 140 * D]
    d = spark.createDataFrame([("x", t, .01) for t in ts], "k string, ts long, gross_r double")
    f = folds(d, ["k"], 60, 15, 15).orderBy("fold_id").collect()
    assert [r.test_start // D for r in f] == [60, 75, 90, 105, 120]
    w = walkforward(d, ["k"]).where("mode = 'gross'").first()
    assert (w.wf_n, w.total_folds, w.positive_folds) == (3, 5, 2)


def test_binomial_shares():
    from barlab.operators.stats import binomial, leaf_draws
    u = (np.arange(200_000) + .5) / 200_000
    for k, p in ((0, .5), (1, .3), (7, .5), (50, .9), (4000, .25)):
        x = binomial(np.full(len(u), k), p, u)
        assert x.min() >= 0 and x.max() <= k
        assert x.mean() == pytest.approx(k * p, abs=.01 * max(1, k) ** .5) and x.var() == pytest.approx(k * p * (1 - p), rel=.02, abs=1e-3)
    n = 10_037
    cnt = np.array([leaf_draws(n, 64, c, 300, 7) for c in range(-(-n // 64))])
    assert (cnt.sum(axis=0) == n).all() and (cnt >= 0).all()
    assert cnt[:-1].mean() == pytest.approx(64, rel=.01) and cnt[:-1].var() == pytest.approx(64, rel=.05) and cnt[-1].mean() == pytest.approx(n % 64, rel=.1)


def _plain_draws(n, leaf, cell, iters, seed):
    """The tree walked from its root for one leaf, one step of the binomial sum at a time."""
    from math import exp, lgamma, log

    from barlab.operators.stats import _draw

    def one(k, p, u):
        up = down = out = min(int((k + 1) * p), k)
        above = below = total = exp(lgamma(k + 1) - lgamma(up + 1) - lgamma(k - up + 1) + up * log(p) + (k - up) * log(1 - p))
        while u >= total and (up < k or down > 0):
            above, up = above * (k - up) / (up + 1) * p / (1 - p), up + 1
            total, out = total + above, up
            if u >= total:
                below, down = below * down / (k - down + 1) * (1 - p) / p, down - 1
                total, out = total + below, down
        return out
    k = [n] * iters
    lo, hi = 0, n
    while hi - lo > leaf:
        mid = lo + leaf
        while lo + 2 * (mid - lo) < hi:
            mid = lo + 2 * (mid - lo)
        u = [_draw(np.array([b * 1000003 + (lo * 31 + hi) * 7919 + (seed + 1) * 104729]))[0] / 2 ** 31 for b in range(iters)]
        left = [one(x, (mid - lo) / (hi - lo), y) for x, y in zip(k, u)]
        lo, hi, k = (lo, mid, left) if cell * leaf < mid else (mid, hi, [x - y for x, y in zip(k, left)])
    return k


def test_shares_are_drawn_once_a_node(monkeypatch):
    """A walk over many leaves costs their nodes and one path, not a path for each leaf; any part gives the same numbers."""
    from barlab.operators import stats
    seen, draw = [], stats.binomial
    monkeypatch.setattr(stats, "binomial", lambda k, p, u: seen.append(len(k)) or draw(k, p, u))
    n, iters = 64 * 500 + 5, 9
    cnt = np.concatenate(list(stats.tree_draws(n, 64, 0, 501, iters, 3)))
    assert cnt.shape == (501, iters) and (cnt.sum(axis=0) == n).all() and sum(seen) == 500 * iters
    for c in (0, 1, 255, 256, 499, 500):
        assert cnt[c].tolist() == _plain_draws(n, 64, c, iters, 3) == stats.leaf_draws(n, 64, c, iters, 3).tolist()
    seen.clear()
    assert (np.concatenate(list(stats.tree_draws(n, 64, 100, 200, iters, 3))) == cnt[100:200]).all() and sum(seen) < 120 * iters
    many = 40_000                                        # more iterations than a subtree takes at once
    each = list(stats.tree_draws(700, 64, 3, 9, many, 3))
    assert len(each) == 6 and (np.concatenate(each)[:, :iters] == np.concatenate(list(stats.tree_draws(700, 64, 3, 9, iters, 3)))).all()


def test_bootstrap_by_blocks_equals_plain_draws(spark):
    """Groups of one and of many leaves, blocks of one leaf, of some and of the whole group, leaves cut by Arrow batches."""
    from barlab.operators.stats import BLOCK, _LEAF_STEP, _draw
    r = np.random.default_rng(8)
    rows = [(g, t, float(x)) for g, n in ((1, 7), (2, 50), (3, 51), (4, 777), (None, 60)) for t, x in enumerate(r.normal(size=n))]
    d = spark.createDataFrame(rows + [(2, 900, None)], "g long, ts long, x double").repartition(5)
    want = {}
    for g in (1, 2, 3, 4):
        x = [v for k, _, v in rows if k == g]
        s = np.zeros(12)
        for c in range(-(-len(x) // 50)):
            part = np.array(x[c * 50:c * 50 + 50])
            for b, k in enumerate(_plain_draws(len(x), 50, c, 12, 6)):
                u = _draw(b * 1000003 + np.arange(k) * 7919 + 6 * 104729 + c * _LEAF_STEP)
                s[b] += part[(u * len(part)) >> 31].sum()
        want[g] = np.sort(s / len(x))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for block, size in ((50, 17), (150, 1000), (1 << 30, 60), (BLOCK, 50)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {k.g: np.sort(k.means) for k in bootstrap_means(d, ["g"], "x", ["ts"], 12, 6, block, leaf=50).collect()}
            assert sorted(got) == sorted(want)
            for g in want:
                np.testing.assert_allclose(got[g], want[g], atol=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_bootstrap_order_with_nulls(spark):
    """Rows without an order value stand last in their block."""
    x = [float(i * i % 37) for i in range(90)]
    d = spark.createDataFrame([("a", None if i >= 85 else i, 0 if i < 85 else i, x[i]) for i in range(90)], "k string, ts long, id long, x double")
    e = spark.createDataFrame([("a", i, 0, x[i]) for i in range(90)], d.schema)
    got, want = (np.sort(bootstrap_means(t, ["k"], "x", ["ts", "id"], 30, 2, 1 << 30, leaf=16).first().means) for t in (d, e))
    np.testing.assert_allclose(got, want)
