"""Mixtures of many groups against expectation maximisation written out for one group."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlab.operators import mixture
from barlab.plans import mining as MN


def one_group(x, k, iterations, tol):
    x = x - x.mean(0)
    sd = x.std(0, ddof=1)
    z = np.where(sd > 0, x / np.where(sd > 0, sd, 1), 0.0)
    d = z.shape[1]
    part = sum((x[:, 0] >= np.quantile(x[:, 0], i / k)).astype(int) for i in range(1, k))
    r, before = np.eye(k)[part], None
    for it in range(iterations + 1):
        w = r.sum(0)
        mu = (r.T @ z) / w[:, None]
        cov = [((z * r[:, [c]]).T @ z) / w[c] - np.outer(mu[c], mu[c]) for c in range(k)]
        p = np.stack([np.log(w[c] / len(z)) - np.linalg.slogdet(cov[c])[1] / 2 - ((z - mu[c]) @ np.linalg.inv(cov[c]) * (z - mu[c])).sum(1) / 2 for c in range(k)], 1)
        top = p.max(1)
        now = (top + np.log(np.exp(p - top[:, None]).sum(1))).mean()
        if before == "settled" or it == iterations:
            return p.argmax(1)
        if before is not None and now - before < tol / d:
            before = "settled"
        else:
            before = now
        r = np.exp(p - top[:, None])
        r /= r.sum(1, keepdims=True)


def blobs(sizes, seed):
    r = np.random.default_rng(seed)
    out = []
    for g, n in sizes.items():
        c = r.integers(0, 3, n)
        x = np.array([[0, 0], [4, 1], [9, -2]])[c] + r.normal(size=(n, 2)) @ np.array([[1, .4], [0, .7]])
        out.append(pd.DataFrame({"g": g, "a": x[:, 0] * 3 + 7, "b": x[:, 1]}))
    return pd.concat(out, ignore_index=True)


def test_mixtures_equal_single_fits(spark):
    p = blobs({"x": 900, "y": 150, "z": 60}, 3)
    df = spark.createDataFrame(p)
    models = mixture.fit(df, ["g"], ["a", "b"], 3)
    got = mixture.decode(df.withColumn("i", F.monotonically_increasing_id()), models, ["g"], ["a", "b"], 3).toPandas()
    for g, s in p.groupby("g"):
        o = got[got.g == g].sort_values("i")
        np.testing.assert_array_equal(o.a, s.a)
        assert (o.state.to_numpy() == one_group(s[["a", "b"]].to_numpy(), 3, 50, 1e-3)).mean() > 0.995


def test_mixture_odd_groups(spark):
    rows = [("same", 1.0, 2.0)] * 20 + [("one", 5.0, 5.0), ("two", 1.0, 1.0), ("two", 2.0, 1.0), ("null", None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    models = mixture.fit(df, ["g"], ["a", "b"], 3).toPandas().set_index("g")
    assert sorted(models.index) == ["one", "same", "two"] and models.n.to_dict() == {"one": 1, "same": 20, "two": 2}
    for c in ("mu", "li", "lw"):
        assert np.isfinite(np.concatenate(models[c].to_numpy())).all()
    assert mixture.fit(df.limit(0), ["g"], ["a", "b"], 3).count() == 0


def feats(spark, symbols, days=40):
    r = np.random.default_rng(8)
    n = days * 24
    p = pd.concat([pd.DataFrame({"symbol": s, "ts": np.arange(n) * 3600, "rv": r.choice([.1, .5, 1.], n) + r.random(n) * .1, "er": r.random(n)}) for s in symbols])
    return spark.createDataFrame(p)


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("mixture", "count")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixture"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_labels_of_many_symbols_take_the_jobs_of_one(spark):
    counts = []
    for symbols in (["A"], list("ABCDEFGH")):
        f = feats(spark, symbols)
        folds = MN.expanding_folds(f, 20, 10, 100, 30, keys=["symbol"])
        assert {tuple(r) for r in folds.groupBy("symbol").count().collect()} == {(s, 2) for s in symbols}
        got = []
        counts.append(jobs_of(spark, lambda: got.extend(MN.label_regimes(f, folds, ["rv", "er"]).collect())))
        assert len(got) == len(symbols) * 20 * 24
        assert {r.regime_name for r in got} == set(MN.REGIMES)
    print("jobs", counts)
    # rounds differ by group, jobs of a round do not
    assert counts[1] < 2.5 * counts[0]


def test_no_fold_gives_no_labels(spark):
    f = feats(spark, ["A"], 10)
    folds = MN.expanding_folds(f, 20, 10, keys=["symbol"])
    assert MN.label_regimes(f, folds, ["rv", "er"]).count() == 0 and MN.expanding_folds(f.limit(0), 5, 5).count() == 0
