"""Permutations, false-discovery adjustment and decaying resamples against plain numpy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import stats
from barlab.plans import validate as V


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1023, 4097])
def test_every_iteration_is_a_permutation(n):
    for t in (0, 1, 50):
        x = V.shuffled(np.arange(n), np.int64(n), np.int64(t), 42)
        assert sorted(x.tolist()) == list(range(n))


def test_permutations_mix():
    """Places are even over iterations, and the mean of permuted directions spreads as theory says."""
    n, t = 500, np.arange(4000)[:, None]
    x = V.shuffled(np.arange(n)[None, :], np.int64(n), t, 1)
    assert abs(x.mean(axis=0) - (n - 1) / 2).max() < 5 * n / 12 ** .5 / 4000 ** .5
    f = np.random.default_rng(3).normal(size=n)
    s = (np.where(x < 200, 1.0, -1.0) * f).mean(axis=1)
    d = 2 * .4 - 1
    assert s.mean() == pytest.approx(d * f.mean(), abs=.005) and s.std() == pytest.approx(f.std() * ((1 - d * d) / (n - 1)) ** .5, rel=.06)


def events(spark, seed=1):
    r = np.random.default_rng(seed)
    p = pd.DataFrame({"g": np.repeat(["luck", "skill"], 400), "id": np.arange(800), "signal_dir": r.choice([-1.0, 1.0, 0.0], 800, p=[.45, .45, .1])})
    p["gross_r"] = np.where(p.g == "skill", abs(p.signal_dir) * r.normal(.002, .004, 800), p.signal_dir * r.normal(0, .004, 800)).round(6)
    return spark.createDataFrame(p)


def test_skill_is_told_from_luck(spark):
    e = events(spark)
    e = e.unionByName(e.limit(3).withColumn("gross_r", F.lit(None).cast("double"))).unionByName(e.limit(1).withColumn("g", F.lit("one")))
    got = {r.g: r for r in V.permutation_test(e, ["g"], ["id"], 199).collect()}
    assert got["skill"].p_value == pytest.approx(1 / 200) and got["luck"].p_value > .05 and got["one"].n == 1 and got["one"].p_value == 1
    assert got["skill"].n == 400 and V.permutation_test(e.limit(0), ["g"], ["id"], 9).count() == 0


def test_false_discovery_adjustment(spark):
    p = [.01, .01, .02, .5, .5, .5, None, .03, 1.0, 1e-9]
    d = spark.createDataFrame([(i, "a" if i < 5 else "b", x) for i, x in enumerate(p)], "id int, fam string, p double")

    def plain(rows):
        rows = sorted((x, i) for i, x in rows if x is not None)
        out, low = {}, 1.0
        for k in range(len(rows), 0, -1):
            low = min(low, rows[k - 1][0] * len(rows) / k)
            out[rows[k - 1][1]] = (k, low)
        return out
    for within, groups in (((), [list(enumerate(p))]), (("fam",), [list(enumerate(p))[:5], list(enumerate(p))[5:]])):
        want = {i: v for g in groups for i, v in plain(g).items()}
        for depth in (1, 3, 100):
            got = {r.id: (r["rank"], pytest.approx(r.q_value)) for r in V.fdr_adjusted(d, "p", ["id"], within, depth).collect() if r.p is not None}
            assert got == want
    assert V.fdr_adjusted(d, "p", ["id"]).where("p is null and rank is null and q_value is null").count() == 1
    assert V.fdr_adjusted(d.limit(0), "p", ["id"]).count() == 0


def test_decaying_resamples(spark):
    """Blocks of any size give the same means, which centre on the weighted mean."""
    r = np.random.default_rng(4)
    p = pd.DataFrame({"g": "a", "ts": np.arange(1500) * 7200, "x": np.linspace(-1, 1, 1500) + r.normal(0, .1, 1500)})
    e = spark.createDataFrame(p)
    means = [np.sort(stats.bootstrap_means(e, ["g"], "x", ["ts"], 200, 5, block, 100, half_life=30).first()["means"]) for block in (100, 300, 10 ** 6)]
    np.testing.assert_allclose(means[0], means[1])
    np.testing.assert_allclose(means[0], means[2])
    w = .5 ** ((p.ts.max() - p.ts) / (30 * 86400))
    mean = (w * p.x).sum() / w.sum()
    sd = ((w * (p.x - mean) ** 2).sum() / w.sum()) ** .5
    assert means[0].mean() == pytest.approx(mean, abs=4 * sd / 1500 ** .5 / 200 ** .5) and means[0].std() == pytest.approx(sd / 1500 ** .5, rel=.25)
