"""Policy goldens, risk clamp and the cooldown walk."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.plans import portfolio as PF

H = 3600


def events(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, family string, ts long, signal_dir double, gross_r double")


def passed(spark, ev, **policies):
    return PF.gated(PF.member_weights(ev, PF.policy_table(spark, policies)))


def test_members_drop_near_duplicate(spark):
    p = PF.policy_table(spark, {"P01": dict(candidate_universe=["H76", "H77", "H79"], dedup_keep="H77", dedup_drop="H79")})
    assert [r.rule_id for r in PF.members(p).orderBy("ord").collect()] == ["H76", "H77"]


def test_bad_policies(spark):
    with pytest.raises(ValueError, match="candidate_universe"):
        PF.policy_table(spark, {"P": {}})
    with pytest.raises(ValueError, match="unknown"):
        PF.policy_table(spark, {"P": dict(candidate_universe=["a"], typo=1)})


def test_rank_weights_fall_back_then_follow_scores(spark):
    # two times without usable history: equal weights; at the third only H76 has a positive score
    a = [.02, .01, .01]
    b = [-.02, -.01, .01]
    ev = events(spark, [(m, "f", 1_700_000_000 + i * H, 1.0, x) for m, v in (("H76", a), ("H77", b)) for i, x in enumerate(v)])
    w = passed(spark, ev, P02=dict(candidate_universe=["H76", "H77"], weighting_mode="rank_weight"))
    m = {r.rule_id: r.mean_weight for r in PF.heat_audit(w)["weights"].collect()}
    assert m["H76"] == pytest.approx(2 / 3) and m["H77"] == pytest.approx(1 / 3)


def test_consensus_gate_blocks_disagreement(spark):
    ev = events(spark, [("H76", "f", 0, 1.0, .1), ("H77", "f", 0, -1.0, .1), ("H78", "f", 0, 1.0, .1)])
    pol = dict(candidate_universe=["H76", "H77", "H78"], consensus_threshold=.67, min_active_members=3)
    assert PF.portfolio_events(passed(spark, ev, P03=pol)).count() == 0


def test_session_blend(spark):
    t = 1_700_006_400 // 86400 * 86400 + 9 * H
    ev = events(spark, [("H76", "f", t, 1.0, .1), ("H81", "f", t, 1.0, .1)])
    w = passed(spark, ev, P04=PF.POLICIES["P04"])
    assert {r.rule_id: r.weight for r in w.collect()} == pytest.approx({"H76": .6, "H81": .4})
    assert PF.portfolio_events(w).count() == 1


def clamp(rows, gross, asset, strat):
    w = np.array([r["signal_dir"] for r in rows])
    w = np.clip(w / abs(w).sum(), -strat, strat)
    if abs(w).sum() > gross:
        w = w * gross / abs(w).sum()
    net = {}
    for x, r in zip(w, rows):
        net[r["asset"]] = net.get(r["asset"], 0) + x
    return [x * (asset / abs(net[r["asset"]]) if abs(net[r["asset"]]) > asset else 1) for x, r in zip(w, rows)]


def sample(seed=1, n=400):
    r = np.random.default_rng(seed)
    p = pd.DataFrame({"scenario": "s", "rule_id": r.choice(["a", "b", "c", "d"], n), "ts": r.integers(0, 200, n) * 1800 + 86400 * 19000,
                      "signal_dir": r.choice([-1.0, 1.0], n), "gross_r": r.normal(0, .004, n).round(6)})
    p["asset"] = p.rule_id.map({"a": "X", "b": "X", "c": "Y", "d": "Y"})
    return p.drop_duplicates(["rule_id", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("cooldown", [0, 3])
def test_combined_run_matches_walk(spark, cooldown):
    p, cost, stop = sample(), .0002, .002
    t, c = PF.combine(spark.createDataFrame(p), ["scenario"], cost, .8, .3, .4, stop, cooldown=cooldown, step=1800)
    got = {r.ts: r.pnl for r in t.collect()}
    last, pnl, want = {}, {}, {}
    for ts, g in p.sort_values(["ts", "rule_id"]).groupby("ts"):
        day = ts // 86400
        if pnl.get(day, 0) <= -stop:
            continue
        rows = [x for x in g.to_dict("records") if not cooldown or ts - last.get(x["rule_id"], -10 ** 12) >= cooldown * 1800]
        if not rows:
            continue
        w = clamp(rows, .8, .3, .4)
        if not any(abs(x) > 1e-12 for x in w):
            continue
        want[ts] = sum(x * (r["gross_r"] - cost) for x, r in zip(w, rows))
        pnl[day] = pnl.get(day, 0) + want[ts]
        last.update({r["rule_id"]: ts for x, r in zip(w, rows) if abs(x) > 1e-12})
    assert got == pytest.approx(want)
    assert c.select("ts").distinct().count() == len(want)


def test_correlation_matches_pandas(spark):
    p = sample(5)
    d = PF.daily_pnl(spark.createDataFrame(p), 0.0)
    got = {(r.a, r.b): r.corr for r in PF.pair_correlation(d, ["a", "b", "c", "d"]).collect()}
    m = p.assign(day=p.ts // 86400).pivot_table(index="day", columns="rule_id", values="gross_r", aggfunc="sum").fillna(0).corr()
    for a in "abcd":
        for b in "abcd":
            assert (a, b) not in got if a >= b else got[a, b] == pytest.approx(m.loc[a, b])


def walked(p, cost, stop, secs):
    """(scenario, ts) -> pnl of the plain walk with limits .8, .3 and .4."""
    out = {}
    for sc, q in p.groupby("scenario"):
        last, pnl = {}, {}
        for ts, g in q.sort_values(["ts", "rule_id"]).groupby("ts"):
            rows = [x for x in g.to_dict("records") if ts - last.get(x["rule_id"], -10 ** 12) >= secs]
            if pnl.get(ts // 86400, 0) <= -stop or not rows:
                continue
            w = clamp(rows, .8, .3, .4)
            if any(abs(x) > 1e-12 for x in w):
                out[sc, ts] = sum(x * (r["gross_r"] - cost) for x, r in zip(w, rows))
                pnl[ts // 86400] = pnl.get(ts // 86400, 0) + out[sc, ts]
                last.update({r["rule_id"]: ts for x, r in zip(w, rows) if abs(x) > 1e-12})
    return out


def busy(days, scenarios=("s", "t")):
    """A candidate every half hour, day and night."""
    r = np.random.default_rng(days)
    p = pd.DataFrame([(s, k, t * 1800 + 86400 * 19000) for s in scenarios for t in range(days * 48) for k in "abcd" if r.random() < .7], columns=["scenario", "rule_id", "ts"])
    p["signal_dir"], p["gross_r"] = r.choice([-1.0, 1.0], len(p)), r.normal(0, .002, len(p)).round(6)
    return p.assign(asset=p.rule_id.map({"a": "X", "b": "X", "c": "Y", "d": "Y"}))


@pytest.mark.parametrize("hours, days, most", [(2.5, 60, 12), (30, 6, 6)])
def test_cooldown_over_days_without_a_quiet_one(spark, hours, days, most):
    """The state of a day reaches into the next one, with 30 hours over it."""
    p, secs = busy(days), int(hours * H)
    rows, rounds = PF.cooldown_walk(spark.createDataFrame(p), ["scenario"], secs, .0002, .8, .3, .4, .02, True)
    t = rows.groupBy("scenario", "ts").agg(F.sum(F.col("weight") * (F.col("gross_r") - .0002)).alias("pnl"))
    want = walked(p, .0002, .02, secs)
    assert {(r.scenario, r.ts): r.pnl for r in t.collect()} == pytest.approx(want) and p.ts.floordiv(86400).nunique() == days
    assert 1 < rounds <= most


def test_cooldown_of_nothing(spark):
    e = spark.createDataFrame(busy(1)).limit(0)
    assert PF.combine(e, ["scenario"], .0002, cooldown=3)[0].count() == 0
