"""Keyed merges, parameters, the shared folder, the entry point."""
import os

import pytest
from pyspark.sql import functions as F

from barlab.functions.scalar import in_session, parse_hhmm
from barlab.operators.resample import timeframe_seconds
from barlab.operators.store import shared_folder
from barlab.plans.classify import classify, combine_status
from barlab.sources import sinks

D = "/root/testdata/sf0.001"


def test_upsert_prefers_updates_then_newest(spark):
    t = spark.createDataFrame([("a", 1, 10.0, 9), ("b", 1, 11.0, 9)], "k string, ts int, v double, ingested_at int")
    u = spark.createDataFrame([("a", 1, 20.0, 1), ("a", 1, 21.0, 2), ("c", 1, 30.0, 1)], t.schema)
    got = {r.k: r.v for r in sinks.upsert(t, u, ["k", "ts"]).collect()}
    assert got == {"a": 21.0, "b": 11.0, "c": 30.0}
    c = sinks.upsert_counts(t, u, ["k", "ts"]).first()
    assert (c.inserted, c.updated) == (1, 1)
    assert {r.k: r.v for r in sinks.insert_or_ignore(t, u, ["k", "ts"]).collect()} == {"c": 30.0}


def test_session_parsing(spark):
    for bad in ("8", "24:00", "aa:00", "08:60"):
        with pytest.raises(ValueError):
            parse_hhmm(bad)
    with pytest.raises(ValueError):
        in_session(F.col("ts"), "08:00", "08:00")
    d = spark.createDataFrame([(23 * 3600,), (5 * 3600,), (12 * 3600,)], "ts long")
    assert [r.x for r in d.select(in_session(F.col("ts"), "22:00", "06:00").alias("x")).collect()] == [True, True, False]
    assert timeframe_seconds("4h") == 14400


def test_shared_folder_reads_the_session(spark):
    assert os.path.isdir(shared_folder(spark))

    class Conf:
        def __init__(self, d):
            self.d = d

        def get(self, k, default=None):
            return self.d.get(k, default)

    class Fake:
        def __init__(self, **d):
            self.conf = Conf({k.replace("_", "."): v for k, v in d.items()})
    assert shared_folder(Fake(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_folder(Fake(spark_master="yarn"))


def test_classification_table(spark):
    rows = [("few", 40, .01, .001, 8, 80.0, .01, .001), ("short", 60, .01, .001, 4, 80.0, .01, .001), ("pass", 60, .01, .001, 8, 80.0, .01, .001),
            ("weak", 60, .01, -.001, 8, 80.0, .01, .001), ("bad_wf", 60, .01, .001, 8, 40.0, .01, .001), ("neg", 60, -.01, -.02, 8, 80.0, .01, .001),
            ("no_wf", 60, .01, .001, 8, 80.0, None, None), ("six", 60, .01, .001, 6, 80.0, .01, .001)]
    d = spark.createDataFrame(rows, "rule_id string, n int, mean double, mean_ci_low double, total_folds int, positive_pct double, wf_mean double, wf_mean_ci_low double")
    got = {r.rule_id: (r.baseline_status, r.wf_status, r.final_status) for r in classify(d).collect()}
    I = "INCONCLUSIVE"
    assert got == {"few": (I, I, I), "short": (I, I, I), "pass": ("PASS", "PASS", "PASS"), "weak": ("BORDERLINE", "PASS", "BORDERLINE"),
                   "bad_wf": ("PASS", "FAIL", "FAIL"), "neg": ("FAIL", "PASS", "FAIL"), "no_wf": ("PASS", I, I), "six": ("PASS", "BORDERLINE", "BORDERLINE")}
    x = spark.createDataFrame([("a", "PASS"), ("a", "INCONCLUSIVE"), ("b", "PASS"), ("b", "FAIL"), ("c", "BORDERLINE")], "r string, final_status string")
    assert {r.r: r.overall_status for r in combine_status(x, ["r"]).collect()} == {"a": I, "b": "FAIL", "c": "BORDERLINE"}


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() >= 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert set(E.QUERIES) - set(o) <= {"combined_with_cooldown"}


@pytest.mark.parametrize("name", ["bars_from_events", "thinning", "asof_slow_series", "portfolio_events", "daily_trade_metrics", "stream_bars"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as E
    from checks.run import compare, connect
    got = E.queries()[name](spark, D).toPandas()
    assert compare(got, connect(D).execute(E.oracle_sql()[name]).df()) == ""


def test_stored_tables_go_with_their_job(spark):
    import os

    from barlab.operators.store import job, stored
    with job(spark) as folder:
        d = stored(spark.range(10))
        assert d.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert stored(spark.range(3)).count() == 3


def test_live_stream_goes_on_after_a_restart(spark, tmp_path):
    from barlab.streaming import jobs as J
    rows = lambda a, b: spark.createDataFrame([("s", i) for i in range(a, b)], "symbol string, idx long")
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for a, b in ((0, 20), (20, 50)):
        rows(a, b).coalesce(1).write.mode("append").parquet(src)
        s = J.stream_thin(J.read_parquet(spark, src, rows(0, 1).schema), ["symbol"], 7)
        q = J.run_live(s, out, ck, "1 second")
        q.processAllAvailable()
        q.stop()
    assert sorted(r.idx for r in spark.read.parquet(out).collect()) == list(range(0, 50, 7))


def test_upsert_sink_stops_when_the_table_cannot_be_read(spark, tmp_path):
    import shutil

    from barlab.sources import versions
    from barlab.streaming import jobs as J
    sink = J.upsert_sink(f"{tmp_path}/t", ["k"], "v", parts=1)
    b = spark.createDataFrame([(1, 1, 5)], "k int, v int, x int")
    sink(b, 0)
    sink(b.withColumns({"v": b.v + 1, "x": b.x + 1}), 1)
    assert [r.x for r in versions.read(spark, f"{tmp_path}/t", b.schema).collect()] == [6]
    shutil.move(f"{tmp_path}/t/data/v=1", f"{tmp_path}/elsewhere")
    with pytest.raises(Exception):
        sink(b, 2)


def test_fold_plans_have_no_nested_loops(spark):
    from barlab.plans import mining as MN
    m = spark.createDataFrame([("a", 86400 * d + h * 3600, 0.1, 1.0) for d in range(40) for h in range(10)], "pair string, ts long, fwd_r_h double, x double")
    folds = MN.expanding_folds(m, 10, 5, 10, 10)
    for d in (folds, MN.sliding_folds(m, 30, 8, 3, 10, 5), MN.in_folds(m, folds)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    f = folds.collect()
    assert [r.n_train for r in f] == [100 + 50 * i for i in range(len(f))] and all(r.n_test == 50 for r in f)
