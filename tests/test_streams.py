"""Versioned tables and the as-of join in state."""
import os
import random

from pyspark.sql import functions as F

from barlab.sources import versions
from barlab.streaming import jobs as J

DDL = "k long, day long, v long, x string"


def folders(root):
    return {os.path.join(a, d) for a, ds, _ in os.walk(f"{root}/data") for d in ds if d.startswith("_part=")}


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    t = f"{tmp_path}/t"
    day = F.col("day")
    assert versions.read(spark, t, spark.createDataFrame([], DDL).schema).count() == 0
    first = spark.createDataFrame([(k, k // 10, 1, f"a{k}") for k in range(100)] + [(500, None, 1, "no day")], DDL)
    assert versions.merge(first, t, ["k", "day"], "v", day) == [-1, *range(10)]
    before = folders(t)
    second = spark.createDataFrame([(30, 3, 2, "new"), (31, 3, 0, "old"), (32, 3, 1, "z tie"), (500, None, 2, None), (39, 3, 5, "twice"), (39, 3, 4, "less")], DDL)
    assert versions.merge(second, t, ["k", "day"], "v", day) == [-1, 3]
    assert {f[len(t):] for f in folders(t) - before} == {"/data/v=1/_part=3", "/data/v=1/_part=-1"}
    got = {(r.k, r.day): r.x for r in versions.read(spark, t, first.schema).collect()}
    assert got == {**{(k, k // 10): f"a{k}" for k in range(100)}, (30, 3): "new", (32, 3): "z tie", (39, 3): "twice", (500, None): None}
    assert versions.merge(second.limit(0), t, ["k", "day"], "v", day) == [] and versions.committed(spark, t) == [0, 1]
    assert versions.read(spark, t, first.schema, 0).where("x = 'new'").count() == 0


def test_replay_crash_and_cleaning(spark, tmp_path):
    t = f"{tmp_path}/t"
    b = [spark.createDataFrame([(k, 0, i, f"{i}-{k}") for k in range(i, 40, 2)], DDL) for i in range(3)]
    for x in b:
        versions.merge(x, t, ["k"], "v", parts=4)
    want = sorted(versions.read(spark, t, b[0].schema).collect())
    for x in (b[0], b[2], b[1]):      # a stream whose checkpoint was lost starts anew over the same table
        versions.merge(x, t, ["k"], "v", parts=4)
    assert sorted(versions.read(spark, t, b[0].schema).collect()) == want
    # a writer that died before its manifest was finished leaves nothing to see, and the next one takes its number
    os.makedirs(f"{t}/manifest/v=6")
    spark.createDataFrame([(1, 0, 99, "torn")], DDL).write.parquet(f"{t}/data/v=6/_part=0")
    assert versions.committed(spark, t) == list(range(6)) and sorted(versions.read(spark, t, b[0].schema).collect()) == want
    versions.merge(b[1], t, ["k"], "v", parts=4)
    assert versions.committed(spark, t)[-1] == 6 and sorted(versions.read(spark, t, b[0].schema).collect()) == want
    assert versions.drop_old(spark, t, 1) > 0 and versions.drop_old(spark, t, 1) == 0
    assert versions.committed(spark, t) == [6] and sorted(versions.read(spark, t, b[0].schema).collect()) == want


def test_asof_stream_waits_for_late_slow_rows(spark, tmp_path):
    """Six batches, a restart after each second one, slow rows up to 30 s late, types and null payloads kept."""
    rnd = random.Random(3)
    src, root = f"{tmp_path}/in", f"{tmp_path}/run"
    ddl = "symbol string, venue long, ts long, big long, note string, rate double, at_ timestamp, slow boolean, arrives long"
    bars = [(s, v, t, 2 ** 60 + t, None if t % 5 == 0 else f"n{t}", None, None, False, t) for s in ("a", "b", None) for v in (1, 2) for t in range(1, 120) if rnd.random() < 0.6]
    slow = [(s, v, t, None, None, None if t % 7 == 0 else t / 3, None, True, t + rnd.choice((0, 30))) for s in ("a", None) for v in (1, 2) for t in range(5, 120) if rnd.random() < 0.2]
    slow += [("only slow", 1, t, None, None, 1.0, None, True, t) for t in range(1, 50)]
    df = spark.createDataFrame(bars + slow, ddl).withColumn("at_", F.expr("timestamp_micros(ts * 1000001)"))
    for i in range(6):
        df.where((F.col("arrives") >= i * 20) & (F.col("arrives") < (i + 1 if i < 5 else 99) * 20)).coalesce(1).write.mode("append").parquet(src)
        if i % 2:
            x = J.read_parquet(spark, src, df.schema, files_per_batch=1)
            s = J.stream_asof(x.where("not slow").select("venue", "symbol", "ts", "big", "note"), x.where("slow"), ["symbol", "venue"], ["rate", "at_"], "35 seconds")
            out = J.run_to_table(s, root)
    assert out.columns == ["venue", "symbol", "ts", "big", "note", "rate", "at_"]
    at = {(r.symbol, r.venue, r.ts): r.at_ for r in df.where("slow").collect()}
    end = min(max(r[2] for r in bars), max(r[2] for r in slow)) - 35
    want = set()
    for s, v, t, big, note, *_ in bars:
        if t < end:
            past = [r for r in slow if r[:2] == (s, v) and r[2] <= t]
            r = max(past, key=lambda r: r[2]) if past else None
            want.add((v, s, t, big, note, r and r[5], r and at[r[:3]]))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and sum(g[5] is not None for g in got) > 50
