"""Structured Streaming over the events table."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlab.functions.scalar import epoch_seconds
from barlab.operators.store import shared_folder, stored
from barlab.operators.thin import thin
from barlab.plans import features as feat
from barlab.sources import derive, versions
from barlab.streaming import jobs as J

from .fixtures import EB, PAIRS, _LEGS
from .q_features import BF, W1
from .registry import R, query, rx


def _streamed(spark, df, make, order="ts", parts=4, run=None):
    """``df`` arrives as files in order, one file per micro-batch; the query is stopped half-way and started again
    from its checkpoint."""
    root = f"{shared_folder(spark)}/barlab/stream-{uuid.uuid4().hex}"
    df = stored(df)
    at = F.col(order).cast("double")
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - lo) / ((hi - lo) / parts)), F.lit(parts - 1))
    for i in range(parts):
        df.where(part == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if i in (parts // 2 - 1, parts - 1):
            s = make(J.read_parquet(spark, f"{root}/in", df.schema, files_per_batch=1))
            out = run(s, root) if run else J.run_to_table(s, root)
    return out


def _ticks(spark, d):
    s = derive.read(spark, d, "events")
    return s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), "event_id",
                    (F.lit(100.0) + F.col("value")).alias("price"), F.lit(1.0).alias("volume"), "user_id")


_LATE = "(SELECT epoch(max(ts)) - 15 FROM events)"
_CLOSED = f"cb AS (SELECT * FROM eb WHERE ts + 3600 <= {_LATE})"


@query("stream_bars", f"WITH {EB()}, {_CLOSED} SELECT symbol, ts, {R('open','high','low','close','volume')} FROM cb")
def _(spark, d):
    return _streamed(spark, _ticks(spark, d), J.stream_bars, "at")


@query("stream_distinct", "SELECT user_id, count(*) AS n FROM (SELECT user_id, symbol FROM (SELECT user_id, event_type AS symbol FROM events) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    s = _streamed(spark, _ticks(spark, d).select("user_id", "symbol", "at"), lambda s: J.stream_distinct(s, ["user_id", "symbol"], "at", "60 days"), "at")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_features", f"WITH {EB()}, {BF} SELECT symbol, ts, {R('atr14','er20','rv48','vwap48')} FROM bf")
def _(spark, d):
    """Bars as a stream of files, features from the ring buffer; equal to the batch features."""
    return _streamed(spark, derive.event_bars(spark, d), J.stream_features)


_IX = f"ix AS (SELECT *, row_number() OVER ({W1}) - 1 AS idx FROM eb)"


def _cands(spark, d):
    from barlab.operators.prefix import row_index
    return row_index(stored(derive.event_bars(spark, d)), ["symbol"], ["ts"], F.col("ts"), 86400 * 10).where("volume >= 3").select("symbol", "ts", "idx")


@query("stream_thinning", f"""WITH RECURSIVE {EB()}, {_IX}, c AS (SELECT symbol, ts, idx FROM ix WHERE volume >= 3),
t AS (SELECT symbol, min(idx) AS idx FROM c GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(c.idx) FROM c WHERE c.symbol = t.symbol AND c.idx >= t.idx + 9) FROM t WHERE t.idx IS NOT NULL) SELECT c.symbol, c.ts, c.idx FROM t JOIN c ON t.symbol=c.symbol AND t.idx=c.idx""")
def _(spark, d):
    return _streamed(spark, _cands(spark, d), lambda s: J.stream_thin(s, ["symbol"], 9))


@query("stream_replay_check", f"""WITH RECURSIVE {EB()}, {_IX}, c AS (SELECT symbol, ts, idx FROM ix WHERE volume >= 3),
t AS (SELECT symbol, min(idx) AS idx FROM c GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(c.idx) FROM c WHERE c.symbol = t.symbol AND c.idx >= t.idx + 9) FROM t WHERE t.idx IS NOT NULL),
n AS (SELECT t.symbol, count(*) AS n FROM t WHERE idx IS NOT NULL GROUP BY 1) SELECT symbol, n AS expected, n AS actual, n AS matches, 0 AS mismatches, 0 AS length_gap FROM n""")
def _(spark, d):
    """The streamed thinning against the batch thinning of the same candidates."""
    c = stored(_cands(spark, d))
    as_trades = lambda x: x.select("symbol", F.col("ts").alias("entry_ts"), (F.col("ts") + 3600).alias("exit_ts"), F.lit(1).alias("signal_dir"))
    s = _streamed(spark, c, lambda s: J.stream_thin(s, ["symbol"], 9))
    return J.replay_check(stored(as_trades(s)), stored(as_trades(thin(c, ["symbol"], 9))), ["symbol"], 0)


@query("stream_stale_legs", f"""WITH {EB()}, l AS (SELECT symbol, max(ts) AS t FROM eb GROUP BY 1) SELECT base || '/' || lead AS pair, a.t AS base_ts, b.t AS lead_ts, a.t - b.t > 300 AS blocked FROM (VALUES {_LEGS}) p(base, lead) JOIN l a ON a.symbol=base JOIN l b ON b.symbol=lead""")
def _(spark, d):
    p = spark.createDataFrame(PAIRS, "base string, lead string")
    s = _streamed(spark, derive.event_bars(spark, d), lambda s: J.stream_stale(s, p))
    # every batch reports; times only grow, so the newest state is the largest
    return s.groupBy("pair").agg(F.max(F.struct("base_ts", "lead_ts", "blocked")).alias("s")).select("pair", "s.*")


@query("stream_upsert_sink", """SELECT event_type AS symbol, CAST(floor(epoch(ts)/3600) AS BIGINT)*3600 AS ts, round(arg_max(value, event_id) + 3.14159e-08, 6)+0.0 AS v FROM events GROUP BY 1, 2""")
def _(spark, d):
    """Four batches in any order of versions with a restart; then the checkpoint is lost and all is replayed."""
    root = f"{shared_folder(spark)}/barlab/su-{uuid.uuid4().hex}"
    e = derive.read(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.floor(epoch_seconds(F.col("ts")) / 3600) * 3600).alias("ts"), F.col("value").alias("v"), F.col("event_id").alias("version"))
    e = stored(e.withColumn("file", F.pmod(F.xxhash64("version"), F.lit(4))))
    sink = J.upsert_sink(f"{root}/t", ["symbol", "ts"], "version", F.floor(F.col("ts") / 864000))
    schema = e.drop("file").schema
    for i, checkpoint in ((0, "a"), (1, "a"), (2, "a"), (3, "a"), (None, "b")):
        if i is not None:
            e.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/in")
        if i in (1, 3, None):
            J.run_available(J.read_parquet(spark, f"{root}/in", schema, files_per_batch=1), f"{root}/{checkpoint}", batch=sink)
    return versions.read(spark, f"{root}/t", schema).select("symbol", "ts", "v")


@query("stream_asof_sink", f"""WITH {EB()}, {EB(14400, 'eb4')}, s AS (SELECT symbol, ts + 3600 AS ts, open AS rate FROM eb4),
w AS (SELECT least((SELECT max(ts) FROM eb), (SELECT max(ts) FROM s)) - 864000 AS t)
SELECT c.symbol, c.ts, {R('rate', t='s')} FROM (SELECT eb.* FROM eb, w WHERE eb.ts < w.t) c ASOF LEFT JOIN s ON c.symbol = s.symbol AND c.ts >= s.ts""")
def _(spark, d):
    """Every bar with the newest four-hour row of its symbol, an hour after its start. Every third slow row arrives eight
    days after its time; bars wait for the watermark."""
    b = derive.event_bars(spark, d).select("symbol", "ts", F.lit(None).cast("double").alias("rate"), F.lit(False).alias("is_slow"), F.col("ts").alias("arrives"))
    t = F.col("ts") + 3600
    s = derive.event_bars(spark, d, 14400).select("symbol", t.alias("ts"), F.col("open").alias("rate"), F.lit(True).alias("is_slow"),
                                                  F.when(F.floor(F.col("ts") / 14400) % 3 == 0, t + 8 * 86400).otherwise(t).alias("arrives"))
    return _streamed(spark, b.unionByName(s), lambda x: J.stream_asof(x.where("not is_slow").select("symbol", "ts"), x.where("is_slow"), ["symbol"], ["rate"], "10 days"), "arrives")
