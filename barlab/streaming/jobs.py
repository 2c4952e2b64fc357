"""Streams over bars: building, deduplicating, thinning, rolling features, as-of enrichment.

State is kept per symbol (or symbol and rule) in the state store, so a restart resumes from the
checkpoint with each bar processed once. Late rows beyond the watermark are dropped here and corrected by
the batch recomputation; ``replay_check`` compares the two.
"""
from __future__ import annotations

import uuid
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import shared_folder
from ..plans.quality import reconcile
from ..sources import versions


def read_parquet(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def stream_bars(ticks: DataFrame, step: str = "1 hour", late: str = "15 seconds", ts: str = "at") -> DataFrame:
    """Tumbling OHLCV bars from (symbol, at, event_id, price, volume) ticks, emitted once the safety lag
    behind the newest tick has passed the bar's end."""
    o = F.struct(ts, "event_id")
    return (ticks.withWatermark(ts, late).groupBy("symbol", F.window(ts, step).alias("w"))
            .agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"))
            .select("symbol", F.unix_timestamp("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def stream_distinct(rows: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """First arrival per key wins while the watermark keeps the key."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_thin(cands: DataFrame, by: Sequence[str], gap: int, pos: str = "idx") -> DataFrame:
    """Greedy thinning with the last kept position as state."""
    schema = cands.schema

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else -(10 ** 15)
        p = pd.concat(list(batches)).sort_values(pos)
        keep = []
        for i in p[pos]:
            ok = i - last >= gap
            keep.append(ok)
            last = int(i) if ok else last
        state.update((last,))
        yield p[keep]

    return cands.groupBy(*by).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


FEATURE_STATE = "ts array<long>, high array<double>, low array<double>, close array<double>, volume array<double>"


def stream_features(bars: DataFrame, keep: int = 64) -> DataFrame:
    """atr14, er20, rv48, vwap48 per closed bar from a ring buffer of the last bars per symbol."""
    names = ["ts", "high", "low", "close", "volume"]
    out = "symbol string, ts long, atr14 double, er20 double, rv48 double, vwap48 double"

    def step(key, batches, state: GroupState):
        new = pd.concat(list(batches)).sort_values("ts", ignore_index=True)[names]
        old = pd.DataFrame(dict(zip(names, state.get))) if state.exists else new.iloc[:0]
        p = pd.concat([old, new], ignore_index=True) if len(old) else new
        c, pc = p["close"], p["close"].shift(1)
        tr = pd.concat([p["high"] - p["low"], (p["high"] - pc).abs(), (p["low"] - pc).abs()], axis=1).max(axis=1)
        den = c.diff().abs().rolling(20).sum()
        tp = (p["high"] + p["low"] + c) / 3.0
        vol = p["volume"].rolling(48).sum()
        f = pd.DataFrame({"symbol": key[0], "ts": p["ts"], "atr14": tr.rolling(14).mean(),
                          "er20": (c - c.shift(20)).abs() / den.where(den != 0),
                          "rv48": np.log(c / pc).rolling(48).std(), "vwap48": (tp * p["volume"]).rolling(48).sum() / vol.where(vol != 0)})
        tail = p.tail(keep)
        state.update(tuple(tail[n].tolist() for n in names))
        yield f.tail(len(new))

    return bars.groupBy("symbol").applyInPandasWithState(step, out, FEATURE_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_stale(bars: DataFrame, pairs: DataFrame, limit: int = 300) -> DataFrame:
    """Per pair, the last time of each leg as state; a row per batch says whether the pair is blocked.
    ``pairs`` is static."""
    legs = pairs.select(F.explode(F.array(F.struct(F.col("base").alias("symbol"), F.lit(True).alias("is_base"), F.concat_ws("/", "base", "lead").alias("pair")),
                                          F.struct(F.col("lead").alias("symbol"), F.lit(False).alias("is_base"), F.concat_ws("/", "base", "lead").alias("pair")))).alias("l")).select("l.*")
    out = "pair string, base_ts long, lead_ts long, blocked boolean"

    def step(key, batches, state: GroupState):
        b, l = state.get if state.exists else (-1, -1)
        for p in batches:
            b = max([b, *p.loc[p["is_base"], "ts"]])
            l = max([l, *p.loc[~p["is_base"], "ts"]])
        state.update((int(b), int(l)))
        yield pd.DataFrame({"pair": [key[0]], "base_ts": [int(b)], "lead_ts": [int(l)], "blocked": [bool(b - l > limit)]})

    return (bars.select("symbol", "ts").join(legs, "symbol").groupBy("pair")
            .applyInPandasWithState(step, out, "b long, l long", "append", GroupStateTimeout.NoTimeout))


# --- sinks -------------------------------------------------------------------------------------------
def run_available(sdf: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> None:
    """Process everything available once, to a Parquet folder or batch function, and stop."""
    w = sdf.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", path).start()
    q.awaitTermination()


def run_to_table(sdf: DataFrame, root: str | None = None) -> DataFrame:
    """Run a stream over what is available and read its output table. A further call with the same ``root`` goes
    on from the checkpoint of the one before."""
    spark = sdf.sparkSession
    root = root or f"{shared_folder(spark)}/barlab/stream-{uuid.uuid4().hex}"
    run_available(sdf, f"{root}/checkpoint", path=f"{root}/out")
    return spark.read.schema(sdf.schema).parquet(f"{root}/out")


def run_live(sdf: DataFrame, path: str, checkpoint: str, every: str = "1 minute"):
    """The polling loop as a continuous query: one trigger per interval, resumable from the checkpoint."""
    return (sdf.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).format("parquet").option("path", path).start())


def upsert_sink(table: str, keys: Sequence[str], version: str, part: Column | None = None, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink into a ``sources.versions`` table: only the partitions that the batch touches are read and
    written anew, then one new manifest switches all of them at once. The newest ``version`` per key wins whatever the
    arrival order, so a replayed batch, or a whole stream replayed after its checkpoint was lost, changes nothing."""
    def write(batch: DataFrame, n: int) -> None:
        versions.merge(batch, table, keys, version, part, parts)
    return write


# --- as-of join in state -------------------------------------------------------------------------------
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class AsOf(StatefulProcessor):
    """Per key three states: bars waiting for the watermark, slow rows ahead of it, and the newest slow row behind it.
    A timer at the earliest row ahead fires once no row up to that time can still come; every slow row but the newest goes then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", "ts long, row string")
        self.ahead = handle.getListState("ahead", "ts long, row string")
        self.known = handle.getValueState("known", "ts long, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            for state, is_slow in ((self.ahead, True), (self.wait, False)):
                part = p[p["slow"] == is_slow]
                if len(part):
                    state.appendList(list(zip(part["ts"].tolist(), part["row"].tolist())))
                    self.handle.registerTimer(int(part["ts"].min()) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        bars, late = _split(self.wait, now)
        past, ahead = _split(self.ahead, now)
        slow = ([tuple(self.known.get())] if self.known.exists() else []) + past
        put_list(self.wait, late)
        put_list(self.ahead, ahead)
        b = pd.DataFrame(sorted(bars, key=lambda r: r[0]), columns=["ts", "bar"])
        s = pd.DataFrame(sorted(slow, key=lambda r: r[0]), columns=["ts", "row"]).astype({"ts": "int64"})
        if slow:
            self.known.update((int(s["ts"].iloc[-1]), s["row"].iloc[-1]))
        if late or ahead:
            self.handle.registerTimer(min(late + ahead)[0] * 1000)
        if not bars:
            return
        out = pd.merge_asof(b, s, on="ts")
        for i, k in enumerate(key):
            out.insert(i, f"k{i}", k)
        yield out.astype({"row": object}).where(out.notna(), None)

    def close(self) -> None:
        pass


def _split(state, now: int) -> tuple[list, list]:
    """Rows before ``now`` and the others."""
    rows = [tuple(r) for r in state.get()] if state.exists() else []
    return [r for r in rows if r[0] * 1000 < now], [r for r in rows if r[0] * 1000 >= now]


def put_list(state, rows: list) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def stream_asof(bars: DataFrame, slow: DataFrame, keys: Sequence[str], cols: Sequence[str], late: str, ts: str = "ts") -> DataFrame:
    """Each bar with ``cols`` of the newest slow row of its key at or before its time, both sides streams.

    A bar comes out once the watermark (``late`` behind the slower of the two streams) has passed it, so slow rows may
    arrive later than the bars they belong to. State per key: rows within the watermark and one slow row; nothing is
    read again. Bars before the first slow row get nulls, a slow row with null payload counts, rows with a null time
    or one not after 1970-01-01 are left out; slow rows are unique per key and time. Payloads travel as JSON, so every type but intervals and
    binary comes back as it was. The state lives in RocksDB: the provider is set on the session."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = [f"k{i}" for i in range(len(keys))]
    rest = [c for c in bars.columns if c not in keys and c != ts]

    def side(d: DataFrame, payload: Sequence[str], is_slow: bool) -> DataFrame:
        row = F.to_json(F.struct(*payload), JSON) if payload else F.lit("{}")
        d = d.where(F.col(ts).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.timestamp_seconds(ts).alias("at"),
                                                  F.col(ts).cast("long").alias("ts"), F.lit(is_slow).alias("slow"), row.alias("row"))
        return d.withWatermark("at", late)

    both = side(bars, rest, False).unionByName(side(slow, list(cols), True))
    ddl = T.StructType([*[T.StructField(n, bars.schema[k].dataType) for n, k in zip(names, keys)], T.StructField("ts", T.LongType()),
                        T.StructField("bar", T.StringType()), T.StructField("row", T.StringType())])
    out = both.groupBy(*names).transformWithStateInPandas(AsOf(), ddl, "append", "eventTime")
    for n, d, payload in (("bar", bars, rest), ("row", slow, list(cols))):
        out = out.withColumn(n, F.from_json(n, T.StructType([d.schema[c] for c in payload]), JSON))
    own = {**dict(zip(keys, names)), ts: "ts"}
    return out.select(*[(F.col(own[c]).cast(bars.schema[c].dataType) if c in own else F.col("bar")[c]).alias(c) for c in bars.columns],
                      *[F.col("row")[c].alias(c) for c in cols])


def replay_check(streamed: DataFrame, batch: DataFrame, by: Sequence[str], tol: int) -> DataFrame:
    """Streamed events against the batch recomputation, position by position."""
    return reconcile(batch, streamed, by, tol)
