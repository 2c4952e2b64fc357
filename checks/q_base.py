"""Scans, sinks, joins, resampling, data quality."""
from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import functions as F

from barlab.functions import scalar as S
from barlab.operators.asof import asof_join
from barlab.operators.prefix import Run, running
from barlab.operators.resample import last_per_bin, resample
from barlab.operators.stats import expand
from barlab.operators.store import shared_folder, stored
from barlab.plans import features as feat
from barlab.plans import quality as Q
from barlab.sources import derive, readers, sinks

from .fixtures import DB, EB, PAIR, PAIRS, SUF, SYMBOLS
from .registry import R, query, r6, rx

OHLCV = "open, high, low, close, volume"


@query("bars_from_events", f"WITH {EB()} SELECT symbol, ts, {R('open','high','low','close','volume')} FROM eb")
def _(spark, d):
    return derive.event_bars(spark, d)


@query("daily_bars_from_items", f"WITH {DB} SELECT symbol, ts, {R('open','high','low','close','volume', places=9)} FROM db", places=9)
def _(spark, d):
    return derive.daily_bars(spark, d)


@query("bar_scan_star", """
WITH c AS (SELECT l_suppkey AS symbol_id, l_linenumber % 5 AS timeframe_id, CAST(epoch(l_shipdate) AS BIGINT) AS ts,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2,3)
SELECT s_name AS symbol, ts, round((low) + 3.14159e-08, 6)+0.0 AS open, round((high) + 3.14159e-08, 6)+0.0 AS high, round((low) + 3.14159e-08, 6)+0.0 AS low, round((high) + 3.14159e-08, 6)+0.0 AS close, round((volume) + 3.14159e-08, 6)+0.0 AS volume
FROM c JOIN supplier ON s_suppkey = symbol_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = timeframe_id
WHERE n_name = 'NATION_3' AND r_name = 'AMERICA' AND ts >= 852076800 AND ts < 915148800""")
def _(spark, d):
    li = derive.read(spark, d, "lineitem")
    c = (li.groupBy(F.col("l_suppkey").alias("symbol_id"), (F.col("l_linenumber") % 5).alias("timeframe_id"), S.epoch_seconds(F.col("l_shipdate")).alias("ts"))
         .agg(F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.sum("l_quantity").alias("volume"))
         .withColumns({"open": F.col("low"), "close": F.col("high")}))
    dims = {"symbols": derive.read(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_name").alias("symbol"), F.col("s_nationkey").alias("venue_id")),
            "venues": derive.read(spark, d, "nation").select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("venue")),
            "timeframes": derive.read(spark, d, "region").select(F.col("r_regionkey").alias("timeframe_id"), F.col("r_name").alias("timeframe"))}
    return readers.bars(c, dims, venue="NATION_3", timeframe="AMERICA", start=852076800, end=915148800)


@query("pair_bar_scan", f"WITH {EB()}, {PAIR()} SELECT pair, ts, " + R(*[f"{c}_{s}" for s in ("btc", "eth") for c in OHLCV.split(", ")]) + " FROM pb")
def _(spark, d):
    return readers.pair_bars(derive.event_bars(spark, d), PAIRS)


_SLOWROWS = """sr AS (SELECT o_orderstatus AS symbol, o_orderpriority AS venue, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
 avg(o_totalprice) AS rate, sum(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END) AS liq FROM orders GROUP BY 1,2,3)"""


def _slow_rows(spark, d):
    o = derive.read(spark, d, "orders")
    return (o.groupBy(F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("venue"), S.epoch_seconds(F.col("o_orderdate")).alias("ts"))
            .agg(F.avg("o_totalprice").alias("rate"), F.sum(F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice"))).alias("liq")))


@query("paired_series_scan", f"""WITH {_SLOWROWS} SELECT a.ts, a.venue, round((a.rate) + 3.14159e-08, 6)+0.0 AS rate_btc, round((coalesce(a.liq,0)) + 3.14159e-08, 6)+0.0 AS liq_btc,
 round((b.rate) + 3.14159e-08, 6)+0.0 AS rate_eth, round((coalesce(b.liq,0)) + 3.14159e-08, 6)+0.0 AS liq_eth FROM sr a JOIN sr b ON a.ts=b.ts AND a.venue=b.venue WHERE a.symbol='F' AND b.symbol='O'""")
def _(spark, d):
    return readers.paired_series(stored(_slow_rows(spark, d)), "F", "O", ["rate", "liq"], ["ts", "venue"], fill=0.0)


@query("merged_series_scan", f"""WITH {_SLOWROWS}, f AS (SELECT a.ts, avg(a.rate) AS f FROM sr a WHERE symbol='F' GROUP BY 1), o AS (SELECT ts, sum(liq) AS o FROM sr WHERE symbol='O' GROUP BY 1)
 SELECT f.ts, round((f.f) + 3.14159e-08, 6)+0.0 AS f, round((o.o) + 3.14159e-08, 6)+0.0 AS o FROM f JOIN o USING (ts)""")
def _(spark, d):
    s = stored(_slow_rows(spark, d))
    f = s.where("symbol = 'F'").groupBy("ts").agg(F.avg("rate").alias("f"))
    o = s.where("symbol = 'O'").groupBy("ts").agg(F.sum("liq").alias("o"))
    empty = readers.merged_series(f, o.where("ts < 0"))  # one side empty: the other comes back
    return readers.merged_series(empty, o)


@query("regime_label_scan", """SELECT symbol, ts, ['RANGING','TRENDING','VOLATILE'][CAST(n % 3 AS INT)+1] AS hmm_regime FROM
 (SELECT o_orderstatus AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS ts, count(*) AS n FROM orders GROUP BY 1,2) WHERE symbol = 'F'""")
def _(spark, d):
    o = derive.read(spark, d, "orders")
    l = o.groupBy(F.col("o_orderstatus").alias("symbol"), S.epoch_seconds(F.col("o_orderdate")).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    l = l.withColumn("regime_name", F.element_at(F.array(F.lit("RANGING"), F.lit("TRENDING"), F.lit("VOLATILE")), (F.col("n") % 3 + 1).cast("int")))
    return readers.regime_series(l, "F")


@query("closed_trade_scan", """SELECT o_orderkey AS position_id, o_orderpriority AS hypothesis, n AS hypothesis_trades, 'closed' AS status FROM orders
 JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) ON p = o_orderpriority WHERE o_orderstatus='F' AND o_orderpriority='5-LOW'""")
def _(spark, d):
    o = derive.read(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("position_id"), F.col("o_orderpriority").alias("hypothesis"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"))
    h = o.groupBy(F.col("o_orderpriority").alias("hypothesis")).agg(F.count(F.lit(1)).alias("hypothesis_trades"))
    return readers.closed_trades(p, h, "5-LOW")


@query("table_round_trips", f"""WITH {EB()} SELECT symbol, count(*) AS n, round((sum(close)) + 3.14159e-08, 4)+0.0 AS parquet_sum, round((sum(close)) + 3.14159e-08, 4)+0.0 AS csv_sum, round((sum(close)) + 3.14159e-08, 4)+0.0 AS json_sum FROM eb GROUP BY 1""")
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    root = f"{shared_folder(spark)}/barlab/trip-{uuid.uuid4().hex}"
    sinks.write_parquet(b, f"{root}/p", by=["symbol"])
    sinks.write_csv(b, f"{root}/c", by=["symbol"])
    sinks.write_documents(b, f"{root}/j")
    ddl = "ts long, open double, high double, low double, close double, volume double"
    p = readers.table(spark, f"{root}/p").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close") + 3.14159e-08, 4).alias("parquet_sum"))
    c = spark.read.schema(ddl + ", symbol string").option("header", True).csv(f"{root}/c").groupBy("symbol").agg(F.round(F.sum("close") + 3.14159e-08, 4).alias("csv_sum"))
    j = spark.read.schema("symbol string, " + ddl).json(f"{root}/j").groupBy("symbol").agg(F.round(F.sum("close") + 3.14159e-08, 4).alias("json_sum"))
    return p.join(c, "symbol").join(j, "symbol")


# --- keyed merges ---------------------------------------------------------------------------------------
_UP = """t AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)/3600) AS BIGINT)*3600 AS ts, value AS v, event_id AS ingested_at FROM events WHERE event_id % 3 <> 0),
u AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)/3600) AS BIGINT)*3600 AS ts, value AS v, event_id AS ingested_at FROM events WHERE event_id % 3 = 0),
tl AS (SELECT symbol, ts, arg_max(v, ingested_at) AS v FROM t GROUP BY 1,2), ul AS (SELECT symbol, ts, arg_max(v, ingested_at) AS v FROM u GROUP BY 1,2)"""


def _ticks(spark, d, which):
    e = derive.read(spark, d, "events").where(which)
    return e.select(F.col("event_type").alias("symbol"), S.floor_to(S.epoch_seconds(F.col("ts")), 3600).alias("ts"), F.col("value").alias("v"), F.col("event_id").alias("ingested_at"))


@query("bar_upsert", f"WITH {_UP} SELECT coalesce(ul.symbol, tl.symbol) AS symbol, coalesce(ul.ts, tl.ts) AS ts, round((coalesce(ul.v, tl.v)) + 3.14159e-08, 6)+0.0 AS v FROM tl FULL JOIN ul ON tl.symbol=ul.symbol AND tl.ts=ul.ts")
def _(spark, d):
    t, u = _ticks(spark, d, "event_id % 3 <> 0"), _ticks(spark, d, "event_id % 3 = 0")
    return sinks.upsert(t, u, ["symbol", "ts"]).drop("ingested_at")


@query("upsert_counts", f"WITH {_UP} SELECT count(*) FILTER (tl.ts IS NULL) AS inserted, count(tl.ts) AS updated FROM ul LEFT JOIN tl ON tl.symbol=ul.symbol AND tl.ts=ul.ts")
def _(spark, d):
    return sinks.upsert_counts(_ticks(spark, d, "event_id % 3 <> 0"), _ticks(spark, d, "event_id % 3 = 0"), ["symbol", "ts"])


@query("insert_or_ignore", f"WITH {_UP} SELECT u.symbol, u.ts, round((arg_min(u.v, u.ingested_at)) + 3.14159e-08, 6)+0.0 AS v, min(u.ingested_at) AS ingested_at FROM u WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.symbol=u.symbol AND tl.ts=u.ts) GROUP BY 1,2")
def _(spark, d):
    return sinks.insert_or_ignore(_ticks(spark, d, "event_id % 3 <> 0"), _ticks(spark, d, "event_id % 3 = 0"), ["symbol", "ts"])


@query("partition_rewrite", f"WITH {_UP} SELECT coalesce(ul.symbol, tl.symbol) AS symbol, count(*) AS n, round((sum(coalesce(ul.v, tl.v))) + 3.14159e-08, 4)+0.0 AS total FROM tl FULL JOIN ul ON tl.symbol=ul.symbol AND tl.ts=ul.ts GROUP BY 1")
def _(spark, d):
    path = f"{shared_folder(spark)}/barlab/rewrite-{uuid.uuid4().hex}"
    keys = ["symbol", "ts"]
    t = sinks.latest(_ticks(spark, d, "event_id % 3 <> 0"), keys, F.col("ingested_at"))
    sinks.rewrite_partitions(path, t, "symbol")
    u = _ticks(spark, d, "event_id % 3 = 0")
    merged = stored(sinks.upsert(spark.read.parquet(path).select(*t.columns), u, keys))
    sinks.rewrite_partitions(path, merged, "symbol")
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v") + 3.14159e-08, 4).alias("total"))


# --- projections ------------------------------------------------------------------------------------------
@query("scalar_labels", """
SELECT event_id, CASE WHEN value/100 >= 0.35 THEN 'trend' WHEN value/100 <= 0.25 THEN 'mean' ELSE 'uncertain' END AS regime,
 CASE WHEN value/400 < 0.1 THEN -1 WHEN value/400 >= 0.9 THEN 1 ELSE 0 END AS tail,
 CASE WHEN value >= 0 AND value < 10 THEN 'low' WHEN value >= 10 AND value < 50 THEN 'mid' WHEN value >= 50 AND value < 200 THEN 'high' END AS bin,
 CASE WHEN value/20 > 2.5 THEN '>2.5xATR' WHEN value/20 > 1.5 THEN '1.5-2.5xATR' ELSE '0-1.5xATR' END AS shock,
 CASE WHEN value > 20 THEN 'pos' WHEN value < 20 THEN 'neg' ELSE 'zero' END AS side,
 TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS num,
 (hour(ts)*60+minute(ts) >= 480 AND hour(ts)*60+minute(ts) < 1320) AS day_session, (hour(ts)*60+minute(ts) >= 1320 OR hour(ts)*60+minute(ts) < 360) AS night_session,
 (hour(ts) >= 7 AND hour(ts) < 11) OR (hour(ts) >= 13 AND hour(ts) < 17) AS busy, (isodow(ts)-1) AS weekday, day(ts) % 2 AS parity, strftime(ts, '%Y-%m') AS month,
 sign(value-20)::DOUBLE AS sgn, CAST(floor(epoch(ts)) AS BIGINT)//3600*3600 AS bar
FROM events""")
def _(spark, d):
    e = derive.read(spark, d, "events").withColumn("t", S.epoch_seconds(F.col("ts")))
    v, t = F.col("value"), F.col("t")
    return e.select(
        "event_id", S.trend_regime(v / 100).alias("regime"), S.tail_code(v / 400).alias("tail"), S.bucket(v, [0, 10, 50, 200], ["low", "mid", "high"]).alias("bin"),
        S.atr_shock_bucket(v / 20).alias("shock"), S.shock_side(v - 20).alias("side"),
        S.num(F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.col("event_id").cast("string"))).alias("num"),
        S.in_session(t, "08:00", "22:00").alias("day_session"), S.in_session(t, "22:00", "06:00").alias("night_session"), S.in_hours(t, (7, 11), (13, 17)).alias("busy"),
        S.weekday_of(t).alias("weekday"), (S.day_of_month(t) % 2).alias("parity"), S.month_label(t).alias("month"), F.signum(v - 20).alias("sgn"), S.floor_to(t, 3600).alias("bar"))


@query("cost_modes_and_fills", """
SELECT o_orderkey, m.mode, round(r - m.cost, 9)+0.0 AS net_r, round(CASE WHEN o_orderstatus='F' THEN p*1.0005 ELSE p*0.9995 END, 9)+0.0 AS fill, round(p*10*0.0005, 9)+0.0 AS cost_usd
FROM (SELECT *, ((o_orderkey*7919) % 2001 - 1000)/100000.0 AS r, o_totalprice/1000 AS p FROM orders)
CROSS JOIN (VALUES ('gross', 0.0), ('bps8', 0.0008), ('bps10', 0.0010), ('bps12', 0.0012), ('bps15', 0.0015)) m(mode, cost)""", places=9)
def _(spark, d):
    o = derive.read(spark, d, "orders").withColumns({"gross_r": ((F.col("o_orderkey") * 7919) % 2001 - 1000) / 100000.0, "p": F.col("o_totalprice") / 1000})
    x = S.with_cost_modes(o, {**S.COST_MODES, **S.STRESS_MODES})
    side = F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell")
    return x.select("o_orderkey", "mode", "net_r", S.fill_price(F.col("p"), 5.0, side).alias("fill"), S.trade_cost(F.col("p"), F.lit(10.0), 5.0).alias("cost_usd"))


# --- joins and resampling ----------------------------------------------------------------------------------
# one slow series of orders for each symbol, all orders in it
_SLOW = "(SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS symbol, avg(o_totalprice) AS rate, count(*) AS n FROM orders GROUP BY 1, 2)"


def _slow(spark, d):
    symbol = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    return derive.read(spark, d, "orders").groupBy(symbol.alias("symbol"), S.epoch_seconds(F.col("o_orderdate")).alias("ts")).agg(
        F.avg("o_totalprice").alias("r"), F.count(F.lit(1)).alias("n"))


@query("asof_slow_series", f"""WITH {DB}, s AS (SELECT ts, symbol, CASE WHEN n % 4 = 0 THEN NULL ELSE rate END AS rate, n FROM {_SLOW})
SELECT db.symbol, db.ts, round(close,9)+0.0 AS close, round(s.rate,9)+0.0 AS rate, s.n FROM db ASOF LEFT JOIN s ON db.symbol = s.symbol AND db.ts >= s.ts""", places=9)
def _(spark, d):
    b = stored(derive.daily_bars(spark, d).select("symbol", "ts", "close"))
    s = _slow(spark, d).withColumn("rate", F.when(F.col("n") % 4 != 0, F.col("r"))).drop("r")
    return asof_join(b, s, ["symbol"], ["rate", "n"], span=86400 * 200)


@query("forward_fill", f"""WITH {DB}, s AS (SELECT ts, symbol, CASE WHEN n % 2 = 0 THEN rate END AS rate FROM {_SLOW})
SELECT db.symbol, db.ts, round((last_value(rate IGNORE NULLS) OVER (PARTITION BY db.symbol ORDER BY db.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + 3.14159e-08, 6)+0.0 AS rate FROM db LEFT JOIN s ON db.ts = s.ts AND db.symbol = s.symbol""")
def _(spark, d):
    s = _slow(spark, d).select("symbol", "ts", F.when(F.col("n") % 2 == 0, F.col("r")).alias("r"))
    j = stored(derive.daily_bars(spark, d).select("symbol", "ts").join(s, ["symbol", "ts"], "left"))
    return running(j, ["symbol"], ["ts"], [Run("rate", "last", F.col("r"))], F.col("ts"), 86400 * 200).drop("r")


@query("running_in_ranges", f"""WITH x AS (SELECT l_returnflag, l_partkey % 3 AS m, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem), y AS (SELECT *, row_number() OVER w AS pos, {r6('sum(l_quantity) OVER w')} AS total, max(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 last_value(CASE WHEN l_quantity > 45 THEN l_orderkey END IGNORE NULLS) OVER w AS big FROM x WINDOW w AS (PARTITION BY l_returnflag ORDER BY m, l_shipdate, l_orderkey, l_linenumber))
SELECT l_returnflag, l_orderkey, l_linenumber, pos, total, {R('before')}, big FROM y""")
def _(spark, d):
    """All rows of a flag in one span, with three values of the first order column: chunks of about 500 rows come from
    the next ones."""
    x = derive.read(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 3).alias("m"), F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    q = F.col("l_quantity")
    runs = [Run("pos", "count", F.lit(1)), Run("total", "sum", q), Run("before", "max", q, inclusive=False), Run("big", "last", F.when(q > 45, F.col("l_orderkey")))]
    return running(x, ["l_returnflag"], ["m", "day", "l_orderkey", "l_linenumber"], runs, F.lit(0), 1, depth=500).select("l_returnflag", "l_orderkey", "l_linenumber", *[r.out for r in runs])


@query("resample_right", f"""WITH {EB()} SELECT symbol, (ts + 14399)//14400*14400 AS ts, {rx(open='arg_min(open, ts)', high='max(high)', low='min(low)', close='arg_max(close, ts)', volume='sum(volume)')} FROM eb GROUP BY 1, 2""")
def _(spark, d):
    return resample(derive.event_bars(spark, d), 14400, "right")


@query("resample_left", f"""WITH {EB()} SELECT symbol, ts//14400*14400 AS ts, {rx(open='arg_min(open, ts)', high='max(high)', low='min(low)', close='arg_max(close, ts)', volume='sum(volume)')} FROM eb GROUP BY 1, 2""")
def _(spark, d):
    return resample(derive.event_bars(spark, d), 14400, "left")


@query("last_close_per_bin", f"WITH {EB()}, {PAIR()} SELECT pair, ts//14400*14400 AS ts, {rx(close_btc='arg_max(close_btc, ts)', close_eth='arg_max(close_eth, ts)')} FROM pb GROUP BY 1, 2")
def _(spark, d):
    return last_per_bin(readers.pair_bars(derive.event_bars(spark, d), PAIRS), 14400, ["close_btc", "close_eth"], ["pair"])


# --- quality ----------------------------------------------------------------------------------------------
@query("bar_rejection", """WITH c AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT)//60*60 AS ts, value - 0.5 AS open, value AS high, value AS low, value AS close FROM events)
SELECT CASE WHEN ts % 300 <> 0 THEN 'misaligned' WHEN ts < 1704500000 OR ts > 1706000000 THEN 'out_of_chunk' WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non_positive_price' ELSE 'accepted' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def _(spark, d):
    e = derive.read(spark, d, "events")
    v = F.col("value")
    c = e.select("event_id", S.floor_to(S.epoch_seconds(F.col("ts")), 60).alias("ts"), (v - 0.5).alias("open"), v.alias("high"), v.alias("low"), v.alias("close"))
    return c.groupBy(F.coalesce(Q.reject_reason(300, 1704500000, 1706000000), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_run_counters", """WITH c AS (SELECT event_type AS run, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN value < 2 THEN 'rejected' WHEN event_id % 2 = 0 THEN 'inserted' ELSE 'upserted' END AS outcome FROM events)
SELECT run, count(*) FILTER (outcome='inserted') AS inserted, count(*) FILTER (outcome='upserted') AS upserted, count(*) FILTER (outcome='rejected') AS rejected, min(ts) FILTER (outcome<>'rejected') AS min_ts, max(ts) FILTER (outcome<>'rejected') AS max_ts FROM c GROUP BY 1""")
def _(spark, d):
    e = derive.read(spark, d, "events")
    c = e.select(F.col("event_type").alias("run"), S.epoch_seconds(F.col("ts")).alias("ts"), F.when(F.col("value") < 2, "rejected").when(F.col("event_id") % 2 == 0, "inserted").otherwise("upserted").alias("outcome"))
    return Q.ingest_counters(c, ["run"])


@query("bar_gaps", f"""WITH {EB()}, l AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM eb)
SELECT symbol, p + 3600 AS gap_start, ts - 3600 AS gap_end, (ts - p)//3600 - 1 AS missing FROM l WHERE ts - p > 3600""")
def _(spark, d):
    return Q.gaps(stored(derive.event_bars(spark, d)), 3600)


@query("missing_bars", f"""WITH {EB()}, l AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM eb)
SELECT symbol, unnest(range(p + 3600, ts, 3600)) AS ts FROM l WHERE ts - p > 3600""")
def _(spark, d):
    return Q.missing_bars(stored(derive.event_bars(spark, d)), 3600)


@query("quality_summary", f"""WITH {EB()} SELECT symbol, count(*) AS bars, min(ts) AS min_ts, max(ts) AS max_ts, (max(ts)-min(ts))//3600+1 AS expected, count(*) < (max(ts)-min(ts))//3600+1 AS gap,
 1706655600 + 60 - max(ts) AS lag_seconds, CASE WHEN 1706655660 - max(ts) <= 60 THEN 'green' WHEN 1706655660 - max(ts) <= 180 THEN 'yellow' ELSE 'red' END AS lag_status FROM eb GROUP BY 1""")
def _(spark, d):
    return Q.quality_summary(derive.event_bars(spark, d), 3600, 1706655660)


@query("source_available", f"""WITH {EB()} SELECT symbol, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS available FROM (VALUES ('click'), ('view'), ('absent')) r(symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM eb GROUP BY 1) USING (symbol)""")
def _(spark, d):
    return Q.source_available(derive.event_bars(spark, d), spark.createDataFrame([("click",), ("view",), ("absent",)], "symbol string"))


@query("stale_leg_gate", f"""WITH {EB(300)}, l AS (SELECT symbol, max(ts) AS t FROM eb GROUP BY 1)
SELECT a.symbol AS base, b.symbol AS lead, a.t AS base_ts, b.t AS lead_ts, a.t - b.t AS lag_seconds, a.t - b.t > 300 AS blocked FROM l a JOIN l b ON a.symbol <> b.symbol""")
def _(spark, d):
    """All ordered pairs."""
    return Q.stale_legs(derive.event_bars(spark, d, 300), spark.createDataFrame(list(permutations(SYMBOLS, 2)), "base string, lead string"))


@query("constraint_checks", """
SELECT 'check' AS kind, rule, count(*) AS n FROM (
 SELECT unnest([CASE WHEN NOT l_quantity > 1 THEN 'quantity_above_one' END, CASE WHEN NOT l_discount <= 0.09 THEN 'discount_limit' END, CASE WHEN NOT l_returnflag IN ('A','R') THEN 'flag_enum' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL GROUP BY 2
UNION ALL SELECT 'unique', 'order_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'reference', 'order_of_high_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, d):
    li = derive.read(spark, d, "lineitem")
    c = Q.check_rows(li, {"quantity_above_one": F.col("l_quantity") > 1, "discount_limit": F.col("l_discount") <= 0.09, "flag_enum": F.col("l_returnflag").isin("A", "R")}, ["l_orderkey"])
    one = lambda df, k, r: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), F.lit(r).alias("rule"), "n")
    cu = derive.read(spark, d, "customer").where("c_acctbal > 0")
    return (c.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("check").alias("kind"), "rule", "n")
            .unionByName(one(Q.check_unique(li, ["l_orderkey", "l_linenumber"]), "unique", "order_line"))
            .unionByName(one(Q.check_reference(derive.read(spark, d, "orders"), cu, "o_custkey", "c_custkey"), "reference", "order_of_high_customer")))


@query("key_parity", f"""WITH {EB()}, a AS (SELECT * FROM eb WHERE volume < 6), b AS (SELECT * FROM eb WHERE volume > 1),
m AS (SELECT symbol, count(*) AS n, array_to_string(list(ts ORDER BY ts)[1:10], ',') AS s FROM a ANTI JOIN b USING (symbol, ts) GROUP BY 1),
x AS (SELECT symbol, count(*) AS n, array_to_string(list(ts ORDER BY ts)[1:10], ',') AS s FROM b ANTI JOIN a USING (symbol, ts) GROUP BY 1)
SELECT symbol, coalesce(m.n,0) AS missing_count, coalesce(x.n,0) AS extra_count, coalesce(m.s,'') AS missing_sample, coalesce(x.s,'') AS extra_sample FROM (SELECT DISTINCT symbol FROM eb) LEFT JOIN m USING (symbol) LEFT JOIN x USING (symbol)""")
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    return Q.key_parity(b.where("volume < 6"), b.where("volume > 1"), ["symbol"], "ts")


_HX = "CAST(('0x' || substr(sha256(symbol || '|' || CAST(ts AS VARCHAR) || '|' || printf('%.8f', open) || '|' || printf('%.8f', close)), 1, 15)) AS BIGINT)"


@query("two_source_parity", f"""WITH {EB()}, h AS (SELECT *, {_HX} AS h FROM eb), g AS (SELECT symbol, count(*) AS a_count, count(*) FILTER (volume > 1) AS b_count, bit_xor(h) AS a_xor, CAST(sum(h) AS VARCHAR) AS a_sum, min(ts) AS a_min, max(ts) AS a_max,
  coalesce(bit_xor(h) FILTER (volume > 1), 0) AS b_xor, CAST(sum(h) FILTER (volume > 1) AS VARCHAR) AS b_sum FROM h GROUP BY 1)
SELECT symbol, a_count, b_count, a_xor, a_sum, a_min, a_max, b_xor, b_sum, a_xor = b_xor AND a_sum = b_sum AND a_count = b_count AS identical, a_count - b_count AS missing_count FROM g""")
def _(spark, d):
    b = stored(derive.event_bars(spark, d))
    return Q.table_parity(b, b.where("volume > 1"), ["symbol"], "ts", ["symbol", "ts", "open", "close"]).select("symbol", "a_count", "b_count", "a_xor", "a_sum", "a_min", "a_max", "b_xor", "b_sum", "identical", "missing_count")


@query("dataset_fingerprint", f"WITH {EB()} SELECT max(lo) AS start_ts, min(hi) AS end_ts, min(n) AS bar_count FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM eb WHERE symbol IN ('click','view') GROUP BY 1)")
def _(spark, d):
    return Q.dataset_fingerprint(derive.event_bars(spark, d), ["click", "view"])


@query("replay_reconcile", """WITH e AS (SELECT event_type AS strategy, CAST(floor(epoch(ts)) AS BIGINT) AS entry_ts, CAST(floor(epoch(ts)) AS BIGINT)+2400 AS exit_ts, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS signal_dir, event_id FROM events),
a AS (SELECT strategy, entry_ts + CASE WHEN event_id % 50 = 0 THEN 900 ELSE event_id % 200 END AS entry_ts, exit_ts, signal_dir, event_id FROM e WHERE event_id % 997 <> 0),
x AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_ts, exit_ts) AS i FROM (SELECT strategy, entry_ts, exit_ts, min(signal_dir) AS signal_dir FROM e GROUP BY 1,2,3)),
y AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_ts, exit_ts) AS i FROM (SELECT strategy, entry_ts, exit_ts, min(signal_dir) AS signal_dir FROM a GROUP BY 1,2,3)),
j AS (SELECT coalesce(x.strategy, y.strategy) AS strategy, x.entry_ts AS xe, y.entry_ts AS ye, abs(x.entry_ts-y.entry_ts) <= 300 AND abs(x.exit_ts-y.exit_ts) <= 300 AND x.signal_dir = y.signal_dir AS ok FROM x FULL JOIN y ON x.strategy=y.strategy AND x.i=y.i)
SELECT strategy, count(xe) AS expected, count(ye) AS actual, count(*) FILTER (xe IS NOT NULL AND ye IS NOT NULL AND ok) AS matches, count(*) FILTER (xe IS NOT NULL AND ye IS NOT NULL AND NOT ok) AS mismatches, count(*) FILTER (xe IS NULL OR ye IS NULL) AS length_gap FROM j GROUP BY 1""")
def _(spark, d):
    e = derive.read(spark, d, "events").select(F.col("event_type").alias("strategy"), S.epoch_seconds(F.col("ts")).alias("entry_ts"), "user_id", "event_id")
    e = e.withColumns({"exit_ts": F.col("entry_ts") + 2400, "signal_dir": F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)})
    a = e.where("event_id % 997 <> 0").withColumn("entry_ts", F.col("entry_ts") + F.when(F.col("event_id") % 50 == 0, 900).otherwise(F.col("event_id") % 200))
    one = lambda x: stored(x.groupBy("strategy", "entry_ts", "exit_ts").agg(F.min("signal_dir").alias("signal_dir")))
    return Q.reconcile(one(e), one(a), ["strategy"], 300, span=86400 * 5)


_METRICS = '"n": 1, "mean": 0.1, "ci_low": null, "ci_high": 1, "p_mean_gt_0": 0.5'
_WF = '{"aggregate": {"n": 1, "mean": 0, "mean_ci_low": null, "mean_ci_high": 1, "p_mean_gt_0": 1}, "positive_folds": {"count": 1, "pct": 2, "total": 3}, "folds": []}'
_CLS = '{"baseline_status": "PASS", "wf_status": "FAIL", "final_status": "PASS"}'
_BODIES = [  # one of these per event, by its id; every kind of failure is met
    '{"hypothesis_id": "H1", "baseline": {"gross": {"n": 1, "mean": null}}}',
    '{"hypothesis_id": "H1", "timestamp_utc": null, "dataset": [], "baseline": 3, "walkforward": "x", "mode_classification": [1]}',
    '{"hypothesis_id": "H1", "timestamp_utc": "t", "dataset": {"timeframe": "5m", "start_ts": 1, "end_ts": 2, "bar_count": 3.5, "db_path": "p", "db_last_modified": null, "primary_symbols": ["a"]}, '
    + '"baseline": {' + ", ".join(f'"{m}": {{{_METRICS}}}' for m in ("gross", "bps8", "bps10")) + '}, "walkforward": {"split": {"train_days": 60, "test_days": 15, "step_days": 15.0}, "modes": {'
    + ", ".join(f'"{m}": {_WF}' for m in ("gross", "bps8", "bps10")) + '}}, "mode_classification": {' + ", ".join(f'"{m}": {_CLS}' for m in ("gross", "bps8", "bps10")) + '}}',
    '{"dataset": {"bar_count": "many", "primary_symbols": {"a": 1}, "timeframe": null}, "walkforward": {"split": [], "modes": 7}, "mode_classification": {}}',
    '{"dataset": {"bar_count": true, "primary_symbols": []}, "walkforward": {"split": {"train_days": 30, "test_days": "15", "step_days": null}, "modes": {"gross": {"aggregate": {}, "positive_folds": {"pct": 1}, "folds": {}}, '
    + '"bps8": {"aggregate": [], "positive_folds": 1, "folds": []}, "bps10": null}}, "mode_classification": {"gross": {"baseline_status": 1, "wf_status": null, "final_status": "PASS"}, "bps8": []}}',
]


def _audit_sql() -> str:
    t = lambda p: f"json_type(j, '{p}')"
    obj, lst, txt = (lambda p, k=k: f"coalesce({t(p)} = '{k}', false)" for k in ("OBJECT", "ARRAY", "VARCHAR"))
    num = lambda p: f"coalesce({t(p)} IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"
    no = lambda p: f"{t(p)} IS NULL"
    f = [(no(f"$.{k}"), "missing_top_key", f"'{k}'") for k in ("hypothesis_id", "timestamp_utc", "dataset", "baseline", "walkforward", "mode_classification")]
    wrong = lambda p, r, d: f.append((f"NOT {obj(p)} AND NOT ({no(p)})", r, f"'{d} must be object'"))
    wrong("$.dataset", "dataset_type", "dataset")
    f.append((f"NOT {lst('$.dataset.primary_symbols')}", "missing_dataset_symbols", "'dataset.primary_symbols is required'"))
    f += [(no(f"$.dataset.{k}"), "missing_dataset_key", f"'{k}'") for k in ("timeframe", "start_ts", "end_ts", "bar_count", "db_path", "db_last_modified")]
    f.append((f"NOT ({no('$.dataset.bar_count')}) AND NOT {num('$.dataset.bar_count')}", "dataset_bar_count_type", "'bar_count must be numeric'"))
    wrong("$.baseline", "baseline_type", "baseline")
    wrong("$.walkforward", "walkforward_type", "walkforward")
    wrong("$.walkforward.split", "walkforward_split_type", "walkforward.split")
    for k, v in (("train_days", 60), ("test_days", 15), ("step_days", 15)):
        p = f"$.walkforward.split.{k}"
        f.append((f"({obj('$.walkforward.split')} OR {no('$.walkforward.split')}) AND NOT ({num(p)} AND coalesce(TRY_CAST(json_extract_string(j, '{p}') AS DOUBLE) = {v}, false))",
                  "walkforward_split_mismatch", f"'{k} expected {v}, got ' || coalesce(json_extract_string(j, '{p}'), 'None')"))
    wrong("$.walkforward.modes", "walkforward_modes_type", "walkforward.modes")
    wrong("$.mode_classification", "mode_classification_type", "mode_classification")
    for m in ("gross", "bps8", "bps10"):
        b, w, c = f"$.baseline.{m}", f"$.walkforward.modes.{m}", f"$.mode_classification.{m}"
        f.append((f"NOT {obj(b)}", "missing_baseline_mode", f"'{m}'"))
        f += [(f"{obj(b)} AND {no(f'{b}.{k}')}", "missing_baseline_metric", f"'{m}.{k}'") for k in ("n", "mean", "ci_low", "ci_high", "p_mean_gt_0")]
        f.append((f"NOT {obj(w)}", "missing_wf_mode", f"'{m}'"))
        for part, r, d, keys in ((f"{w}.aggregate", "missing_wf_aggregate", "missing_wf_aggregate_metric", ("n", "mean", "mean_ci_low", "mean_ci_high", "p_mean_gt_0")),
                                 (f"{w}.positive_folds", "missing_positive_folds", "missing_positive_folds_metric", ("count", "pct", "total"))):
            f.append((f"{obj(w)} AND NOT {obj(part)}", r, f"'{m}'"))
            f += [(f"{obj(w)} AND {obj(part)} AND {no(f'{part}.{k}')}", d, f"'{m}.{k}'") for k in keys]
        f.append((f"{obj(w)} AND NOT {lst(f'{w}.folds')}", "missing_folds_list", f"'{m}'"))
        f.append((f"{obj(w)} AND NOT {obj(c)}", "missing_mode_classification_mode", f"'{m}'"))
        f += [(f"{obj(w)} AND {obj(c)} AND NOT {txt(f'{c}.{k}')}", "missing_mode_classification_metric", f"'{m}.{k}'") for k in ("baseline_status", "wf_status", "final_status")]
    cases = ", ".join(f"CASE WHEN {c} THEN {{r: '{r}', d: {d}}} END" for c, r, d in f)
    bodies = " ".join(f"WHEN {i + 1} THEN '{b}'" for i, b in enumerate(_BODIES))
    return f"""WITH e AS (SELECT CASE event_id % 7 WHEN 0 THEN substr(props, 1, 5) {bodies} ELSE '{{"baseline": ' || props || '}}' END AS body FROM events),
p AS (SELECT CASE WHEN json_valid(body) THEN body::JSON END AS j, json_valid(body) AS ok FROM e),
f AS (SELECT 'json_parse' AS reason, '' AS detail FROM p WHERE NOT ok UNION ALL SELECT x.r, x.d FROM (SELECT unnest([{cases}]) AS x FROM p WHERE ok) WHERE x IS NOT NULL)
SELECT reason, detail, count(*) AS n FROM f GROUP BY 1, 2"""


@query("document_audit", _audit_sql())
def _(spark, d):
    e = derive.read(spark, d, "events")
    body, kind = None, F.col("event_id") % 7
    body = F.when(kind == 0, F.substring("props", 1, 5))
    for i, b in enumerate(_BODIES):
        body = body.when(kind == i + 1, b)
    body = body.otherwise(F.concat(F.lit('{"baseline": '), F.col("props"), F.lit("}")))
    docs = e.select(F.col("event_id").cast("string").alias("artifact"), body.alias("body"))
    return Q.audit_documents(docs).groupBy("reason", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("newest_rows", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, d):
    return sinks.newest_first(derive.read(spark, d, "events"), 500, tie="event_id").select("event_id", "event_type")


@query("newest_per_symbol", "SELECT event_type, arg_max(event_id, ts) AS event_id, round((arg_max(value, ts)) + 3.14159e-08, 6)+0.0 AS value FROM events GROUP BY 1")
def _(spark, d):
    return sinks.newest(derive.read(spark, d, "events").select("event_type", "ts", "event_id", "value"), "ts", ["event_type"]).select("event_type", "event_id", "value")
