"""Test inputs derived from the given tables, once as DataFrames and once as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlab.functions.scalar import epoch_seconds
from barlab.plans.frame import FrameConfig
from barlab.sources import derive, readers

# hourly bars play the fine grid and four hours the coarse one; windows shrink with the data
CFG = FrameConfig(step=3600, slow=14400, w_long=96, w_slow=24, w_spread=48, w_deriv=120, w_vwap=24, w_day=24,
                  min_day=12, w_corr=120, min_corr=36, chunk=86400 * 10, block=512, slow_block=128)
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
# every event type is base once and lead once
PAIRS = [("click", "view"), ("view", "purchase"), ("purchase", "signup"), ("signup", "error"), ("error", "click")]


def pair(spark, d) -> DataFrame:
    return readers.pair_bars(derive.event_bars(spark, d), PAIRS)


def slow(spark, d) -> dict[str, DataFrame]:
    """Side series of each pair from its own bars, every four hours."""
    p = readers.pair_bars(derive.event_bars(spark, d, 14400), PAIRS)
    c = F.col
    return {
        "funding": p.select("pair", "ts", ((c("close_btc") - 115) / 1e4).alias("funding_rate_btc"), ((c("close_eth") - 115) / 1e4).alias("funding_rate_eth")),
        "oi": p.select("pair", "ts", (c("volume_btc") * 3 + c("high_btc")).alias("oi_contracts_btc"), (c("volume_eth") * 3 + c("high_eth")).alias("oi_contracts_eth")),
        "liq": p.select("pair", "ts", *[((c(f"{x}_{a}") - 100)).alias(f"{s}_liq_usd_{a}") for a in ("btc", "eth") for s, x in (("long", "high"), ("short", "close"))]),
        "regime": p.select("pair", "ts", F.element_at(F.array(F.lit("TRENDING"), F.lit("RANGING"), F.lit("VOLATILE")), (F.pmod(c("ts") / 14400, F.lit(3)) + 1).cast("int")).alias("hmm_regime")),
    }


EB = lambda step=3600, name="eb": f"""{name} AS (
 SELECT event_type AS symbol, CAST(floor(epoch(ts)/{step}) AS BIGINT)*{step} AS ts,
  arg_min(100.0+value, (ts, event_id)) AS open, max(100.0+value) AS high, min(100.0+value) AS low,
  arg_max(100.0+value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM events GROUP BY 1, 2)"""

DB = """db AS (
 SELECT symbol, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(volume) AS volume
 FROM (SELECT l_returnflag AS symbol, CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_extendedprice/l_quantity AS price, l_quantity AS volume,
        (l_orderkey, l_linenumber, l_partkey, l_extendedprice/l_quantity) AS o FROM lineitem) GROUP BY 1, 2)"""

SUF = lambda t, s: ", ".join(f"{t}.{c} AS {c}_{s}" for c in ("open", "high", "low", "close", "volume"))
_LEGS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
PAIR = lambda eb="eb", name="pb": f"""{name} AS (
 SELECT r.base || '/' || r.lead AS pair, a.ts, {SUF('a', 'btc')}, {SUF('b', 'eth')}
 FROM (VALUES {_LEGS}) r(base, lead) JOIN {eb} a ON a.symbol = r.base JOIN {eb} b ON b.symbol = r.lead AND b.ts = a.ts)"""

SLOW = EB(14400, "eb4") + ",\n" + PAIR(eb="eb4", name="sb") + """,
sl AS (SELECT pair, ts, (close_btc-115)/1e4 AS funding_rate_btc, (close_eth-115)/1e4 AS funding_rate_eth,
  volume_btc*3+high_btc AS oi_contracts_btc, volume_eth*3+high_eth AS oi_contracts_eth,
  high_btc-100 AS long_liq_usd_btc, close_btc-100 AS short_liq_usd_btc, high_eth-100 AS long_liq_usd_eth, close_eth-100 AS short_liq_usd_eth,
  ['TRENDING','RANGING','VOLATILE'][CAST((ts//14400)%3 AS INT)+1] AS hmm_regime FROM sb)"""

# a ledger of trades from orders; the same expressions run in both engines
LEDGER = [
    ("trade_id", "o_orderkey"), ("strategy", "o_orderpriority"), ("entry_ts", "t"), ("exit_ts", "t + 86400*(1 + o_custkey % 20)"),
    ("entry_price", "100 + o_totalprice/10000"),
    ("exit_price", "(100 + o_totalprice/10000)*(1 + ((o_orderkey*7919) % 2001 - 1000)/100000.0e0)"),
    ("atr", "1 + (o_custkey % 50)/10.0e0"), ("er", "(o_custkey % 100)/100.0e0"),
    ("exit_reason", "CASE o_orderstatus WHEN 'F' THEN 'exit_stop_hit' WHEN 'O' THEN 'exit_time' ELSE 'exit_trail' END"),
    ("risk_usd", "CASE WHEN o_custkey % 7 = 0 THEN 0.0e0 ELSE 12*(1 + (o_custkey % 50)/10.0e0) END"),
    ("qty", "10.0e0"),
    ("pnl", "10.0e0*(100 + o_totalprice/10000)*((o_orderkey*7919) % 2001 - 1000)/100000.0e0 - 0.25e0"),
    ("net_return", "((o_orderkey*7919) % 2001 - 1000)/100000.0e0"),
    ("r_multiple", "((o_orderkey*31) % 601 - 300)/100.0e0"),
    ("mae_r", "-(o_orderkey % 100)/100.0e0"), ("mfe_r", "(o_orderkey % 130)/100.0e0"), ("bars_to_stop", "1 + o_custkey % 30"),
]


def ledger(spark, d) -> DataFrame:
    o = derive.read(spark, d, "orders").withColumn("t", epoch_seconds(F.col("o_orderdate")))
    t = o.selectExpr(*[f"{e} AS {n}" for n, e in LEDGER])
    return t.withColumn("equity_after", F.col("pnl") + 10000.0)


LG = "lg AS (SELECT *, pnl + 10000.0e0 AS equity_after FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LEDGER) + \
     " FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders)))"

# returns of strategies over time from orders, as rule events
def order_events(spark, d) -> DataFrame:
    o = derive.read(spark, d, "orders").withColumn("t", epoch_seconds(F.col("o_orderdate")))
    return o.selectExpr(*[f"{e} AS {n}" for n, e in ORDER_EVENTS])


ORDER_EVENTS = [("ev_id", "o_orderkey"), ("rule_id", "o_orderpriority"), ("ts", "t + (o_orderkey % 288)*300"),
                ("signal_dir", "CASE WHEN o_custkey % 3 = 0 THEN -1.0e0 ELSE 1.0e0 END"),
                ("gross_r", "((o_orderkey*7919) % 2001 - 980)/100000.0e0"), ("mae_proxy", "-((o_orderkey*31) % 601)/100000.0e0")]
OE = "oe AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ORDER_EVENTS) + " FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders))"

# six strategies on a common half-hour grid, for the portfolio rules
MEMBER = ["H76", "H77", "H79", "H81", "H78", "H82"]
MEMBER_SQL = [("ev_id", "event_id"), ("rule_id", "elt6"), ("family", "CASE WHEN event_id % 6 < 4 THEN 'cross_asset_regime' ELSE 'volume_state' END"),
              ("asset", "CASE WHEN event_id % 6 IN (1, 2) THEN 'ETH' ELSE 'BTC' END"), ("ts", "(t // 7200)*7200"),
              ("signal_dir", "CASE WHEN user_id % 5 < 2 THEN -1.0e0 ELSE 1.0e0 END"), ("gross_r", "(value - 20)/10000.0e0")]


def member_events(spark, d) -> DataFrame:
    """At most one event per (strategy, time): the first by id."""
    e = derive.read(spark, d, "events").withColumn("t", epoch_seconds(F.col("ts")))
    e = e.select("event_id", F.element_at(F.array(*[F.lit(m) for m in MEMBER]), (F.col("event_id") % 6 + 1).cast("int")).alias("elt6"), "user_id", "value",
                 F.expr("t div 7200 * 7200").alias("ts2"))
    e = e.selectExpr(*[f"{'ts2' if n == 'ts' else x} AS {n}" for n, x in MEMBER_SQL])
    return (e.groupBy("rule_id", "ts").agg(F.min_by(F.struct("family", "asset", "signal_dir", "gross_r"), "ev_id").alias("r"))
            .select("rule_id", "ts", "r.*"))


ME = "me AS (SELECT rule_id, ts, r.family AS family, r.asset AS asset, r.signal_dir AS signal_dir, r.gross_r AS gross_r FROM (SELECT rule_id, ts, arg_min({family: family, asset: asset, signal_dir: signal_dir, gross_r: gross_r}, ev_id) AS r FROM (SELECT " + \
     ", ".join(f"{x} AS {n}" for n, x in MEMBER_SQL) + " FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, ['H76','H77','H79','H81','H78','H82'][CAST(event_id % 6 AS INT)+1] AS elt6 FROM events)) GROUP BY 1, 2))"
