"""Bars and slow series derived from generic event, line-item and order tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import epoch_seconds
from ..operators.resample import ticks_to_bars


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), epoch_seconds(F.col("ts")).alias("ts"),
                    F.col("ts").alias("at"), "event_id", (F.lit(100.0) + F.col("value")).alias("price"),
                    F.lit(1.0).alias("volume"))


def event_bars(spark, sf_dir, step: int = 3600) -> DataFrame:
    """Bars per event type: price 100 + value, volume = number of events."""
    return ticks_to_bars(event_ticks(spark, sf_dir), step, order=("at", "event_id"))


def item_ticks(spark, sf_dir, symbol: str = "l_returnflag") -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col(symbol).cast("string").alias("symbol"), epoch_seconds(F.col("l_shipdate")).alias("ts"),
                     "l_orderkey", "l_linenumber", "l_partkey",
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                     F.col("l_quantity").alias("volume"))


def daily_bars(spark, sf_dir, symbol: str = "l_returnflag") -> DataFrame:
    """Daily bars per return flag (or supplier): unit price, quantity as volume."""
    return ticks_to_bars(item_ticks(spark, sf_dir, symbol), 86400,
                         order=("ts", "l_orderkey", "l_linenumber", "l_partkey", "price"))


def slow_series(spark, sf_dir) -> DataFrame:
    """Daily side series from orders: a centred mean price as a funding stand-in, order counts as open
    interest, value by status as the two liquidation sides."""
    o = read(spark, sf_dir, "orders")
    tp, st = F.col("o_totalprice"), F.col("o_orderstatus")
    return (o.groupBy(epoch_seconds(F.col("o_orderdate")).alias("ts"))
            .agg(((F.avg(tp) - 250000.0) / 1e9).alias("funding_rate"),
                 F.count(F.lit(1)).cast("double").alias("oi_contracts"),
                 F.sum(F.when(st == "O", tp).otherwise(0.0)).alias("long_liq_usd"),
                 F.sum(F.when(st == "F", tp).otherwise(0.0)).alias("short_liq_usd")))
