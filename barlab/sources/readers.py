"""Scans. Each returns a lazy DataFrame whose filters and column lists reach the Parquet reader."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas

PRICES = ["open", "high", "low", "close", "volume"]
BATCH_FEATURES = ["atr14", "er20", "rv48", "vwap48"]
# a dimension is broadcast only below this many bytes on disk-estimated plan size
BROADCAST_LIMIT = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint guarded by the optimizer's own size estimate; larger inputs keep a shuffle join."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # no JVM handle (Connect): leave the choice to AQE
        return df
    return F.broadcast(df) if size <= BROADCAST_LIMIT else df


def table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def bars(candles: DataFrame, dims: dict[str, DataFrame] | None = None, venue: str | None = None,
         symbols: Sequence[str] | None = None, timeframe: str | None = None,
         start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of given symbols in [start, end). ``candles`` may hold surrogate keys (symbol_id,
    timeframe_id); then ``dims`` has symbols, venues and timeframes for the star join. ``ts`` is in
    epoch seconds. The cut-off is always a parameter."""
    d = candles
    if start is not None:
        d = d.where(F.col("ts") >= start)
    if end is not None:
        d = d.where(F.col("ts") < end)
    if dims:
        s = dims["symbols"].join(dims["venues"], "venue_id")
        if venue:
            s = s.where(F.col("venue") == venue)
        if symbols:
            s = s.where(F.col("symbol").isin(list(symbols)))
        t = dims["timeframes"]
        if timeframe:
            t = t.where(F.col("timeframe") == timeframe)
        d = d.join(small(s), "symbol_id").join(small(t), "timeframe_id")
    else:
        if symbols:
            d = d.where(F.col("symbol").isin(list(symbols)))
        if timeframe and "timeframe" in d.columns:
            d = d.where(F.col("timeframe") == timeframe)
    return d.select("symbol", "ts", *[F.col(c).cast("double") for c in PRICES])


def pivot_features(features: DataFrame, names: Sequence[str] = BATCH_FEATURES, version: str | None = None,
                   keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Long to wide with a fixed column list, so no pass is needed to discover the pivot values."""
    d = features.where(F.col("feature_name").isin(list(names)))
    if version:
        d = d.where(F.col("feature_version") == version)
    return d.groupBy(*keys).agg(*[
        F.max(F.when(F.col("feature_name") == n, F.col("feature_value"))).alias(n) for n in names])


def bars_with_features(bars_: DataFrame, features: DataFrame, version: str = "v1",
                       names: Sequence[str] = BATCH_FEATURES) -> DataFrame:
    return bars_.join(pivot_features(features, names, version), ["symbol", "ts"], "left")


def unpivot_features(wide: DataFrame, names: Sequence[str] = BATCH_FEATURES, version: str = "v1") -> DataFrame:
    """Wide to long; bars with any missing feature are left out."""
    return (wide.na.drop(subset=list(names))
            .unpivot(["symbol", "ts"], list(names), "feature_name", "feature_value")
            .withColumn("feature_version", F.lit(version)))


def pair_bars(bars_: DataFrame, pairs: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Inner join of two symbols on the bar time, suffix ``_btc`` for the base leg and ``_eth`` for the
    lead leg, keyed by ``pair``. A sequence of (base, lead) tuples, or a table with these columns."""
    if not isinstance(pairs, DataFrame):
        pairs = bars_.sparkSession.createDataFrame(list(pairs), "base string, lead string")
    p = pairs.select("base", "lead", F.concat_ws("/", "base", "lead").alias("pair"))
    a = bars_.join(small(p), F.col("symbol") == F.col("base")).select(
        "pair", "ts", *[F.col(c).alias(f"{c}_btc") for c in PRICES])
    b = bars_.join(small(p), F.col("symbol") == F.col("lead")).select(
        "pair", "ts", *[F.col(c).alias(f"{c}_eth") for c in PRICES])
    return a.join(b, ["pair", "ts"])


def paired_series(df: DataFrame, base: str, lead: str, cols: Sequence[str], keys: Sequence[str],
                  fill: float | None = None) -> DataFrame:
    """Two symbols of a slow series side by side on ``keys`` (time, venue, window)."""
    v = [F.coalesce(F.col(c), F.lit(fill)).alias(c) if fill is not None else F.col(c) for c in cols]
    a = df.where(F.col("symbol") == base).select(*keys, *v).withColumnsRenamed({c: f"{c}_btc" for c in cols})
    b = df.where(F.col("symbol") == lead).select(*keys, *v).withColumnsRenamed({c: f"{c}_eth" for c in cols})
    return a.join(b, list(keys))


def merged_series(a: DataFrame, b: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """Inner join of two slow series; when one side holds no rows at all, the other is returned."""
    if a.isEmpty():
        return b
    if b.isEmpty():
        return a
    return a.join(b, list(on))


def regime_series(labels: DataFrame, symbol: str | None = None) -> DataFrame:
    d = labels.where(F.col("symbol") == symbol) if symbol else labels
    return d.select("symbol", "ts", F.col("regime_name").alias("hmm_regime"))


def closed_trades(positions: DataFrame, hypotheses: DataFrame, strategy: str | None = None) -> DataFrame:
    d = positions.where(F.col("status") == "closed").join(small(hypotheses), "hypothesis")
    return d.where(F.col("hypothesis") == strategy) if strategy else d


def run_documents(spark: SparkSession, path: str, schema=schemas.RUN_DOCUMENT) -> DataFrame:
    """One JSON document per file, with its file name."""
    return (spark.read.schema(schema).option("multiLine", True).json(path)
            .withColumn("artifact", F.element_at(F.split(F.input_file_name(), "/"), -1)))
