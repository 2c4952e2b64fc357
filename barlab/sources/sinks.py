"""Sinks and keyed merges on plain Parquet."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest(df: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Last writer wins per key. ``max_by`` keeps map-side partials, so a key written many times does
    not travel many times."""
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), version).alias("_r"))
            .select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns]))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str = "ingested_at") -> DataFrame:
    """Merged table: the updates win over the target, later updates win over earlier ones."""
    t = target.withColumn("_gen", F.lit(0))
    u = updates.withColumn("_gen", F.lit(1))
    return latest(t.unionByName(u), keys, F.struct("_gen", version)).drop("_gen")


def upsert_counts(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one update batch that are new and that overwrite, by distinct key."""
    k = updates.select(*keys).distinct()
    t = target.select(*keys).distinct().withColumn("_in", F.lit(1))
    return k.join(t, list(keys), "left").agg(
        F.count(F.when(F.col("_in").isNull(), 1)).alias("inserted"),
        F.count("_in").alias("updated"))


def insert_or_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], version: str = "ingested_at") -> DataFrame:
    """Rows of ``new`` whose key is absent from the target; within the batch the first writer wins."""
    cols = [c for c in new.columns if c not in keys]
    first = (new.groupBy(*keys).agg(F.min_by(F.struct(*cols), version).alias("_r"))
             .select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in new.columns]))
    return first.join(target.select(*keys), list(keys), "left_anti")


def rewrite_partitions(target_path: str, merged: DataFrame, part: str) -> None:
    """Replace only the partitions present in ``merged`` (dynamic partition overwrite)."""
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(target_path))


def signal_snapshots(positions: DataFrame, snapshots: DataFrame, bars: DataFrame, features_wide: DataFrame,
                     offset_sec: int = 300, force: bool = False) -> DataFrame:
    """State at signal time of positions without a snapshot: the bar exactly ``offset_sec`` before the
    opening, its features and regime. Positions without such a bar are skipped."""
    from ..functions.scalar import trend_regime
    p = positions if force else positions.join(snapshots.select("position_id"), "position_id", "left_anti")
    p = p.withColumn("ts", F.col("opened_at") - offset_sec)
    b = bars.select("symbol", "ts", *[F.col(c).alias(f"signal_{c}") for c in ("open", "high", "low", "close", "volume")])
    return (p.join(b, ["symbol", "ts"]).join(features_wide, ["symbol", "ts"], "left")
            .withColumn("regime", F.when(F.col("er20").isNotNull(), trend_regime(F.col("er20"))))
            .withColumnsRenamed({"ts": "signal_ts", "opened_at": "entry_ts"}))


def append_versioned(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def newest_first(df: DataFrame, n: int, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The latest n rows: a top-n per partition, then a merge; not a full sort. ``tie`` decides between equal times."""
    return df.orderBy(F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])).limit(n)


def newest(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """The latest row, per key when keys are given."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), ts).alias("_r")).select(
        *keys, "_r.*")


