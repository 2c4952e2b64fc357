"""A keyed table on plain Parquet that is changed by partitions.

``data/v=N/_part=P`` holds partition P as version N wrote it, ``manifest/v=N`` one row (part, v) per live partition. A
version counts once Spark has finished its manifest (``_SUCCESS``), so readers see all of a change or nothing, and what a
crashed writer left is overwritten by the next. One writer at a time.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .sinks import latest

PART = "_part"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, table: str) -> list[int]:
    """Finished versions, oldest first."""
    fs, p = _fs(spark, f"{table}/manifest")
    if not fs.exists(p):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(p)]
    return sorted(int(f.getName()[2:]) for f in found if f.getName().startswith("v=") and fs.exists(done(f, "_SUCCESS")))


def live(spark: SparkSession, table: str, v: int) -> dict[int, int]:
    """Version of every partition as of version ``v``; the driver holds one pair of numbers per partition, as it holds
    the file list of any table."""
    return {r.part: r.v for r in spark.read.schema("part long, v long").parquet(f"{table}/manifest/v={v}").collect()}


def _scan(spark: SparkSession, table: str, schema: StructType, parts: dict[int, int]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/data/v={v}/{PART}={p}" for p, v in sorted(parts.items())])


def read(spark: SparkSession, table: str, schema: StructType, v: int | None = None) -> DataFrame:
    """The table as of version ``v``, by default the newest; empty if there is none."""
    done = committed(spark, table)
    v = v if v is not None else done[-1] if done else None
    return _scan(spark, table, schema, live(spark, table, v) if v is not None else {})


def merge(rows: DataFrame, table: str, keys: Sequence[str], version: str, part: Column | None = None, parts: int = 64) -> list[int]:
    """Upsert ``rows``; the newest ``version`` per key wins, the larger rest of the row among equal ones. Returns the
    partitions written.

    ``part`` gives the partition as a whole number from key columns (for bars, the day: a batch then rewrites the days
    it touches), by default one of ``parts`` buckets of the key; null falls into -1. ``part`` and ``parts`` stay the
    same for the life of a table. ``rows`` is read twice. No rows, no new version.
    """
    spark = rows.sparkSession
    p = F.coalesce(part.cast("long"), F.lit(-1)) if part is not None else F.pmod(F.xxhash64(*keys), F.lit(parts))
    touched = sorted(r[0] for r in rows.select(p.alias(PART)).distinct().collect())
    if not touched:
        return []
    done = committed(spark, table)
    v = done[-1] + 1 if done else 0
    old = live(spark, table, done[-1]) if done else {}
    base = _scan(spark, table, rows.schema, {k: old[k] for k in touched if k in old})
    new = latest(base.unionByName(rows), keys, F.struct(version, *[c for c in rows.columns if c not in keys and c != version]))
    new.withColumn(PART, p).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{table}/data/v={v}")
    now = spark.createDataFrame(sorted({**old, **dict.fromkeys(touched, v)}.items()), "part long, v long")
    now.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={v}")
    return touched


def drop_old(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete partitions and manifests that none of the newest ``keep`` versions uses; returns how many folders went."""
    done = committed(spark, table)
    stay, go = done[-keep:], done[:-keep]
    used = {(p, v) for s in stay for p, v in live(spark, table, s).items()}
    gone = {(p, v) for s in go for p, v in live(spark, table, s).items()} - used
    for path in [*(f"{table}/data/v={v}/{PART}={p}" for p, v in sorted(gone)), *(f"{table}/manifest/v={s}" for s in go)]:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
    return len(gone) + len(go)
