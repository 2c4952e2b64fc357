"""Session construction for tests, benchmarks and ad-hoc use."""
from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "barlab", master: str | None = None, shuffle: int | None = None,
            **conf: str) -> SparkSession:
    """UTC session with AQE on. ``master``/``shuffle`` are for local runs only; a cluster sets its own."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per expression
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All epoch/calendar expressions assume a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
