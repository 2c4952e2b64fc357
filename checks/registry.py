"""Registry of the checked queries: a Spark job and, where SQL can say it, the same result as SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Two engines may round an exact decimal tie apart (prices over powers of two give many). Both sides add
# this offset first, so that ties sit clear of the rounding boundary.
NUDGE = 3.14159e-08


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Counts as bigint, doubles rounded, no negative zero."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t == "double":
            c = F.round(c + F.lit(NUDGE) if places <= 6 else c, places) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(n))
    return df.select(*out)


def query(name: str, sql: str | None = None, places: int = 6):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return tidy(fn(spark, sf_dir), places)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def R(*names: str, t: str = "", places: int = 6) -> str:
    """Rounded output columns of the SQL side."""
    p = f"{t}." if t else ""
    nudge = " + 3.14159e-08" if places <= 6 else ""
    return ", ".join(f"round({p}{n}{nudge}, {places}) + 0.0 AS {n}" for n in names)


def rx(**exprs: str) -> str:
    return ", ".join(f"round(({e}) + 3.14159e-08, 6) + 0.0 AS {n}" for n, e in exprs.items())


def win(agg: str, x: str, n: int, w: str, need: int | None = None, extra: str = "") -> str:
    """SQL rolling aggregate that needs a full frame."""
    fr = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    a = f"{agg}({x}{extra}) {fr}"
    return f"CASE WHEN count({x}) {fr} >= {need or n} THEN {a} END"


def rank_sql(x: str, n: int, w: str, need: int | None = None) -> str:
    fr = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    l = f"list({x}) FILTER ({x} IS NOT NULL) {fr}"
    return (f"CASE WHEN {x} IS NOT NULL AND count({x}) {fr} >= {need or n} THEN (len(list_filter({l}, lambda e: e < {x})) + "
            f"(len(list_filter({l}, lambda e: e = {x})) + 1)/2.0)/count({x}) {fr} END")


def r6(expr: str) -> str:
    """One rounded SQL expression."""
    return f"(round(({expr}) + 3.14159e-08, 6) + 0.0)"
