"""Connected components of an edge table by alternating star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.store import stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node go to the smallest of all. Small star: those below it do."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    j = both.join(low, "a")
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes with an edge.

    Each round writes the edges to the shared folder; it ends when a round changes none. A hot node is one row
    on the side of its minimum, so its join can be split.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    for _ in range(most_rounds):
        now = print_of(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
        e = stored(_star(_star(e, True), False))
    raise RuntimeError("components did not settle")
