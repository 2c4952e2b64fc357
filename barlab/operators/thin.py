"""Greedy non-overlap thinning, exact and parallel inside one series.

Rule: walk candidates in order; keep one when it lies at least ``need`` positions after the last kept.
The walk is sequential, but its memory is tiny: all that matters is how far back the last kept candidate
is, capped at the largest gap G. So each chunk of a series is summarised by a table of G entries (state
on entry -> last kept position on exit), the tables are folded along the chunks to find each chunk's
entry state, and every chunk then replays its own candidates. No task sees more than one chunk of
candidates or one run of chunk tables.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHUNK_ROWS, FAN = 4096, 1024


def _walk(cands: Column, last: Column) -> Column:
    return F.aggregate(cands, last, lambda s, c: F.when(c["p"] - s >= c["need"], c["p"]).otherwise(s))


def _compose(steps: Column, last: Column, gap: Column) -> Column:
    """Fold chunk tables: ``steps`` is an ordered array of (start, exits)."""
    return F.aggregate(steps, last, lambda s, t: F.element_at(
        t["exits"], F.least(t["start"] - s, gap).cast("int")))


def _table(start: Column, gap: Column, fold) -> Column:
    """exits[j-1] = last kept position when the last kept on entry is j positions before ``start``."""
    return F.transform(F.sequence(F.lit(1), gap.cast("int")), lambda j: fold(start - j))


def thin(df: DataFrame, by: Sequence[str], gap: Column | int, pos: str = "idx",
         max_gap: Column | int | None = None, chunk: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Keep the greedy non-overlapping subset of the rows of ``df`` per ``by``.

    ``gap`` may differ per row (two-tier thinning); ``max_gap`` bounds it and must be constant per
    ``by`` group. ``pos`` is an integer position, unique per group.
    """
    by = list(by)
    need = gap if isinstance(gap, Column) else F.lit(gap)
    cap = max_gap if max_gap is not None else gap
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    cols = [c for c in df.columns if c not in by]
    d = df.select(*by, F.struct(*cols).alias("_row"), F.col(pos).cast("long").alias("p"),
                  need.cast("long").alias("need"), cap.cast("long").alias("_cap"))
    d = d.withColumn("_ck", F.floor(F.col("p") / chunk).cast("long"))
    packed = (d.groupBy(*by, "_ck")
              .agg(F.collect_list(F.struct("p", "need", F.col("_cap").alias("cap"), "_row")).alias("cands")))
    # both uses below read the same aggregate, so Spark runs and shuffles it once
    packed = packed.withColumn("cands", F.array_sort("cands", lambda a, b: (a["p"] - b["p"]).cast("int")))
    packed = packed.withColumn("_cap", F.col("cands")[0]["cap"])
    start = F.col("_ck") * chunk
    tables = packed.select(*by, "_ck", "_cap", start.alias("start"), _table(
        start, F.col("_cap"), lambda s: _walk(F.col("cands"), s)).alias("exits"))

    # level 1: chunks -> super chunks
    tables = tables.withColumn("_sk", F.floor(F.col("_ck") / fan).cast("long"))
    sup = (tables.groupBy(*by, "_sk")
           .agg(F.array_sort(F.collect_list(F.struct("start", "_ck", "exits"))).alias("steps")))
    sup = (sup.withColumn("s0", F.col("steps")[0]["start"])
           .withColumn("_cap", F.size(F.col("steps")[0]["exits"])))
    sup_tables = sup.select(*by, "_sk", "_cap", "s0", _table(
        F.col("s0"), F.col("_cap"), lambda s: _compose(F.col("steps"), s, F.col("_cap"))).alias("exits"))

    # level 2: entry state of each super chunk; groups hold one row per chunk*fan positions
    far = F.lit(-(10 ** 9)).cast("long")

    def entries(steps: Column, first: Column, cap_: Column) -> Column:
        """States on entry to each step, in order (one more than needed at the end)."""
        return F.aggregate(steps, F.array(first), lambda acc, t: F.concat(acc, F.array(F.element_at(
            t["exits"], F.least(t["start"] - F.element_at(acc, -1), cap_).cast("int")))))

    top = (sup_tables.groupBy(*by)
           .agg(F.array_sort(F.collect_list(F.struct(F.col("s0").alias("start"), "_sk", "exits"))).alias("steps"))
           .withColumn("_cap", F.size(F.col("steps")[0]["exits"])))
    top = top.select(*by, F.explode(F.arrays_zip(
        F.col("steps._sk").alias("sk"),
        F.slice(entries(F.col("steps"), far, F.col("_cap")), F.lit(1), F.size("steps")).alias("st"))).alias("z"))
    top = top.select(*by, F.col("z.sk").alias("_sk"), F.col("z.st").alias("_in"))
    inner = (sup.join(top, [*by, "_sk"])
             .select(*by, F.explode(F.arrays_zip(
                 F.col("steps._ck").alias("ck"),
                 F.slice(entries(F.col("steps"), F.col("_in"), F.col("_cap")),
                         F.lit(1), F.size("steps")).alias("st"))).alias("z"))
             .select(*by, F.col("z.ck").alias("_ck"), F.col("z.st").alias("_state")))

    # replay
    kept = packed.join(inner, [*by, "_ck"]).select(*by, F.aggregate(
        F.col("cands"),
        F.struct(F.col("_state").alias("last"),
                 F.filter(F.transform("cands", lambda c: c["_row"]), lambda r: F.lit(False)).alias("out")),
        lambda s, c: F.when(c["p"] - s["last"] >= c["need"], F.struct(
            c["p"].alias("last"), F.concat(s["out"], F.array(c["_row"])).alias("out"))).otherwise(s),
        lambda s: s["out"]).alias("_kept"))
    return (kept.select(*by, F.explode("_kept").alias("_row"))
            .select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns]))
