"""Running values over a series without putting a whole series into one task.

One symbol may hold a large share of all rows, so a plain unbounded window over ``symbol`` would sort
that share in a single task. Every operator here works in two levels instead:

1. rows fall into time chunks (``ts // span``); a chunk of more than ``depth`` rows is cut further, in ranges of
   about equal depth: a mergeable sketch of the first order column proposes the cut points, and a single value that
   fills a range of its own is cut by what follows in the order in the same way. A key with a million rows in one second
   so spreads over tasks as long as its order tells the rows apart. Where a chunk needs more than ``RANGES`` ranges, so
   that holding each row against their cut points would cost more than a sort, the rows are sorted and stored once and
   chunks are cut by position;
2. each chunk is reduced to one partial row; a window over those few rows gives the value carried
   into each chunk;
3. the carry joins back on (keys, chunk) and a window inside the chunk finishes the value.

The chunk table has one row per ``span`` seconds or ``depth`` rows of data, so the window over it stays small; the
join and the inner window share one hash partitioning on (keys, chunk), so the data is shuffled once.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.readers import small
from .store import stored

CHUNK, NO = "_chunk", "_no"
# Rows of a chunk in one task, cut points of one sketch, and ranges of one chunk that rows are compared with one by one.
DEPTH, CUTS, RANGES = 200_000, 1023, 128


@dataclass(frozen=True)
class Run:
    """A running value. kind: sum, count, max, min or last (last non-null)."""
    out: str
    kind: str
    col: Column
    inclusive: bool = True


def _agg(kind: str, col: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "count":
        return F.count(col)
    if kind == "max":
        return F.max(col)
    if kind == "min":
        return F.min(col)
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), order))
    raise ValueError(kind)


def _over(kind: str, col: Column, frame) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(frame)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](col).over(frame)


def _merge(kind: str, carried: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(carried + here)
    if kind == "max":
        return F.greatest(carried, here)
    if kind == "min":
        return F.least(carried, here)
    return F.coalesce(here, carried)


def _numbers(df: DataFrame, order: Sequence[str | Column]) -> list[Column]:
    """Doubles whose lexicographic order never runs against the order of the rows; rows that agree in some of them
    still differ in the order only by what follows. Nulls come first."""
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        t = df.select(c.alias("o")).schema["o"].dataType
        if isinstance(t, T.LongType):                     # two parts, each exact in a double
            out += [F.shiftright(c, 10).cast("double"), c.bitwiseAND(F.lit(1023)).cast("double")]
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            out.append(c.cast("double"))
        elif isinstance(t, T.DateType):
            out.append(F.unix_date(c).cast("double"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.unix_micros(c.cast("timestamp")).cast("double"))
        elif isinstance(t, T.StringType):                 # up to 24 bytes; what follows them is not used
            out += [F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), k, 6)), 12, "0"), 16, 10).cast("double") for k in (1, 7, 13, 19)]
            break
        else:                                             # several values may share a double
            x = c.cast("double")
            out.append(F.when(F.isnan(x), float("inf")).otherwise(x))
            break
    return [F.coalesce(x, F.lit(float("-inf"))) for x in out]


def _sketch(x: Column) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)]), F.lit(10 * (CUTS + 1)))


def _cuts(depth: int) -> Column:
    """Of the sketch ``_sk`` of ``_n`` rows, the cut points about ``depth`` rows apart."""
    step = F.greatest(F.lit(1), F.floor(F.lit(depth * (CUTS + 1.0)) / F.col("_n")))
    return F.array_distinct(F.filter("_sk", lambda x, i: (i + 1) % step == 0))


def _range(x: Column, cuts: str) -> Column:
    """Even for values between two cut points, odd for those equal to one; 0 without cut points."""
    below = F.size(F.filter(cuts, lambda c: c < x)) * 2 + F.array_contains(cuts, x).cast("int")
    return F.when(F.col(cuts).isNotNull(), below).otherwise(0).cast("long")


def in_ranges(d: DataFrame, at: Sequence[str], order: Sequence[str | Column], hot: DataFrame, depth: int) -> tuple[DataFrame, list[str]]:
    """Adds range columns that cut the groups of ``hot`` (at..., _n, _sk over the first number of the order) in ranges
    of about ``depth`` rows, one column for each number that was needed. Other groups get 0."""
    at, names = list(at), []
    for i, x in enumerate(_numbers(d, order)):
        name = f"_range{i}"
        if i:                                             # single values that alone fill a range
            full = d.where(F.col(names[-1]) % 2 == 1).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), _sketch(x).alias("_sk"))
            hot = stored(full.where(F.col("_n") > depth))
            if hot.isEmpty():
                break
        cuts = stored(hot.select(*at, _cuts(depth).alias("_cuts")))
        d = d.join(small(cuts), at, "left").withColumn(name, _range(x, "_cuts")).drop("_cuts")
        at.append(name)
        names.append(name)
    return d, names


def by_position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], depth: int) -> DataFrame:
    """Stores ``df`` sorted over all tasks, cut in chunks that end every ``depth`` rows of a task, with the row's number
    in its chunk. Rows that tie may fall into two chunks; the numbers keep them in one order."""
    d = df.sort(*keys, *order).withColumn(CHUNK, F.monotonically_increasing_id())           # task << 33 | row of the task
    d = d.withColumn(NO, (F.col(CHUNK).bitwiseAND(F.lit((1 << 33) - 1)) % depth).cast("int"))
    return stored(d.withColumn(CHUNK, F.col(CHUNK) - F.col(NO)))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], runs: Sequence[Run],
            ts: Column, span: int, depth: int = DEPTH) -> DataFrame:
    """Add running values in ``order`` within ``keys``. ``order`` must start with the time column
    ``ts`` is derived from, so that chunks are contiguous in it. ``df`` is read twice, and once more if a chunk has
    more than ``depth`` rows; if one has more than ``depth * RANGES``, the third reading stores it sorted."""
    keys = list(keys)
    d = df.withColumn(CHUNK, F.array(F.floor(ts / span).cast("long")))
    at = [*keys, CHUNK]
    partials = lambda by: [_agg(r.kind, r.col, by).alias(f"_p_{r.out}") for r in runs]
    row = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    part = stored(d.groupBy(*at).agg(*partials(row), F.count(F.lit(1)).alias("_n"), _sketch(_numbers(df, order)[0]).alias("_sk")))
    most = part.agg(F.max("_n")).first()[0] or 0
    if most > depth * RANGES:
        d, order, at = by_position(df, keys, order, depth), [NO], [CHUNK, *keys]
        part = d.groupBy(*at).agg(*partials(F.col(NO)))
    elif most > depth:
        d, ranges = in_ranges(d, at, order, part.where(F.col("_n") > depth).select(*at, "_n", "_sk"), depth)
        d = d.withColumn(CHUNK, F.concat(CHUNK, F.array(*ranges))).drop(*ranges)
        part = d.groupBy(*at).agg(*partials(row))
    up = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*at, *[
        _over("sum" if r.kind == "count" else r.kind, F.col(f"_p_{r.out}"), up).alias(f"_c_{r.out}")
        for r in runs])
    j = d.join(carry, at)
    w = Window.partitionBy(*at).orderBy(*order)
    inc = w.rowsBetween(Window.unboundedPreceding, 0)
    exc = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for r in runs:
        here = _over(r.kind, r.col, inc if r.inclusive else exc)
        cols.append(_merge(r.kind, F.col(f"_c_{r.out}"), here).alias(r.out))
    return j.select(*df.columns, *cols)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: Column, span: int,
              out: str = "idx") -> DataFrame:
    """Dense 0-based position within ``keys``."""
    return (running(df, keys, order, [Run(out, "count", F.lit(1))], ts, span)
            .withColumn(out, F.col(out).cast("long") - 1))


def run_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Column, out: str,
               ts: Column, span: int, pos: str = "idx") -> DataFrame:
    """Length of the current streak: rows since ``same`` last was false. ``same`` says whether the row
    continues the streak; a row that does not has length 0. Needs the position column ``pos``."""
    brk = F.when(~same, F.col(pos))
    d = running(df, keys, order, [Run("_brk", "last", brk)], ts, span)
    return d.withColumn(out, (F.col(pos) - F.coalesce(F.col("_brk"), F.lit(-1))).cast("double")).drop("_brk")


def max_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, out: str,
               ts: Column, span: int) -> DataFrame:
    """Longest streak of ``hit`` per key."""
    d = row_index(df, keys, order, ts, span, out="_i")
    d = run_length(d, keys, order, hit, "_len", ts, span, pos="_i")
    return d.groupBy(*keys).agg(F.coalesce(F.max("_len"), F.lit(0.0)).cast("long").alias(out))


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str, ts: Column, span: int,
             compounded: bool = True) -> DataFrame:
    """Adds equity, peak and drawdown. Compounded: product of (1+r), relative drop (<= 0). Additive: sum
    of r, absolute drop (>= 0)."""
    x = F.log1p(F.col(ret)) if compounded else F.col(ret)
    d = running(df, keys, order, [Run("_cum", "sum", x)], ts, span)
    d = d.withColumn("equity", F.exp("_cum") if compounded else F.col("_cum")).drop("_cum")
    d = running(d, keys, order, [Run("peak", "max", F.col("equity"))], ts, span)
    return d.withColumn("drawdown", F.col("equity") / F.col("peak") - 1.0 if compounded
                        else F.col("peak") - F.col("equity"))
