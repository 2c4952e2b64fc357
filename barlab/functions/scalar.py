"""Row-level expressions: buckets, sessions, costs, fills, labels."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .nulls import between, gt, lt

# cost per trade by mode, as a fraction
COST_MODES = {"gross": 0.0, "bps8": 0.0008, "bps10": 0.0010}
STRESS_MODES = {"bps12": 0.0012, "bps15": 0.0015}


def num(c: Column) -> Column:
    """Numeric coercion: anything unparsable, and NaN, becomes null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)


def to_ts(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def floor_to(ts: Column, seconds: int) -> Column:
    """Epoch floored to a grid."""
    return ts - F.pmod(ts, F.lit(seconds))


def ceil_to(ts: Column, seconds: int) -> Column:
    return floor_to(ts + (seconds - 1), seconds)


def hour_of(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 3600).cast("int")


def minute_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 60).cast("int")


def day_of(ts: Column) -> Column:
    return F.floor(ts / 86400).cast("long")


def weekday_of(ts: Column) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return F.pmod(day_of(ts) + 3, F.lit(7)).cast("int")


def day_of_month(ts: Column) -> Column:
    return F.dayofmonth(F.date_from_unix_date(day_of(ts).cast("int")))


def month_label(ts: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day_of(ts).cast("int")), "yyyy-MM")


def parse_hhmm(text: str) -> int:
    """'HH:MM' to minute of day."""
    parts = str(text).strip().split(":")
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"expected HH:MM, got {text!r}")
    h, m = int(parts[0]), int(parts[1])
    if h > 23 or m > 59:
        raise ValueError(f"hour or minute out of range: {text!r}")
    return h * 60 + m


def in_session(ts: Column, start: str, end: str) -> Column:
    """Minute-of-day window [start, end); wraps midnight when start > end."""
    a, b, m = parse_hhmm(start), parse_hhmm(end), minute_of_day(ts)
    if a == b:
        raise ValueError("session start equals end")
    return (m >= a) & (m < b) if a < b else (m >= a) | (m < b)


def in_hours(ts: Column, *ranges: tuple[int, int]) -> Column:
    h = hour_of(ts)
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((h >= a) & (h < b))
    return out


def trend_regime(er: Column) -> Column:
    return (F.when(er.isNull(), "unknown").when(er >= 0.35, "trend")
            .when(er <= 0.25, "mean").otherwise("uncertain"))


def tail_code(pct: Column, lo: float = 0.10, hi: float = 0.90) -> Column:
    """-1 / 0 / 1 from percentile tails; missing counts as neutral."""
    return F.when(lt(pct, lo), -1).when(pct >= hi, 1).otherwise(0)


def bucket(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins. At or above the last edge, and below the first, the bucket is null."""
    out = None
    for lo, hi, lab in zip(edges, edges[1:], labels):
        out = F.when(between(x, lo, hi), lab) if out is None else out.when(between(x, lo, hi), lab)
    return out


def atr_shock_bucket(x: Column) -> Column:
    return F.when(gt(x, 2.5), ">2.5xATR").when(gt(x, 1.5), "1.5-2.5xATR").otherwise("0-1.5xATR")


def shock_side(r: Column) -> Column:
    return F.when(gt(r, 0), "pos").when(lt(r, 0), "neg").otherwise("zero")


def with_cost_modes(events: DataFrame, modes: dict[str, float] | None = None,
                    ret: str = "gross_r", out: str = "net_r") -> DataFrame:
    """One row per (event, cost mode): a generator over a literal list, so no join and no shuffle."""
    modes = modes or COST_MODES
    arr = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(c).alias("cost")) for m, c in modes.items()])
    return (events.select("*", F.explode(arr).alias("_mode_"))
            .select("*", F.col("_mode_.mode").alias("mode"), F.col("_mode_.cost").alias("cost"))
            .withColumn(out, F.col(ret) - F.col("cost")).drop("_mode_"))


def fill_price(price: Column, bps: Column | float, side: Column) -> Column:
    c = price * (F.lit(bps) / 10000.0 if not isinstance(bps, Column) else bps / 10000.0)
    return F.when(side == "buy", price + c).otherwise(price - c)


def trade_cost(price: Column, qty: Column, bps: float) -> Column:
    return price * qty * (bps / 10000.0)


def lag_status(lag_seconds: Column, green: int = 60, yellow: int = 180) -> Column:
    return (F.when(lag_seconds <= green, "green").when(lag_seconds <= yellow, "yellow")
            .otherwise("red"))


def id_number(rule_id: Column) -> Column:
    return F.regexp_extract(rule_id, r"(\d+)", 1).cast("int")


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain(*d.items())])


def r6(c: Column, places: int = 6) -> Column:
    return F.round(c, places)
