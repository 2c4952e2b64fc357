"""Rolling expressions over an ordered window.

``w`` is a WindowSpec with partitioning and order but no frame. ``n`` counts rows and includes the
current one. A value appears only when the frame holds ``min_periods`` non-null inputs (default ``n``).
"""
from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

from .nulls import eq, flag, ne, zero_to_null


def rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def prior(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def ahead(w: WindowSpec, a: int, b: int) -> WindowSpec:
    return w.rowsBetween(a, b)


def full(agg: Column, x: Column, frame: WindowSpec, need: int) -> Column:
    return F.when(F.count(x).over(frame) >= need, agg.over(frame))


def mean(x, w, n, min_periods=None):
    return full(F.avg(x), x, rows(w, n), min_periods or n)


def total(x, w, n, min_periods=None):
    return full(F.sum(x), x, rows(w, n), min_periods or n)


def std(x, w, n, ddof=0, min_periods=None):
    return full(F.stddev_samp(x) if ddof else F.stddev_pop(x), x, rows(w, n), min_periods or n)


def hi(x, w, n, min_periods=None):
    return full(F.max(x), x, rows(w, n), min_periods or n)


def lo(x, w, n, min_periods=None):
    return full(F.min(x), x, rows(w, n), min_periods or n)


def quantile(x, q, w, n, min_periods=None):
    """Linear-interpolated quantile; for short frames (long ones: operators.rolling)."""
    return full(F.percentile(x, F.lit(q)), x, rows(w, n), min_periods or n)


def pct_rank(x, w, n, min_periods=None):
    """Average-tie percentile rank of the current value in its frame; for short frames."""
    arr = F.collect_list(x).over(rows(w, n))
    below = F.size(F.filter(arr, lambda v: v < x))
    same = F.size(F.filter(arr, lambda v: v == x))
    r = (below + (same + 1) / 2.0) / F.size(arr)
    return F.when((F.count(x).over(rows(w, n)) >= (min_periods or n)) & x.isNotNull(), r)


def corr(x, y, w, n):
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when(F.count(both).over(rows(w, n)) >= n, F.corr(x, y).over(rows(w, n)))


def prior_max(x, w, n):
    return full(F.max(x), x, prior(w, n), n)


def prior_min(x, w, n):
    return full(F.min(x), x, prior(w, n), n)


def lag(x, w, k=1):
    return F.lag(x, k).over(w)


def lead(x, w, k=1):
    return F.lead(x, k).over(w) if k else x


def diff(x, w, k=1):
    return x - lag(x, w, k)


def ret(x, w, k=1):
    return x / lag(x, w, k) - 1.0


def log_ret(x, w, k=1):
    return F.log(x / lag(x, w, k))


def forward_return(x, w, h, offset=0):
    return lead(x, w, offset + h) / lead(x, w, offset) - 1.0


def true_range(high, low, prev_close, first: str = "null"):
    """``first='null'``: no previous close gives null; ``first='range'``: it gives high - low."""
    tr = F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))
    return tr if first == "range" else F.when(prev_close.isNotNull(), tr)


def efficiency_ratio(net_abs, step_abs, w, n):
    return net_abs / zero_to_null(total(step_abs, w, n))


def vwap(price_volume, volume, w, n):
    return total(price_volume, w, n) / zero_to_null(total(volume, w, n))


def flip(s, w):
    """The state differs from the previous one and is not zero (missing differs from everything)."""
    return ne(s, lag(s, w)) & ne(s, 0.0)


def flip_down(s, w):
    return eq(s, -1.0) & eq(lag(s, w), 1.0)


def onset(c, w):
    """Rising edge of a boolean that is never null."""
    return c & ~F.coalesce(lag(c, w), F.lit(False))


def recent(c, w, n, shift=1):
    """True when ``c`` held in any of the last n rows (excluding the current one when shift=1)."""
    f = prior(w, n) if shift else rows(w, n)
    return F.coalesce(F.max(flag(c)).over(f) > 0, F.lit(False))


def sustained(c, w, n):
    """True when ``c`` held on all of the last n rows and n rows exist."""
    return F.coalesce(lo(flag(c), w, n) > 0, F.lit(False))


def carry_change(x, w):
    """Relative change, only where the carried value changed."""
    p = lag(x, w)
    return F.when(ne(x, p) & p.isNotNull() & x.isNotNull(), x / p - 1.0)
