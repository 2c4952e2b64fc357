"""First-touch exits along the path of an entry."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.nulls import lt

# one row of exit parameters; a null or zero switches a condition off
EXIT_FIELDS = ("atr_stop double, tp_bps double, trail_bps double, breakeven_bps double, watch string, "
               "watch_min double, slope_exit boolean, collapse string, collapse_below double, collapse_bars int")


def path_extreme(direction: Column, entry: Column, lowest: Column, highest: Column) -> Column:
    """Worst signed excursion of a path against the entry price (a value at most as good as any bar)."""
    up, dn = lowest / entry - 1.0, (highest / entry - 1.0) * -1.0
    return F.when(direction > 0, up).when(direction < 0, dn)


def first_touch(path: Column, direction: Column, entry: Column, atr: Column, slope: Column,
                spec: Column) -> Column:
    """Price at the first bar of ``path`` where any enabled exit holds, else null.

    ``path`` is an array of structs (px, slope, and the watched series by name) for the bars after the
    entry, in order. All exits of one bar leave at that bar's price, so only the first bar matters. The
    trailing peak, break-even latch and collapse counter are the running state.
    """
    on = lambda f: F.coalesce(spec[f], F.lit(0)) > 0
    is_long = direction > 0
    atr_ = F.coalesce(atr, F.lit(0.0))

    def named(bar: Column, which: Column) -> Column:
        out = None
        for n in ("long_liq_btc_pct", "short_liq_btc_pct", "total_liq_btc_pct", "volume_btc_pct"):
            out = F.when(which == n, bar[n]) if out is None else out.when(which == n, bar[n])
        return out

    def step(s: Column, bar: Column) -> Column:
        px = bar["px"]
        pnl = direction * (px / entry - 1.0)
        peak = F.when(is_long, F.greatest(s["peak"], px)).otherwise(F.least(s["peak"], px))
        latched = s["latched"] | (on("breakeven_bps") & (pnl >= spec["breakeven_bps"] / 10000.0))
        against = lambda level_long, level_short: F.when(is_long, px <= level_long).otherwise(px >= level_short)
        low = lt(named(bar, spec["collapse"]), spec["collapse_below"])
        run = F.when(low, s["run"] + 1).otherwise(0)
        trail = spec["trail_bps"] / 10000.0 * entry
        stop = spec["atr_stop"] * atr_
        hit = (
            (on("atr_stop") & (atr_ > 0) & against(entry - stop, entry + stop))
            | (on("tp_bps") & (pnl >= spec["tp_bps"] / 10000.0))
            | (on("trail_bps") & against(peak - trail, peak + trail))
            | (latched & against(entry, entry))
            | (on("watch_min") & lt(named(bar, spec["watch"]), spec["watch_min"]))
            | (F.coalesce(spec["slope_exit"], F.lit(False)) & F.coalesce(bar["slope"] != 0.0, F.lit(False))
               & F.coalesce(bar["slope"] != slope, F.lit(True)))
            | (on("collapse_below") & (run >= F.coalesce(spec["collapse_bars"], F.lit(2))))
        )
        nxt = F.struct(F.when(F.coalesce(hit, F.lit(False)), px).alias("exit"), peak.alias("peak"),
                       F.coalesce(latched, F.lit(False)).alias("latched"), run.alias("run"))
        return F.when(s["exit"].isNotNull() | px.isNull(), s).otherwise(nxt)

    zero = F.struct(F.lit(None).cast("double").alias("exit"), entry.alias("peak"),
                    F.lit(False).alias("latched"), F.lit(0).alias("run"))
    return F.aggregate(path, zero, step, lambda s: s["exit"])
