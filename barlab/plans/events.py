"""From rules to events: thin, price, filter, exit."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, Row, functions as F

from ..functions import windows as W
from ..functions.nulls import eq, ne
from ..functions.scalar import day_of_month, hour_of
from ..operators.blocks import block_window
from ..operators.exits import EXIT_FIELDS, first_touch, path_extreme
from ..operators.store import stored
from ..operators.thin import thin
from ..sources.readers import small
from .frame import KEYS, FrameConfig, blocked_frame
from .rules import BEST, PARAMS, Rule, Signal, available, best_of_day, frame_columns, history, needed_columns, rule_table, rules, signal_rows, signal_table

SHORT_HOLD = 4  # bars held by the variable-horizon rule after a tail turns neutral
VARIABLE = "regime_moves_10"
WATCHED = ["long_liq_btc_pct", "short_liq_btc_pct", "total_liq_btc_pct", "volume_btc_pct"]


def _legs(rs: list[Rule]) -> list[tuple[str, int, int]]:
    out = {(r.leg, r.offset, r.horizon) for r in rs}
    out |= {(r.leg, r.offset, SHORT_HOLD) for r in rs if r.signal == VARIABLE}
    return sorted(out)


def _key(leg, offset, horizon):
    return F.concat_ws("|", leg, offset, horizon)


def with_paths(x: DataFrame, rs: list[Rule]) -> DataFrame:
    """Prices each rule needs, as window columns inside the block: entry, exit and path extremes for
    every distinct (leg, entry lag, holding period), and for every (leg, entry lag) of a rule with exits the bar
    path after its entry bar, with the range and slope at that bar."""
    w = block_window(KEYS)
    entries = []
    for leg, o, h in _legs(rs):
        px = F.col(f"close_{leg}")
        path = w.rowsBetween(o + 1, o + h)
        entries += [F.lit(f"{leg}|{o}|{h}"), F.struct(
            W.lead(px, w, o).alias("entry"), W.lead(px, w, o + h).alias("exit"),
            F.min(px).over(path).alias("lowest"), F.max(px).over(path).alias("highest"))]
    x = x.withColumn("_px", F.create_map(*entries))
    have, paths = set(x.columns), []
    for leg, o in sorted({(r.leg, r.offset) for r in rs if r.exits}):
        longest = max(r.horizon for r in rs if r.exits and (r.leg, r.offset) == (leg, o))
        bar = F.struct(F.col(f"close_{leg}").alias("px"), F.col("eth_slope_sign_1h").alias("slope"), *[
            (F.col(n) if n in have else F.lit(None).cast("double")).alias(n) for n in WATCHED])
        paths += [F.lit(f"{leg}|{o}"), F.struct(
            F.collect_list(bar).over(w.rowsBetween(o + 1, o + longest)).alias("bars"),
            W.lead(F.col("atr14_btc"), w, o).alias("atr"), W.lead(F.col("eth_slope_sign_1h"), w, o).alias("slope"))]
    return x.withColumn("_path", F.create_map(*paths)) if paths else x


def bars_ahead(rs: list[Rule]) -> int:
    """Future bars a block needs for the prices of these rules."""
    return max((r.offset + max(r.horizon, SHORT_HOLD if r.signal == VARIABLE else 0) for r in rs), default=0)


def _exit_table(spark, rs: list[Rule]) -> DataFrame:
    fields = [f.split()[0] for f in EXIT_FIELDS.split(", ")]
    cast = {"slope_exit": bool, "watch": str, "collapse": str, "collapse_bars": int}
    rows = [Row(rule_id=r.rule_id, **{f: (cast.get(f, float)(r.exits[f]) if f in r.exits else None) for f in fields})
            for r in rs if r.exits]
    return spark.createDataFrame(rows, "rule_id string, " + EXIT_FIELDS)


def events_from_blocked(x: DataFrame, rs: list[Rule], params: dict = PARAMS,
                        extra: dict[str, Signal] | None = None) -> DataFrame:
    """Events of all rules: pair, rule_id, family, ts, idx, signal_dir, entry_px, exit_px, fwd_r, gross_r,
    mae_proxy. The halo of ``x`` must hold ``bars_ahead(rs)`` bars of future and ``rules.history`` of past."""
    spark = x.sparkSession
    cols = x.columns
    exits = [r for r in rs if r.exits]
    x = with_paths(x, rs)
    keep = ["_px", "spread_regime"] + (["_path"] if exits else [])
    if any(r.signal == BEST for r in rs):
        keep.append("eth_slope_abs_pct_1h")
    table = signal_table(cols, params) | (extra or {})
    hits = signal_rows(x, rs, params, keep=[*keep, "R1"], table=table)
    # each signal carries only the prices its own rules read
    read_by: dict[str, list[str]] = {}
    for r in rs:
        for h in (r.horizon, SHORT_HOLD) if r.signal == VARIABLE else (r.horizon,):
            read_by.setdefault(r.signal, []).append(f"{r.leg}|{r.offset}|{h}")
    own = F.create_map(*[v for n, ks in sorted(read_by.items())
                         for v in (F.lit(n), F.array(*[F.lit(k) for k in sorted(set(ks))]))])
    hits = hits.withColumn("_px", F.map_filter("_px", lambda k, v: F.array_contains(
        F.element_at(own, F.col("signal")), k)))
    if exits:  # the path travels only with signals of rules that leave early
        with_exit = sorted({r.signal for r in exits})
        hits = hits.withColumn("_path", F.when(F.col("signal").isin(with_exit), F.col("_path")))
    # the frame is evaluated once; what follows works on the firing bars only
    hits = stored(hits)
    if any(r.signal == BEST for r in rs):
        hits = best_of_day(hits)
    dim = rule_table(spark, rs, table)

    # rules sharing signal and holding period share one thinning
    gaps = small(dim.select("signal", "horizon", "pre_gap").distinct())
    cand = hits.join(gaps, "signal")
    by = [*KEYS, "signal", "horizon"]
    if any(table[r.signal].gap != "H" for r in rs):
        pre = thin(cand.where(F.col("pre_gap").isNotNull()), by,
                   F.coalesce("pre_need", "pre_gap"), max_gap=F.col("pre_gap"))
        cand = cand.where(F.col("pre_gap").isNull()).unionByName(pre)
    kept = thin(cand, by, F.col("horizon"))

    e = kept.drop("pre_gap").join(small(dim), ["signal", "horizon"])
    to_neutral = (F.col("signal") == VARIABLE) & ne(F.col("R1"), 0) & eq(F.col("spread_regime"), 0)
    hold = F.when(to_neutral, SHORT_HOLD).otherwise(F.col("horizon"))
    e = e.withColumn("p", F.element_at("_px", _key(F.col("leg"), F.col("offset"), hold)))
    e = (e.withColumns({"signal_dir": F.col("dir"), "entry_px": F.col("p.entry"), "exit_px": F.col("p.exit")})
         .na.drop(subset=["signal_dir", "entry_px", "exit_px"]))
    e = e.where((F.col("parity") < 0) | (day_of_month(F.col("ts")) % 2 == F.col("parity")))
    h = hour_of(F.col("ts"))
    e = e.where((h >= F.col("h_from")) & (h < F.col("h_to")))
    if exits:
        e = e.join(small(_exit_table(spark, exits)), "rule_id", "left")
        e = e.withColumn("_path", F.element_at("_path", F.concat_ws("|", "leg", "offset")))
        spec = F.struct(*[f.split()[0] for f in EXIT_FIELDS.split(", ")])
        early = first_touch(F.slice(F.col("_path.bars"), F.lit(1), F.col("horizon")), F.col("signal_dir"),
                            F.col("entry_px"), F.col("_path.atr"), F.col("_path.slope"), spec)
        e = e.withColumn("exit_px", F.when(F.col("has_exit"), F.coalesce(early, "exit_px")).otherwise(F.col("exit_px")))
    fwd = F.col("exit_px") / F.col("entry_px") - 1.0
    return e.select(*KEYS, "rule_id", "family", "ts", "idx", "signal_dir", "entry_px", "exit_px",
                    fwd.alias("fwd_r"), (F.col("signal_dir") * fwd).alias("gross_r"),
                    path_extreme(F.col("signal_dir"), F.col("entry_px"), F.col("p.lowest"),
                                 F.col("p.highest")).alias("mae_proxy"))


def _chosen(slow, numbers, params, skip_missing, extra, extra_rules) -> tuple[list[Rule], set[str], dict[str, Signal]]:
    rs = [*rules(numbers), *extra_rules]
    offer = frame_columns(set().union(*[s.columns for s in (slow or {}).values()]))
    if skip_missing:
        rs = available(rs, offer)
    table = signal_table(offer, params) | (extra or {})
    missing = sorted({r.signal for r in rs} - set(table))
    if missing:
        raise ValueError(f"the given series lack the inputs of: {missing}")
    return rs, offer, table


def rule_frame(pair: DataFrame, c: FrameConfig = FrameConfig(), slow: dict[str, DataFrame] | None = None,
               numbers: Iterable[int] | None = None, params: dict = PARAMS, label: str = "left",
               skip_missing: bool = False, extra: dict[str, Signal] | None = None,
               extra_rules: Iterable[Rule] = (), every_column: bool = False) -> DataFrame:
    """The blocked frame these rules need, with halos that follow from the rules: their longest lag and holding period
    ahead, what their windows reach back over behind. Store it to run ``events_from_blocked`` on it more than once."""
    rs, offer, table = _chosen(slow, numbers, params, skip_missing, extra, extra_rules)
    only = needed_columns(rs, offer, table, params) | {"atr14_btc", "eth_slope_sign_1h", "spread_pct"}
    only |= {f"{k}_{a}" for a in ("btc", "eth") for k in ("open", "high", "low", "close", "volume")}
    if any(r.exits for r in rs):
        only |= set(WATCHED)
    c = c.small(ahead=bars_ahead(rs), rule_back=history(params, [table[r.signal] for r in rs]))
    return blocked_frame(pair, c, slow, label, None if every_column else only)


def build_events(pair: DataFrame, c: FrameConfig = FrameConfig(), slow: dict[str, DataFrame] | None = None,
                 numbers: Iterable[int] | None = None, params: dict = PARAMS, label: str = "left",
                 skip_missing: bool = False, extra: dict[str, Signal] | None = None,
                 extra_rules: Iterable[Rule] = ()) -> DataFrame:
    """Pair bars -> events of the listed rules (all by default).

    A user's own rule is a ``Signal`` (mask and direction over frame columns) in ``extra`` and a ``Rule``
    that names it in ``extra_rules``.
    """
    extra_rules = list(extra_rules)
    rs, _, _ = _chosen(slow, numbers, params, skip_missing, extra, extra_rules)
    x = rule_frame(pair, c, slow, numbers, params, label, skip_missing, extra, extra_rules)
    return events_from_blocked(x, rs, params, extra)


def mae_compat(events: DataFrame, rs: list[Rule]) -> DataFrame:
    """Null the excursion of every rule whose post-filters drop events, as the published runs do."""
    filtered = [r.rule_id for r in rs if r.parity >= 0 or r.hours or r.exits]
    return events.withColumn("mae_proxy", F.when(~F.col("rule_id").isin(filtered), F.col("mae_proxy")))
