"""Per-symbol batch features and the theory features of the pair frame."""
from __future__ import annotations

from typing import Sequence

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import windows as W
from ..functions.nulls import flag, gt, lt, sign, zero_to_null
from ..functions.scalar import minute_of_day
from ..operators.blocks import block_window, drop_halo, in_blocks
from ..operators.prefix import run_length
from ..operators.store import stored
from .frame import KEYS


def batch_features(bars: DataFrame, span: int = 86400 * 14, keys: Sequence[str] = ("symbol",),
                   keep: Sequence[str] = ()) -> DataFrame:
    """atr14, er20, rv48, vwap48 per symbol. The definitions differ from the pair frame on purpose:
    first-bar range counts, rv48 is the sample deviation of log returns, vwap48 uses the typical price."""
    keys = list(keys)

    def build(d: DataFrame, w) -> DataFrame:
        c, h, l, v = (F.col(k) for k in ("close", "high", "low", "volume"))
        pc = W.lag(c, w)
        d = d.withColumns({"_tr": W.true_range(h, l, pc, first="range"), "_lr": F.log(c / pc), "_st": F.abs(c - pc),
                           "_tpv": (h + l + c) / 3.0 * v})
        return d.withColumns({
            "atr14": W.mean(F.col("_tr"), w, 14),
            "er20": W.efficiency_ratio(F.abs(W.diff(c, w, 20)), F.col("_st"), w, 20),
            "rv48": W.std(F.col("_lr"), w, 48, ddof=1), "vwap48": W.vwap(F.col("_tpv"), v, w, 48)})

    d = in_blocks(bars, keys, build, back=64, span=span)
    return d.select(*keys, "ts", *keep, "atr14", "er20", "rv48", "vwap48")


THEORY = ["hour_sin", "hour_cos", "rv_compressed_4h", "oi_expanding_3h", "funding_pos_hours", "funding_neg_hours",
          "liq_cluster_2h", "funding_chg_1h", "btc_eth_div_1h", "oi_velocity", "liq_imbalance_dir", "spread_chg_1h",
          "ret_4h_btc", "vol_price_div", "ret_4h_eth", "eth_slope_4h", "btc_slope_4h", "btc_eth_corr_2h",
          "bar_dir_run", "rv_chg_1h", "funding_accel", "oi_vol_ratio"]


def theory_features(blocked: DataFrame, span: int, w_day: int = 288, min_day: int = 100) -> DataFrame:
    """The further feature set of the mining jobs, from a blocked pair frame. A feature whose inputs are
    absent is the neutral constant. The two streak features need unbounded history and are finished with
    the two-level running operator after the blocks are closed."""
    x, w = blocked, block_window(KEYS)
    have = set(x.columns)
    hour = minute_of_day(F.col("ts")) / 60.0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    chg = lambda c, k=12: c - W.lag(c, w, k)
    accel = lambda c: (c - W.lag(c, w, 12)) - (W.lag(c, w, 12) - W.lag(c, w, 24))
    sp, rv = F.coalesce("spread_pct", F.lit(0.5)), F.coalesce("rv48_pct_btc", F.lit(0.5))
    one = {
        "hour_sin": F.sin(hour * (2 * math.pi / 24.0)), "hour_cos": F.cos(hour * (2 * math.pi / 24.0)),
        "rv_compressed_4h": flag(W.sustained(lt(F.col("rv48_pct_btc"), 0.20), w, 48)),
        "btc_eth_div_1h": F.col("_r1h_btc") - F.col("_r1h_eth"),
        "spread_chg_1h": chg(sp), "rv_chg_1h": chg(rv),
        "ret_4h_btc": F.col("_r4h_btc"), "ret_4h_eth": F.col("_r4h_eth"),
        "eth_slope_4h": sign(F.col("_r4h_eth")), "btc_slope_4h": sign(F.col("_r4h_btc")),
        "vol_price_div": flag(gt(F.col("volume_btc_pct"), 0.70) & lt(F.col("ret1_abs_btc"), F.col("_absret_day_q30"))).cast("double"),
        "_dir": zero(sign(F.col("ret1_btc"))),
    }
    one["_dir1"] = W.lag(one["_dir"], w)
    if "oi_contracts_btc" in have:
        oi = F.col("oi_contracts_btc")
        up = lambda a, b: gt(W.lag(oi, w, a) if a else oi, W.lag(oi, w, b))
        one["oi_expanding_3h"] = flag(up(0, 12) & up(12, 24) & up(24, 36))
        one["_oic"] = zero(chg(oi))
    if "funding_rate_btc" in have:
        f = zero(F.col("funding_rate_btc"))
        one |= {"funding_chg_1h": chg(f), "funding_accel": accel(f), "_f": f}
    if "total_liq_btc_pct" in have:
        t = F.col("total_liq_btc_pct")
        active = lambda k: flag(gt(W.lag(t, w, k) if k else t, 0.0))
        one["liq_cluster_2h"] = flag((active(0) + active(12) + active(24)) >= 2)
        one["liq_imbalance_dir"] = F.coalesce(F.col("long_liq_btc_pct") / zero_to_null(t), F.lit(0.5)) - 0.5
    x = x.withColumns(one)
    if "_oic" in x.columns:
        pct = F.coalesce(W.pct_rank(F.col("_oic"), w, w_day, min_day), F.lit(0.5))
        x = x.withColumn("oi_vol_ratio", pct / (F.coalesce("volume_btc_pct", F.lit(0.5)) + 0.01))
    absent = {"oi_expanding_3h": 0, "oi_velocity": 0.0, "oi_vol_ratio": 1.0, "funding_chg_1h": 0.0, "funding_accel": 0.0,
              "liq_cluster_2h": 0, "liq_imbalance_dir": 0.0}
    x = x.withColumns({k: F.lit(v) for k, v in absent.items() if k not in x.columns})
    x = stored(drop_halo(x))
    ts = F.col("ts")
    go = (F.col("_dir") != 0) & F.coalesce(F.col("_dir") == F.col("_dir1"), F.lit(False))
    # a streak counts its first bar, so its break lies one row earlier
    x = run_length(x, KEYS, ["ts"], go, "_run", ts, span)
    x = x.withColumn("bar_dir_run", F.col("_dir") * (F.col("_run") + 1.0))
    if "_f" in x.columns:
        for name, c in (("funding_pos_hours", F.col("_f") > 0), ("funding_neg_hours", F.col("_f") < 0)):
            x = run_length(x, KEYS, ["ts"], c, name, ts, span).withColumn(name, F.col(name) / 12.0)
    else:
        x = x.withColumns({"funding_pos_hours": F.lit(0.0), "funding_neg_hours": F.lit(0.0)})
    return x
