"""Logical schemas of the tables the jobs read and write."""
from __future__ import annotations

from pyspark.sql import types as T


def _s(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


D, L, S, I, B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()

# prices and volumes are decimals at rest and doubles in every computation
PRICE, VOLUME, RATE, USD = (T.DecimalType(20, 10), T.DecimalType(30, 10),
                            T.DecimalType(14, 10), T.DecimalType(30, 4))

BARS = _s(symbol=S, ts=L, open=D, high=D, low=D, close=D, volume=D)
BARS_AT_REST = _s(symbol=S, timeframe=S, ts=T.TimestampType(), open=PRICE, high=PRICE, low=PRICE,
                  close=PRICE, volume=VOLUME, ingested_at=T.TimestampType())
FEATURES_LONG = _s(symbol=S, timeframe=S, ts=L, feature_name=S, feature_version=S, feature_value=D)
FUNDING = _s(symbol=S, venue=S, ts=L, funding_rate=D)
OPEN_INTEREST = _s(symbol=S, venue=S, ts=L, oi_contracts=D, oi_usd=D)
LIQUIDATIONS = _s(symbol=S, venue=S, ts=L, window_minutes=I, long_liq_usd=D, short_liq_usd=D)
REGIME_LABELS = _s(symbol=S, ts=L, timeframe=S, state_id=I, regime_name=S, model_train_end=S,
                   run_date=T.DateType())
EVENTS = _s(rule_id=S, ts=L, signal_dir=D, entry_px=D, exit_px=D, fwd_r=D, gross_r=D, mae_proxy=D)
TRADES = _s(strategy_name=S, symbol=S, entry_ts=L, exit_ts=L, entry_price=D, exit_price=D,
            breakout_level=D, er=D, atr=D, exit_reason=S, pnl=D, pnl_pct=D, qty=D, risk_usd=D,
            stop_dist=D, entry_cost=D, exit_cost=D, total_cost=D, equity_before=D, equity_after=D,
            r_multiple=D, mae_r=D, mfe_r=D, bars_to_stop=I, stop_price_used=D, exit_price_used=D,
            risk_per_unit=D)
POSITIONS = _s(position_id=L, hypothesis=S, symbol=S, side=S, status=S, opened_at=L, closed_at=L,
               qty=D, avg_entry_price=D, avg_exit_price=D, realized_pnl=D)

_METRIC = _s(n=L, win_rate=D, mean=D, std=D, mean_ci_low=D, mean_ci_high=D, p_mean_gt_0=D)
_FOLD = _s(fold_id=I, test_start=S, test_end=S, n=L, mean=D)
_WF = _s(folds=T.ArrayType(_FOLD),
         aggregate=_s(n=L, mean=D, mean_ci_low=D, mean_ci_high=D, p_mean_gt_0=D),
         positive_folds=_s(count=L, total=L, pct=D))
RUN_DOCUMENT = _s(hypothesis_id=S, family=S, timestamp_utc=S,
                  baseline=T.MapType(S, _METRIC), wf_by_mode=T.MapType(S, _WF))
