"""Headline timings. Prints one JSON line.

The workload is the research batch: bars from raw events, the full feature frame and the whole rule
catalogue over all ordered pairs of symbols, folds, bootstrap and verdicts, plus a few operators alone.
"""
from __future__ import annotations

import json
import os
import sys
import time
from itertools import permutations

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from barlab.functions.scalar import COST_MODES, with_cost_modes  # noqa: E402
from barlab.operators import stats  # noqa: E402
from barlab.operators.store import stored  # noqa: E402
from barlab.plans import classify as C  # noqa: E402
from barlab.plans import events as EV  # noqa: E402
from barlab.plans import frame as FR  # noqa: E402
from barlab.plans import rules as RL  # noqa: E402
from barlab.session import session  # noqa: E402
from barlab.sources import derive, readers  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
CFG = FR.FrameConfig(w_spread=480, w_slow=240, w_deriv=5760, w_corr=5760, block=12000)


def slow_series(bars):
    """Hourly side series of every pair from the bars themselves."""
    p = readers.pair_bars(bars.where("ts % 3600 = 0"), list(permutations(SYMBOLS, 2)))
    c = F.col
    return {
        "funding": p.select("pair", "ts", *[((c(f"close_{a}") - 115) / 1e4).alias(f"funding_rate_{a}") for a in ("btc", "eth")]),
        "oi": p.select("pair", "ts", *[(c(f"volume_{a}") * 3 + c(f"high_{a}")).alias(f"oi_contracts_{a}") for a in ("btc", "eth")]),
        "liq": p.select("pair", "ts", *[(c(f"{x}_{a}") - 100).alias(f"{s}_liq_usd_{a}") for a in ("btc", "eth") for s, x in (("long", "high"), ("short", "close"))]),
        "regime": p.select("pair", "ts", F.element_at(F.array(F.lit("TRENDING"), F.lit("RANGING"), F.lit("VOLATILE")), (F.pmod(c("ts") / 3600, F.lit(3)) + 1).cast("int")).alias("hmm_regime")),
    }


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        r = fn()
        out[name] = round(time.time() - t, 3)
        return r

    bars = timed("bars_5m", lambda: stored(derive.event_bars(spark, SF, 300)))
    pair = timed("pair_bars_20", lambda: stored(readers.pair_bars(bars, list(permutations(SYMBOLS, 2)))))
    slow = {k: stored(v) for k, v in slow_series(bars).items()}
    rows = pair.count()
    # one blocked frame with every column serves the frame and all rules
    frame = timed("feature_frame_20_pairs", lambda: stored(EV.rule_frame(pair, CFG, slow, every_column=True)))
    ev = timed("events_218_rules_20_pairs", lambda: stored(EV.events_from_blocked(frame, RL.rules())))
    by = ["pair", "rule_id"]
    every = stats.dense_grid(spark, pair=["/".join(p) for p in permutations(SYMBOLS, 2)], rule_id=[r.rule_id for r in RL.rules()])
    cells = stats.expand(every, mode=list(COST_MODES))
    timed("baseline_modes", lambda: stats.baseline(with_cost_modes(ev), [*by, "mode"], groups=cells).write.format("noop").mode("overwrite").save())
    wf = timed("walkforward_3000", lambda: stored(stats.walkforward(ev, by, 6, 3, 3, iters=3000, order=["ts", "idx"], groups=every)))
    ci = timed("bootstrap_3000", lambda: stored(stats.bootstrap_ci(stats.bootstrap_means(ev, by, "gross_r", ["ts", "idx"], 3000, 42), by)))
    def verdict():
        b = stats.baseline(with_cost_modes(ev), [*by, "mode"], groups=cells).join(ci, [*by, "mode"], "left").join(wf, [*by, "mode"], "left")
        return C.status_counts(C.combine_status(C.classify(b), by)).collect()
    timed("verdicts", verdict)
    timed("flagship_one_rule", lambda: EV.build_events(pair, CFG, numbers=[39]).write.format("noop").mode("overwrite").save())
    from checks.catalog import QUERIES
    for q in ("asof_slow_series", "rolling_ranks_quantiles", "thinning", "trade_summary", "portfolio_events", "shock_by_volatility_study", "stream_bars"):
        timed(q, lambda: QUERIES[q](spark, SF).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "research_batch_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(SF).replace("sf", ""), "pair_bars": rows, "events": ev.count(), "cpus": CPUS}))


if __name__ == "__main__":
    main()
