"""Rules and exits against a row-by-row walk on a small fixture."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions.nulls import ne
from barlab.operators.exits import EXIT_FIELDS, first_touch
from barlab.plans import events as EV
from barlab.plans import frame as FR
from barlab.plans import rules as RL
from checks.fixtures import CFG

N = 700


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    ts = np.sort(r.choice(np.arange(900), N, replace=False)) * 3600 + 1704067200
    p = pd.DataFrame({"pair": "a/b", "ts": ts})
    for a in ("btc", "eth"):
        c = 100 * np.exp(np.cumsum(r.normal(0, .004, N)))
        o = c * (1 + r.normal(0, .002, N))
        p[f"open_{a}"], p[f"close_{a}"] = o, c
        p[f"high_{a}"] = np.maximum(o, c) * (1 + abs(r.normal(0, .001, N)))
        p[f"low_{a}"] = np.minimum(o, c) * (1 - abs(r.normal(0, .001, N)))
        p[f"volume_{a}"] = r.gamma(2, 50, N)
    s = p[["pair", "ts"]].iloc[::4].copy()
    k = len(s)
    for a in ("btc", "eth"):
        s[f"funding_rate_{a}"] = r.normal(0, 1e-4, k)
        s[f"oi_contracts_{a}"] = 1000 + np.cumsum(r.normal(0, 5, k))
        s[f"long_liq_usd_{a}"], s[f"short_liq_usd_{a}"] = r.gamma(1, 10, k), r.gamma(1, 10, k)
    s["hmm_regime"] = r.choice(["TRENDING", "RANGING", "VOLATILE"], k)
    pair, side = spark.createDataFrame(p), spark.createDataFrame(s)
    from barlab.operators.store import stored
    pair = stored(pair)
    slow = {"all": stored(side)}
    x = FR.blocked_frame(pair, CFG, slow)
    f = x.where("own").drop("blk", "own").toPandas().sort_values("ts", ignore_index=True)
    ev = stored(EV.build_events(pair, CFG, slow)).toPandas()
    return f, ev


def test_catalogue():
    rs = RL.rules()
    assert len(rs) == 218 and len({r.number for r in rs}) == 218
    by = {r.number: r for r in rs}
    assert by[77].leg == "eth" and by[77].offset == 0        # lag listed nowhere for this one: the leg wins
    assert by[76].offset == 1 and by[261].horizon == 48 and by[198].exits == {"atr_stop": 1.5}


def walk(mask, need):
    out, last = [], -10 ** 9
    for i in np.flatnonzero(mask):
        n = need if np.isscalar(need) else need[i]
        if i - last >= n:
            out.append(i)
            last = i
    return out


def expect(f, rule, mask, direction, pre=None):
    """Thin, price and filter as a plain loop."""
    d = np.where(mask, direction, 0.0)
    if pre is not None:
        keep = walk(mask, pre)
        z = np.zeros(len(f))
        z[keep] = d[keep]
        d = z
    idx = walk(d != 0, rule.horizon)  # NaN != 0 holds
    c = f[f"close_{rule.leg}"].to_numpy()
    out = []
    for i in idx:
        e, x = i + rule.offset, i + rule.offset + rule.horizon
        if np.isnan(d[i]) or x >= len(f):
            continue
        t = pd.Timestamp(f.ts[i], unit="s")
        if rule.parity >= 0 and t.day % 2 != rule.parity:
            continue
        if rule.hours and not rule.hours[0] <= t.hour < rule.hours[1]:
            continue
        out.append((int(f.ts[i]), float(d[i]), round(d[i] * (c[x] / c[e] - 1), 10)))
    return out


def flips(s):
    p = s.shift(1)
    return (s.ne(p) & s.ne(0)).to_numpy()


CASES = {}


def case(*numbers, pre=None):
    def add(fn):
        for n in numbers:
            CASES[n] = (fn, pre)
        return fn
    return add


@case(39, 60, 61, 70, 71, 83, 84, 85)
def _(f):
    return flips(f.eth_slope_sign_1h), f.eth_slope_sign_1h


@case(59, 62, 68, 76, 82)
def _(f):
    return flips(f.btc_slope_sign_1h), f.btc_slope_sign_1h


@case(93)
def _(f):
    sh = f.ret1_abs_eth_pct.ge(.95)
    black = sh.astype(float).shift(1).rolling(6, min_periods=1).max().fillna(0).gt(0)
    return (f.ret1_abs_btc_pct.ge(.25) & f.ret1_abs_btc_pct.lt(.75) & ~sh & ~black & f.eth_slope_sign_1h.ne(0)).to_numpy(), f.eth_slope_sign_1h


def _tier(f):
    z = f.eth_slope_z_1h.abs()
    return np.where(z.ge(1.25), 6, 24)


@case(95, pre=_tier)
def _(f):
    return (f.eth_slope_z_1h.abs().ge(.9) & f.eth_slope_sign_1h.ne(0)).to_numpy(), f.eth_slope_sign_1h


@case(98)
def _(f):
    v, s = f.ret1_abs_btc_pct, f.ret1_abs_btc_pct.ge(.9)
    ex = s.shift(1, fill_value=False) & ~s
    wait = ex.astype(float).rolling(4, min_periods=1).max().gt(0)
    return (v.ge(.2) & v.lt(.9) & ~wait & f.eth_slope_sign_1h.ne(0)).to_numpy(), f.eth_slope_sign_1h


@case(100)
def _(f):
    S = f.eth_slope_sign_1h
    c = f.btc_slope_sign_1h.eq(S) & S.ne(0) & f.eth_slope_abs_pct_1h.ge(.75) & f.ret1_abs_btc_pct.ge(.3) & f.ret1_abs_btc_pct.lt(.85)
    rank = f.eth_slope_abs_pct_1h.where(c).groupby(f.ts // 86400).rank(method="first", ascending=False)
    return (c & rank.le(2)).to_numpy(), S


@case(111, pre=lambda f: 10)
def _(f):
    sp = f.ret1_btc - f.ret1_eth
    z = (sp - sp.rolling(96).mean()) / sp.rolling(96).std(ddof=0)
    d = np.where(z.ge(2), -1.0, np.where(z.le(-2), 1.0, 0.0))
    m = (f.ts % 86400) // 60
    ok = f.rv48_pct_btc.ge(.25) & f.rv48_pct_btc.lt(.8) & f.rv48_pct_eth.ge(.25) & f.rv48_pct_eth.lt(.8) & m.ge(480) & m.lt(1320)
    return ((d != 0) & ok).to_numpy(), d


@case(28)
def _(f):
    c, ph, pl = f.close_btc, f.high_btc.shift(1).rolling(12).max(), f.low_btc.shift(1).rolling(12).min()
    up, dn = c.gt(ph), c.lt(pl)
    sh = lambda b, k: b.shift(k, fill_value=False)
    hi = (sh(up, 1) & c.le(ph.shift(1))) | (sh(up, 2) & c.le(ph.shift(2)))
    lo = (sh(dn, 1) & c.ge(pl.shift(1))) | (sh(dn, 2) & c.ge(pl.shift(2)))
    return (hi | lo).to_numpy(), np.where(hi, -1.0, 1.0)


@case(49)
def _(f):
    t = f.tr_btc.le(f.tr_btc_q25)
    return (t.astype(float).shift(1).rolling(5).sum().eq(5) & f.tr_btc.gt(f.tr_btc_q25)).to_numpy(), f.bar_dir_btc


@case(122)
def _(f):
    return f.funding_btc_flip.fillna(False).to_numpy(bool), f.funding_btc_sign


@case(140)
def _(f):
    c = f.funding_btc_pct.le(.1)
    return (c & ~c.shift(1, fill_value=False)).to_numpy(), np.ones(len(f))


@case(144)
def _(f):
    S = f.eth_slope_sign_1h
    return (f.funding_btc_pct.ge(.85).astype(float).rolling(36).min().eq(1) & S.eq(-1) & S.shift(1).eq(1)).to_numpy(), -np.ones(len(f))


@case(238)
def _(f):
    p = f.funding_btc_sign.gt(0).astype(float).rolling(72).min().fillna(0).gt(0)
    return (p & ~p.shift(1, fill_value=False)).to_numpy(), -np.ones(len(f))


@case(177, 191, 240, 221, 222)
def _(f):
    c = f.long_liq_btc_pct.ge(.9)
    return (c & ~c.shift(1, fill_value=False)).to_numpy(), -np.ones(len(f))


@case(243, 249)
def _(f):
    c = f.total_liq_btc_pct.ge(.7) & f.liq_imbalance_btc.ge(.65)
    return (c & ~c.shift(1, fill_value=False)).to_numpy(), -np.ones(len(f))


@case(250, 259)
def _(f):
    oi = f.oi_contracts_btc
    return flips(f.eth_slope_sign_1h) & (oi - oi.shift(12)).gt(oi.shift(12) - oi.shift(24)).to_numpy(), f.eth_slope_sign_1h


@case(244)
def _(f):
    oi = f.oi_contracts_btc
    v = oi - oi.shift(12) - (oi.shift(12) - oi.shift(24))
    a = v.gt(v.rolling(24, min_periods=12).quantile(.8))
    return (a & ~a.shift(1, fill_value=False)).to_numpy(), np.ones(len(f))


@case(226)
def _(f):
    S, fs = f.eth_slope_sign_1h, f.funding_btc_sign
    return flips(S) & (fs.ne(S) & fs.ne(0)).to_numpy(), S


@case(229)
def _(f):
    return flips(f.eth_slope_sign_1h) & f.hmm_regime.eq("TRENDING").to_numpy(), f.eth_slope_sign_1h


@case(253)
def _(f):
    r = f.close_btc.pct_change(48).fillna(0)
    a = r.gt(r.rolling(24, min_periods=12).quantile(.8))
    return (a & ~a.shift(1, fill_value=False)).to_numpy(), -np.ones(len(f))


@case(256)
def _(f):
    a, b = f.ret1_btc.fillna(0), f.ret1_eth.fillna(0)
    c = a.rolling(24).corr(b).fillna(0)
    return flips(f.eth_slope_sign_1h) & c.lt(c.rolling(120, min_periods=36).quantile(.2)).to_numpy(), f.eth_slope_sign_1h


@case(103)
def _(f):
    dec = f.atr14.diff().lt(0)
    s = np.sign(f.dist_to_vwap48)
    m = f.rv48_pct.ge(.9) & dec & dec.shift(1, fill_value=False) & dec.shift(2, fill_value=False) & s.eq(s.shift(1)) & s.ne(0)
    return m.to_numpy(), -s


@pytest.mark.parametrize("number", sorted(CASES))
def test_rule_matches_walk(data, number):
    f, ev = data
    fn, pre = CASES[number]
    mask, d = fn(f)
    rule = RL.rules([number])[0]
    want = expect(f, rule, np.asarray(mask, bool), np.asarray(d, float), pre(f) if pre else None)
    got = ev[ev.rule_id == rule.rule_id].sort_values("ts")
    assert [(int(a), float(b), round(c, 10)) for a, b, c in zip(got.ts, got.signal_dir, got.gross_r)] == want


def loop_exit(path, direction, ep, atr, slope, spec):
    peak, latched, run = ep, False, 0
    for bar in path:
        px = bar["px"]
        pnl = direction * (px / ep - 1)
        peak = max(peak, px) if direction > 0 else min(peak, px)
        latched |= spec.get("breakeven_bps", 0) > 0 and pnl >= spec.get("breakeven_bps", 0) / 1e4
        beyond = lambda lo, hi: px <= lo if direction > 0 else px >= hi
        m = spec.get("atr_stop", 0)
        if m and atr > 0 and beyond(ep - m * atr, ep + m * atr):
            return px
        if spec.get("tp_bps") and pnl >= spec["tp_bps"] / 1e4:
            return px
        t = spec.get("trail_bps", 0) / 1e4 * ep
        if t and beyond(peak - t, peak + t):
            return px
        if latched and beyond(ep, ep):
            return px
        if spec.get("watch") and bar[spec["watch"]] < spec["watch_min"]:
            return px
        if spec.get("slope_exit") and bar["slope"] != 0 and bar["slope"] != slope:
            return px
        if spec.get("collapse"):
            run = run + 1 if bar[spec["collapse"]] < spec["collapse_below"] else 0
            if run >= spec.get("collapse_bars", 2):
                return px
    return None


@pytest.mark.parametrize("number", sorted(RL.EXITS))
def test_exit_matches_loop(spark, number):
    r = np.random.default_rng(number)
    spec = RL.EXITS[number]
    names = ["long_liq_btc_pct", "short_liq_btc_pct", "total_liq_btc_pct", "volume_btc_pct"]
    rows = []
    for i in range(150):
        px = 100 * np.exp(np.cumsum(r.normal(0, .002, 10)))
        path = [dict(px=float(p), slope=float(r.choice([-1, 0, 1])), **{n: float(v) for n, v in zip(names, r.beta(4, 2, 4))}) for p in px]
        rows.append((i, path, float(r.choice([-1, 1])), 100.0, float(abs(r.normal(0, .2))), float(r.choice([-1, 1]))))
    d = spark.createDataFrame(rows, "i int, path array<struct<px:double,slope:double," + ",".join(f"{n}:double" for n in names) + ">>, d double, ep double, atr double, sl double")
    fields = [x.split() for x in EXIT_FIELDS.split(", ")]
    s = F.struct(*[F.lit(spec.get(n)).cast(t).alias(n) for n, t in fields])
    got = {x.i: x.e for x in d.select("i", first_touch(F.col("path"), F.col("d"), F.col("ep"), F.col("atr"), F.col("sl"), s).alias("e")).collect()}
    for i, path, di, ep, atr, sl in rows:
        assert got[i] == loop_exit(path, di, ep, atr, sl, spec), i


def test_user_rule(spark, data):
    f, _ = data
    pair = spark.createDataFrame(f[["pair", "ts"] + [f"{k}_{a}" for a in ("btc", "eth") for k in ("open", "high", "low", "close", "volume")]])
    mine = RL.Rule(9001, "mine", "tall_bar", horizon=5)
    sig = RL.Signal(F.coalesce(F.col("tr_btc") > F.col("atr14_btc") * 1.5, F.lit(False)), F.col("bar_dir_btc"))
    ev = EV.build_events(pair, CFG, numbers=[], extra={"tall_bar": sig}, extra_rules=[mine]).toPandas().sort_values("ts")
    mask = f.tr_btc.gt(f.atr14_btc * 1.5).to_numpy()
    assert [(int(a), float(b), round(c, 10)) for a, b, c in zip(ev.ts, ev.signal_dir, ev.gross_r)] == expect(f, mine, mask, f.bar_dir_btc.to_numpy())


def test_missing_inputs_are_named(spark, data):
    f, _ = data
    pair = spark.createDataFrame(f[["pair", "ts"] + [f"{k}_{a}" for a in ("btc", "eth") for k in ("open", "high", "low", "close", "volume")]])
    with pytest.raises(ValueError, match="funding_flip"):
        EV.build_events(pair, CFG, numbers=[122])


@pytest.fixture(scope="module")
def long_pair(spark):
    from barlab.operators.store import stored
    r = np.random.default_rng(5)
    n = 3000
    p = pd.DataFrame({"pair": "a/b", "ts": np.arange(n) * 60 + 1704067200})
    for a in ("btc", "eth"):
        c = 100 * np.exp(np.cumsum(r.normal(0, .001, n)))
        for k, v in (("open", c), ("high", c * 1.001), ("low", c * .999), ("close", c), ("volume", r.gamma(2, 50, n))):
            p[f"{k}_{a}"] = v
    return p, stored(spark.createDataFrame(p))


def own(numbers, signal, **kw):
    return [RL.Rule(900 + h, "own", signal, horizon=h, **kw) for h in numbers]


def test_holding_periods_longer_than_a_block(long_pair):
    p, pair = long_pair
    every = RL.Signal(F.col("idx") % 100 == 0, F.lit(1.0))
    rs = own([8, 300, 400, 600, 1400], "every")
    ev = EV.build_events(pair, CFG.small(step=60), numbers=[], extra={"every": every}, extra_rules=rs)
    got = {(r.rule_id, r.idx): r.exit_px for r in ev.collect()}
    close = p["close_btc"].to_numpy()
    want = {(r.rule_id, i): close[i + r.horizon] for r in rs for i in walk(np.arange(len(p)) % 100 == 0, r.horizon) if i + r.horizon < len(p)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_own_signal_with_history_across_blocks(long_pair):
    p, pair = long_pair
    w = FR.block_window(FR.KEYS)
    up = RL.W.lag(F.col("close_btc"), w, 600) < F.col("close_btc")
    s = RL.Signal(F.col("own_edge"), F.lit(1.0), helpers={"own_up": F.coalesce(up, F.lit(False)), "own_edge": RL.W.onset(F.col("own_up"), w)}, back=601)
    ev = EV.build_events(pair, CFG.small(step=60), numbers=[], extra={"edge": s}, extra_rules=own([5], "edge"))
    c = p["close_btc"]
    u = (c > c.shift(600)).to_numpy()
    edge = u & ~np.r_[False, u[:-1]]
    assert sorted(r.idx for r in ev.collect()) == [i for i in walk(edge, 5) if i + 5 < len(p)]


def test_exits_follow_the_traded_leg_from_the_entry_bar(long_pair):
    p, pair = long_pair
    every = RL.Signal(F.col("idx") % 20 == 0, F.when(F.col("idx") % 40 == 0, 1.0).otherwise(-1.0))
    rs = own([12], "every", leg="eth", offset=1, exits=dict(tp_bps=10))
    got = {r.idx: r.exit_px for r in EV.build_events(pair, CFG.small(step=60), numbers=[], extra={"every": every}, extra_rules=rs).collect()}
    px = p["close_eth"].to_numpy()
    for i, v in got.items():
        e, d = i + 1, 1 if i % 40 == 0 else -1
        early = [k for k in range(e + 1, e + 13) if d * (px[k] / px[e] - 1) >= 0.001]
        assert v == px[early[0] if early else e + 12]
    assert len(got) == 150 - sum(i + 13 >= len(p) for i in range(0, 3000, 20))


def test_two_a_day_on_minute_bars(spark, long_pair):
    rows = [("a", 60 * i, i, RL.BEST, 1.0, float((i * 37) % 1000)) for i in range(3000)] + [("a", 60, 1, "other", 1.0, 0.0)]
    hits = spark.createDataFrame(rows, "pair string, ts long, idx long, signal string, dir double, s double")
    got = RL.best_of_day(hits, "s").collect()
    assert sum(r.signal == "other" for r in got) == 1
    days = {}
    for r in got:
        if r.signal == RL.BEST:
            days.setdefault(r.ts // 86400, []).append(r.idx)
    for d, v in days.items():
        of = [i for i in range(3000) if 60 * i // 86400 == d]
        assert sorted(v) == sorted(sorted(of, key=lambda i: (-((i * 37) % 1000), i))[:2])
