"""Exits and selection against a bar-by-bar walk written for the tests, and the rules one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import selection as SEL
from tradeloom.operators import trades as X
from tradeloom.operators.barriers import first_touch, range_extremes, summary_tree

COMBOS = "combo_id int, stop_pts double, min_rr double, exit_on_opposite boolean, use_breakeven boolean, max_hold_bars int, tod_exit_hour int, cooldown_bars int"


def make_bars(spark, bars):
    df = pd.DataFrame(bars, columns=["symbol", "bar_idx", "open", "high", "low", "close"])
    df["time"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(df.bar_idx, unit="h")
    return spark.createDataFrame(df)


def run(spark, bars, signals, combos, tp_first=True):
    b = make_bars(spark, bars)
    sig = spark.createDataFrame(signals, "symbol string, bar_idx bigint, signal int").crossJoin(spark.createDataFrame(combos, COMBOS))
    return X.backtest(X.entries(sig, X.price_bars(b)), sig, b, tp_first)


def walk(bars, signals, combo, tp_first):
    """One symbol, one combo, read forwards."""
    cid, stop, rr, opposite, breakeven, hold, hour, cool = combo
    o, h, lo, c = (np.array([r[i] for r in bars]) for i in (2, 3, 4, 5))
    sig = dict((i, s) for _, i, s in signals)
    n, free, out = len(bars), 0, []
    for t in range(n):
        if t < free or sig.get(t, 0) == 0 or t + 1 >= n:
            continue
        side, entry = sig[t], o[t + 1]
        goal, guard, mae, mfe = entry + side * stop * rr, entry - side * stop, 0.0, 0.0
        for j in range(t + 1, n):
            bad, good = (lo[j] - entry, h[j] - entry) if side == 1 else (entry - h[j], entry - lo[j])
            mae, mfe = min(mae, bad), max(mfe, good)
            if breakeven and (h[j] >= entry + stop if side == 1 else lo[j] <= entry - stop):
                guard = entry
            hit_stop = lo[j] <= guard if side == 1 else h[j] >= guard
            hit_goal = h[j] >= goal if side == 1 else lo[j] <= goal
            more = j + 1 < n
            if hit_goal and (tp_first or not hit_stop):
                leave = (2, goal)
            elif hit_stop:
                leave = (1, guard)
            elif opposite and sig.get(j, 0) == -side and more:
                leave = (3, o[j + 1])
            elif hold and j - t >= hold and more:
                leave = (5, o[j + 1])
            elif hour and j % 24 == hour and more:
                leave = (5, o[j + 1])
            elif not more:
                leave = (4, c[j])
            else:
                continue
            out.append((cid, t, j, leave[0], round(leave[1], 6), round(mae, 6), round(mfe, 6), j - t))
            free = max(j + 1, j + cool)
            break
    return out


def random_bars(rng, n, symbol="s"):
    close = 100 + np.cumsum(rng.normal(0, 1.0, n))
    open_ = np.round(close + rng.normal(0, 0.3, n), 2)
    close = np.round(close, 2)
    high = np.round(np.maximum(open_, close) + rng.exponential(0.5, n), 2)
    low = np.round(np.minimum(open_, close) - rng.exponential(0.5, n), 2)
    return [(symbol, i, *map(float, r)) for i, r in enumerate(zip(open_, high, low, close))]


@pytest.mark.parametrize("tp_first", [True, False])
def test_backtest_matches_walk(spark, tp_first):
    rng = np.random.default_rng(11)
    bars = random_bars(rng, 700)  # more than 64 * 10 bars, so searches climb and descend the tree
    signals = [("s", i, int(s)) for i, s in enumerate(rng.choice([-1, 0, 0, 0, 1], len(bars))) if s]
    combos = [
        (0, 3.0, 2.0, False, False, 0, 0, 0), (1, 12.0, 2.0, False, True, 0, 0, 0), (2, 2.0, 1.0, True, False, 10, 0, 4),
        (3, 5.0, 3.0, False, True, 0, 16, 1), (4, 40.0, 4.0, False, False, 0, 0, 7), (5, 1.0, 1.5, True, True, 30, 9, 0),
    ]
    got = run(spark, bars, signals, combos, tp_first).toPandas()
    for combo in combos:
        mine = got[got.combo_id == combo[0]].sort_values("signal_bar")
        rows = [(combo[0], r.signal_bar, r.exit_bar, r.exit_reason, round(r.exit_price, 6), round(r.mae_pts, 6), round(r.mfe_pts, 6), r.hold_bars) for r in mine.itertuples()]
        assert rows == walk(bars, signals, combo, tp_first)


def test_tree_search_and_extremes(spark):
    rng = np.random.default_rng(5)
    bars = random_bars(rng, 5000)
    b = make_bars(spark, bars)
    tree = summary_tree(b, ["symbol"])
    assert len(tree) == 3
    high, low = np.array([r[3] for r in bars]), np.array([r[4] for r in bars])
    asks = [(int(i), int(rng.integers(0, 5000)), float(rng.normal(100, 25)), bool(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(asks, "i int, a bigint, level double, up boolean").withColumn("symbol", F.lit("s"))
    hits = {r.i: r.hit for r in first_touch(df, tree, ["symbol"], F.col("a"), F.col("level"), F.col("up"), "hit").collect()}
    for i, a, level, up in asks:
        where = np.nonzero(high[a:] >= level if up else low[a:] <= level)[0]
        assert hits[i] == (a + where[0] if len(where) else None)
    spans = df.withColumn("b", F.least(F.col("a") + F.col("i") * 13, F.lit(4999)))
    for r in range_extremes(spans, tree, ["symbol"], F.col("a"), F.col("b"), "hi", "lo").collect():
        assert r.hi == high[r.a : r.b + 1].max() and r.lo == low[r.a : r.b + 1].min()


@pytest.mark.parametrize("limit", [0, 3, 512])
def test_selection_paths_agree(spark, limit):
    """Pointer doubling, folding and a mix of both keep the same candidates."""
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for key, reach in (("a", 4), ("b", 60), ("c", 3000)):
        starts = np.sort(rng.choice(9000, 250, replace=False))
        free = starts + 1 + rng.integers(0, reach, len(starts))
        rows += [(key, int(s), int(f)) for s, f in zip(starts, free)]
        until = -1
        for s, f in zip(starts, free):
            if s >= until:
                want.add((key, int(s)))
                until = f
    df = spark.createDataFrame(rows, "k string, signal_bar bigint, free_at bigint")
    got = SEL.select_non_overlapping(df, ["k"], longest_fold=limit)
    assert got.columns == df.columns
    assert {(r.k, r.signal_bar) for r in got.collect()} == want


FLAT = [("s", i, 100.0, 100.5, 99.5, 100.0) for i in range(8)]
PLAIN = (0, 10.0, 1.0, False, False, 0, 0, 0)


def test_one_bar_touches_both_barriers(spark):
    bars = list(FLAT)
    bars[3] = ("s", 3, 100.0, 111.0, 89.0, 100.0)
    both = [run(spark, bars, [("s", 1, 1)], [PLAIN], first).first().exit_reason for first in (True, False)]
    assert both == [2, 1]


def test_break_even_on_the_same_bar(spark):
    bars = list(FLAT)
    bars[3] = ("s", 3, 104.0, 110.5, 99.9, 104.0)
    r = run(spark, bars, [("s", 1, 1)], [(0, 10.0, 3.0, False, True, 0, 0, 0)]).first()
    assert (r.exit_bar, r.exit_reason, r.exit_price) == (2, 1, 100.0) or (r.exit_bar, r.exit_price) == (3, 100.0)


def test_last_bar_signal_and_end_of_data(spark):
    got = run(spark, FLAT, [("s", 7, 1), ("s", 4, -1)], [PLAIN]).collect()
    assert [(r.signal_bar, r.exit_bar, r.exit_reason, r.exit_price) for r in got] == [(4, 7, 4, 100.0)]


@pytest.mark.parametrize("cool,second,kept", [(0, 4, False), (0, 5, True), (1, 5, True), (3, 6, False), (3, 7, True)])
def test_reentry_and_cooldown(spark, cool, second, kept):
    """The first trade exits on bar 4 by its hold limit."""
    bars = [("s", i, 100.0, 100.5, 99.5, 100.0) for i in range(12)]
    got = run(spark, bars, [("s", 1, 1), ("s", second, 1)], [(0, 10.0, 1.0, False, False, 3, 0, cool)]).collect()
    assert {r.signal_bar for r in got} == ({1, second} if kept else {1})
    assert next(r.exit_bar for r in got if r.signal_bar == 1) == 4


def test_trades_never_overlap(spark):
    from tradeloom.plans.trade_queries import swept

    t = swept(spark, "/root/testdata/sf0.001").toPandas()
    assert len(t) and (t.exit_bar >= t.entry_bar).all() and (t.mae_pts <= 0).all() and (t.mfe_pts >= 0).all()
    for _, g in t.sort_values("signal_bar").groupby(["combo_id", "symbol"]):
        assert (g.signal_bar.to_numpy()[1:] >= g.free_at.to_numpy()[:-1]).all()


def test_compounding_stops_at_ruin(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -30.0), (2, 5.0)], "seq bigint, r double").withColumn("k", F.lit(1))
    out = X.compounded_equity(df, ["k"], ["seq"], [F.col("seq")], F.col("r"), 0.05, 100.0).orderBy("seq").collect()
    assert [round(r.equity, 6) for r in out] == [105.0, 0.0, 0.0] and [round(r.trade_pnl, 6) for r in out] == [5.0, -105.0, 0.0]


def test_reprice_prefers_target(spark):
    df = spark.createDataFrame([(10.0, -9.0, 0.2), (4.0, -5.0, 0.2), (4.0, -1.0, 0.2)], "mfe double, mae double, r double")
    got = df.select(X.reprice(F.lit(2.0), F.col("mfe"), F.col("mae"), F.lit(5.0), F.col("r")).alias("x")).collect()
    assert [r.x for r in got] == [2.0, -1.0, 0.2]
