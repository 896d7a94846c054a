"""Blocked computations against plain single-partition ones, with a hot key and any block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeloom.operators import indicators as N
from tradeloom.operators import ordered as O
from tradeloom.operators.metrics import losing_streak, max_drawdown


@pytest.fixture(scope="module")
def series():
    """One key holds most rows; values repeat."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 900), ("b", 37), ("one", 1)):
        x = np.round(rng.normal(0, 3, n), 1)
        rows += [(key, i, float(v), int(v > 0)) for i, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["k", "pos", "x", "win"])


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series).repartition(5, "x")


def block(size):
    return [F.floor(F.col("pos") / size)]


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_running_matches_plain_window(frame, size):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("k").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    want = frame.select("k", "pos", F.round(F.sum("x").over(w), 6).alias("s"), F.max("x").over(w).alias("m"), F.max("x").over(before).alias("e"), F.min("x").over(after).alias("r")).collect()
    got = O.running(frame, ["k"], ["pos"], block(size), sums={"s": F.col("x")}, maxes={"m": F.col("x")})
    got = O.running(got, ["k"], ["pos"], block(size), maxes={"e": F.col("x")}, exclusive=True)
    got = O.running(got, ["k"], ["pos"], block(size), mins={"r": F.col("x")}, reverse=True)
    assert sorted(map(str, got.select("k", "pos", F.round("s", 6).alias("s"), "m", "e", "r").collect())) == sorted(map(str, want))


@pytest.mark.parametrize("size", [5, 16, 4096])
def test_rolling_matches_plain_window(frame, size):
    def build(f, w):
        return f.withColumn("z", F.round(N.zscore(F.col("x"), w, 5), 6)).withColumn("nx", F.lead("x", 3).over(w))

    got = O.rolling(frame, ["k"], "pos", build, back=4, ahead=3, size=size).select("k", "pos", "z", "nx")
    want = build(frame, Window.partitionBy("k").orderBy("pos")).select("k", "pos", "z", "nx")
    assert got.count() == frame.count() and got.exceptAll(want).isEmpty()


def test_position_counts_ties_once(frame):
    got = O.with_position(frame, ["k"], ["x", "pos"], [F.floor("x")], "p", "n").toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g.p) == list(range(len(g))) and (g.n == len(g)).all()
        assert g.sort_values("p").x.is_monotonic_increasing


@pytest.mark.parametrize("splits", [1, 2, 32])
def test_quantiles_are_exact(frame, series, splits):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    got = O.quantiles(frame, ["k"], "x", probs, splits=splits).toPandas().set_index("k")
    for k, g in series.groupby("k"):
        assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(g.x, list(probs.values())))
    whole = O.quantiles(frame, [], "x", probs, splits=splits).toPandas()
    assert np.allclose(whole[list(probs)].to_numpy()[0], np.quantile(series.x, list(probs.values())))


def test_average_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, None), (5, None)], "i int, v double")
    got = {r.i: r.r for r in O.average_rank(df, [], "v", "r", nulls_last=True).collect()}
    assert got == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.5, 5: 4.5}


@pytest.mark.parametrize("size", [3, 50, 5000])
def test_drawdown_and_streak(frame, series, size):
    got = max_drawdown(frame, ["k"], ["pos"], block(size), "x", 100.0).join(losing_streak(frame, ["k"], ["pos"], block(size)), "k").toPandas().set_index("k")
    for k, g in series.groupby("k"):
        equity = np.concatenate([[100.0], 100.0 + g.x.cumsum()])
        peak = np.maximum.accumulate(equity)
        assert np.isclose(got.loc[k, "max_drawdown_dollars"], (peak - equity).max())
        assert np.isclose(got.loc[k, "max_drawdown_pct"], ((peak - equity) / peak).max() * 100)
        best = run = 0
        for w in g.win:
            run = 0 if w else run + 1
            best = max(best, run)
        assert got.loc[k, "max_consecutive_losses"] == best


@pytest.mark.parametrize("span", [1, 2, 9, 200])
def test_ema_matches_recursion(spark, series, span):
    df = spark.createDataFrame(series.rename(columns={"k": "symbol", "pos": "bar_idx", "x": "close"}))
    got = N.emas(df, "close", {"e": span, "f": 21}).toPandas().sort_values(["symbol", "bar_idx"])
    assert set(df.columns) <= set(got.columns)
    for _, g in got.groupby("symbol"):
        for name, n in (("e", span), ("f", 21)):
            a, y, want = 2.0 / (n + 1), None, []
            for v in g.close:
                y = v if y is None else a * v + (1 - a) * y
                want.append(y)
            assert np.allclose(g[name], want, atol=1e-9)
