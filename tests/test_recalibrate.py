"""Recalibration against refits that read their whole history, with parts so small that the tree has several levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import recalibrate as RC


def plain_fit(ps, ys):
    """Row-at-a-time pooling."""
    blocks = []
    for p in sorted(set(ps)):
        y = [b for a, b in zip(ps, ys) if a == p]
        blocks.append([p, p, len(y), sum(y)])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    return [x for b in blocks for x in (b[0], b[1])], [v for b in blocks for v in (b[3] / b[2],) * 2]


def plain(g, min_fit, refit, window):
    p, y, want = g.p.to_numpy(), g.y.to_numpy(), g.p.to_numpy().copy()
    for a in range(min_fit, len(g), refit):
        lo = max(0, a - window) if window else 0
        if len(set(y[lo:a])) == 2:
            want[a : a + refit] = np.interp(p[a : a + refit], *plain_fit(list(p[lo:a]), list(y[lo:a])))
    return want


@pytest.fixture(scope="module")
def scored():
    """One stream with most rows and continuous probabilities, one with ties, one that never loses, one too short."""
    rng = np.random.default_rng(8)
    sizes = {"hot": 700, "b": 200, "won": 150, "short": 40}
    frames = []
    for k, n in sizes.items():
        p = rng.random(n) if k == "hot" else np.round(rng.random(n), 2)
        y = np.ones(n, int) if k == "won" else (rng.random(n) < p**2).astype(int)
        frames.append(pd.DataFrame({"k": k, "seq": np.arange(n), "p": p, "y": y}))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("window", [None, 130, 30])
@pytest.mark.parametrize("unit,fan", [(512, 64), (100, 4), (3, 3)])
def test_matches_plain_refits(spark, scored, window, unit, fan):
    got = RC.recalibrate(spark.createDataFrame(scored).repartition(5), ["k"], "seq", "p", "y", 100, 60, "c", window, unit, fan).toPandas()
    assert len(got) == len(scored)
    for _, g in got.groupby("k"):
        g = g.sort_values("seq")
        assert np.allclose(g.c, plain(g, 100, 60, window))


def test_rows_are_not_handed_on(spark, scored):
    """However many refits follow a row, it becomes at most two changes, and versions stay in proportion."""
    df = spark.createDataFrame(scored[scored.k == "hot"])
    for refit in (100, 10, 2):
        assert RC.changes(df, ["k"], "seq", "p", "y", 100, refit).count() <= 700
        assert RC.changes(df, ["k"], "seq", "p", "y", 100, refit, 300).count() <= 1400


def test_missing_values_and_empty(spark):
    rows = [("a", i, (i % 7) / 7.0 if i % 5 else None, float(i % 3 == 0) if i % 4 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, seq bigint, p double, y double")
    got = RC.recalibrate(df, ["k"], "seq", "p", "y", 30, 10, "c").toPandas().sort_values("seq")
    assert got.c.isna().equals(got.p.isna()) and not np.allclose(got.c.dropna(), got.p.dropna())
    assert RC.recalibrate(df.where(F.lit(False)), ["k"], "seq", "p", "y", 30, 10, "c").count() == 0


def test_pooling_of_parts_is_pooling_of_rows():
    rng = np.random.default_rng(3)
    cells = [(x, x, float(n), float(rng.integers(0, n + 1))) for x, n in zip(np.sort(rng.random(300)), rng.integers(1, 5, 300))]
    for cut in (1, 50, 299):
        assert RC.pooled(RC.pooled(cells[:cut]) + RC.pooled(cells[cut:])) == RC.pooled(cells)


@pytest.mark.parametrize("run", [4, 2048])
def test_counted_stretches(spark, scored, run):
    """Fits side by side from counts give each row what following its stream gives, over several runs and windows."""
    df = spark.createDataFrame(scored.assign(p=scored.p.round(1))).repartition(5)
    cells = df.groupBy("k", F.floor(F.col("seq") / 10).alias("_at"), "p").agg(F.count("*").alias("rows"), F.count("y").alias("n"), F.sum("y").alias("s"))
    plans = {"all": (2, None), "last": (3, 13), "each": (1, 5)}
    got = RC.stretch_values(cells, ["k"], 10, plans, run).toPandas().set_index(["k", "_at", "p"])
    assert len(got) == cells.count() and got.rows.sum() == len(scored)
    for name, (refit, window) in plans.items():
        want = RC.recalibrate(df, ["k"], "seq", "p", "y", 100, 10 * refit, "c", window and 10 * window, between=False).toPandas()
        for r in want.itertuples():
            assert got.loc[(r.k, r.seq // 10, r.p), name] == pytest.approx(r.c, abs=1e-12)


@pytest.mark.parametrize("run", [4, 2048])
@pytest.mark.parametrize("window", [None, 50])
def test_sums_of_counted_stretches(spark, scored, run, window):
    """Sums of two levels, over cells in use only, are those of the rows of recalibrated streams."""
    rows = scored.assign(p=scored.p.round(1).where(scored.seq % 11 > 0), rare=scored.y * (scored.seq % 3 == 0), use=scored.seq >= 120)
    df = spark.createDataFrame(rows).repartition(5).withColumn("p", F.nanvl("p", F.lit(None)))
    counts = [F.count("*").alias("rows"), F.count("y").alias("n"), F.sum("y").alias("s0"), F.sum("rare").alias("s1")]
    cells = df.groupBy("k", F.floor(F.col("seq") / 10).alias("_at"), "p", "use").agg(*counts)
    got = RC.stretch_sums(cells, ["k"], {1.0: "s0", 2.0: "s1"}, 10, 2, window and window // 10, run).groupBy("k", "rr").agg(*[F.sum(c).alias(c) for c in ("rows", "known", "n", "c", "b")]).toPandas().set_index(["k", "rr"])
    for rr, y in ((1.0, "y"), (2.0, "rare")):
        want = RC.recalibrate(df, ["k"], "seq", "p", y, 100, 20, "cal", window, between=False).filter("use").toPandas()
        for k, g in want.groupby("k"):
            have = got.loc[k, rr]
            assert (have["rows"], have.known) == (len(g), g.cal.notna().sum())
            assert have.c == pytest.approx(g.cal.sum()) and have.b == pytest.approx(((g.cal - g[y]) ** 2).sum())
