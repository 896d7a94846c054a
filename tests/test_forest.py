"""Quantile forests against weights worked out from the trees, and the search against a scan of its candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import forest as FR

PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def rows(spark, n, seed=1):
    """Targets whose middle and spread both follow x; a second column is noise."""
    rng = np.random.default_rng(seed)
    x, z = rng.random(n), rng.random(n)
    y = np.round(4 * x + (0.2 + x) * rng.normal(size=n), 2)
    data = [(i, float(a), float(b), float(t), i % 5) for i, (a, b, t) in enumerate(zip(x, z, y))]
    return spark.createDataFrame(data, "id long, x double, z double, y double, fold int").cache()


def test_quantiles_match_leaf_weights(spark):
    train, asked = rows(spark, 150), rows(spark, 40, 2)
    model = FR.fit_forest(train, ["x", "z"], "y", trees=7, depth=4)
    got = {r.id: (r.p10, r.p50, r.p90) for r in FR.predicted_quantiles(model, train, asked, "id", "y", PROBS).collect()}
    place = lambda df: {r.id: r._leaves.toArray() for r in model.transform(df).select("id", "_leaves").collect()}
    leaf, ask, y = place(train), place(asked), {r.id: r.y for r in train.collect()}
    assert len(got) == 40
    for i, mine in ask.items():
        weight = {}
        for t in range(7):
            inside = [k for k, v in leaf.items() if v[t] == mine[t]]
            for k in inside:
                weight[y[k]] = weight.get(y[k], 0.0) + 1 / len(inside) / 7
        values = sorted(weight)
        upto = np.cumsum([weight[v] for v in values])
        assert got[i] == tuple(values[int(np.argmax(upto >= q - 1e-9))] for q in PROBS.values())


def test_better_than_constants_and_covered(spark):
    df = rows(spark, 2500)
    out = FR.out_of_fold_quantiles(df, ["x", "z"], "id", "y", "fold", 5, PROBS, trees=20, depth=8, least=15)
    assert out.count() == 2500 and out.filter("p10 > p50 OR p50 > p90").count() == 0
    for r in FR.quantile_losses(out, "y", PROBS).collect():
        assert r.n == 2500 and r.pinball < 0.75 * r.pinball_constant and abs(r.share_below - r.tau) < 0.03, r


def test_search(spark):
    tried = rows(spark, 300).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    model = FR.fit_forest(tried, ["x", "z"], "y", trees=5, depth=4)
    draws = spark.range(400).withColumnRenamed("id", "draw")
    got = FR.search(model, tried, draws, ["x", "z", "kind"], "draw", 3, top=10, cells=8).orderBy("rank").collect()
    every = FR.cell_key(tried, ["x", "z", "kind"], 8)(FR.drawn_candidates(draws, tried, ["x", "z", "kind"], "draw", 3))
    known = {r._cell for r in FR.cell_key(tried, ["x", "z", "kind"], 8)(tried).collect()}
    fresh = sorted((-r.pred, r.draw) for r in model.transform(every).collect() if r._cell not in known)
    assert [(-r.pred, r.draw) for r in got] == fresh[:10] and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    t = np.array([(r.x, r.z) for r in tried.collect()])
    sd = t.std(axis=0)
    for r in got:
        assert r.kind in ("even", "odd") and t[:, 0].min() <= r.x <= t[:, 0].max()
        assert r.nearest_tried == pytest.approx(np.sqrt((((t - [r.x, r.z]) / sd) ** 2).sum(axis=1)).min())


def test_large_leaves_are_not_met_row_by_row(spark):
    """Few leaves with thousands of distinct targets each: no join of rows with leaf contents, answers as before."""
    train, asked = rows(spark, 6000).withColumn("y", F.col("y") + F.col("id") * 1e-7), rows(spark, 900, 2)
    model = FR.fit_forest(train, ["x", "z"], "y", trees=3, depth=2)
    out = FR.predicted_quantiles(model, train, asked, "id", "y", PROBS)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.p10, r.p50, r.p90) for r in out.collect()}
    place = lambda df: np.array([r._leaves.toArray() for r in model.transform(df).orderBy("id").select("_leaves").collect()])
    leaf, ask, y = place(train), place(asked), np.array([r.y for r in train.orderBy("id").collect()])
    order = np.argsort(y)
    assert len(got) == 900
    for i in range(0, 900, 9):
        weight = sum((leaf[:, t] == ask[i, t]) / (leaf[:, t] == ask[i, t]).sum() / 3 for t in range(3))
        upto = np.cumsum(weight[order])
        assert got[i] == tuple(y[order][int(np.argmax(upto >= q - 1e-9))] for q in PROBS.values())
