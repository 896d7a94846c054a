"""Several quantiles at once: against numpy, for a heavy key and unknown values, with rows expanded and counted once only."""

import numpy as np
from pyspark.sql import functions as F

from tradeloom.operators.ordered import many_quantiles

def wanted():
    return {"mid_a": (F.col("a"), 0.5), "p90_b": (F.col("b"), 0.9), "mid_b": (F.abs(F.col("b")), 0.5)}


def rows(spark):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(900) < 0.6, 0, rng.integers(1, 9, 900))
    data = [(int(k), None if x < 0.1 else round(float(x), 2), None if k == 8 else float(y)) for k, x, y in zip(keys, rng.random(900), rng.normal(size=900))]
    return spark.createDataFrame(data, "k int, a double, b double"), data


def test_against_numpy(spark):
    df, data = rows(spark)
    got = {r.k: (r.mid_a, r.p90_b, r.mid_b) for r in many_quantiles(df, ["k"], wanted()).collect()}
    assert set(got) == {d[0] for d in data}
    for k, found in got.items():
        a, b = (np.array([d[i] for d in data if d[0] == k and d[i] is not None]) for i in (1, 2))
        want = [np.quantile(x, q) if len(x) else None for x, q in ((a, 0.5), (b, 0.9), (np.abs(b), 0.5))]
        assert all(f == w or abs(f - w) < 1e-12 for f, w in zip(found, want))
    whole = many_quantiles(df, [], {"m": (F.col("a"), 0.5)}).first().m
    assert abs(whole - np.median([d[1] for d in data if d[1] is not None])) < 1e-12


def test_rows_are_expanded_once(spark):
    plan = many_quantiles(rows(spark)[0], ["k"], wanted())._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # what is left reads the counts
