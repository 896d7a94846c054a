"""Rolling ranks against a look at every window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators.rolling_rank import counts_in_windows, rolling_rank


@pytest.mark.parametrize("n", [1, 2, 7, 64, 500])
def test_counts(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=300), rng.integers(0, 6, 300).astype(float), np.zeros(50), np.arange(40.0), np.zeros(0)):
        below, equal = counts_in_windows(x, n)
        for i in range(len(x)):
            w = x[max(0, i - n + 1) : i + 1]
            assert below[i] == (w < x[i]).sum() and equal[i] == (w == x[i]).sum()


@pytest.mark.parametrize("size", [4096, 50, 1])
def test_blocks(spark, size):
    rng = np.random.default_rng(1)
    rows = [(k, i, None if rng.random() < 0.02 else float(v), "x") for k, m in (("hot", 400), ("b", 33), ("c", 1)) for i, v in enumerate(rng.integers(0, 40, m))]
    df = spark.createDataFrame(rows, "k string, pos bigint, v double, _other string").repartition(5)
    got = {(r.k, r.pos): r.rank for r in rolling_rank(df, ["k"], "pos", "v", 30, "rank", size).collect()}
    assert len(got) == len(rows)
    value = {(k, i): v for k, i, v, _ in rows}
    for (k, i), rank in got.items():
        w = [value.get((k, j)) for j in range(i - 29, i + 1)]
        want = None if None in w else sum(v < w[-1] for v in w) + (sum(v == w[-1] for v in w) + 1) / 2
        assert rank == want
    assert rolling_rank(df.where(F.lit(False)), ["k"], "pos", "v", 30, "rank").count() == 0


def test_long_window_in_linear_steps():
    x = np.random.default_rng(2).normal(size=200_000)
    below, equal = counts_in_windows(x, 50_000)  # 10^10 comparisons one by one
    assert equal.sum() == len(x) and below[-1] == (x[-50_000:] < x[-1]).sum()
