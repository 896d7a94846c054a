"""The tiled correlation matrix against a dense one."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import ledger as L

DAY = dt.date(2024, 1, 1)


def dense(spark, members, days, seed=1):
    """A table with gaps, several rows a day and a member without spread, and its matrix of daily sums."""
    rng = np.random.default_rng(seed)
    grid = np.where(rng.random((members, days)) < 0.6, np.round(rng.normal(size=(members, days)), 2), 0.0)
    grid[0] = 0.0
    rows = []
    for m, d in zip(*np.nonzero(grid)):
        rows += [(int(m), DAY + dt.timedelta(int(d)), float(grid[m, d]) - 1.0), (int(m), DAY + dt.timedelta(int(d)), 1.0)]
    rows += [(0, DAY + dt.timedelta(d), 0.0) for d in range(days)]
    return spark.createDataFrame(rows, "m long, d date, p double"), grid


@pytest.mark.parametrize("tile,stretch", [(256, 4096), (7, 5), (1, 3)])
def test_matches_dense(spark, tile, stretch):
    df, grid = dense(spark, 23, 30)
    got = L.correlation_matrix(df.repartition(5), "m", "d", "p", tile, stretch).collect()
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.corrcoef(grid))
    assert len(got) == 23 * 23 and {r.n_days for r in got} == {30}
    found = np.full((23, 23), np.nan)
    for r in got:
        found[r.member_a, r.member_b] = r.corr
    assert np.allclose(found, want, atol=1e-9)


def test_many_members(spark):
    """A pool larger than any one task or the driver would take."""
    n, days = 5000, 12
    cell = F.sin(F.col("m") * 7.3 + F.col("k") * F.col("k") * 1.7)
    df = spark.range(n * days).select((F.col("id") % n).alias("m"), F.floor(F.col("id") / n).alias("k"))
    df = df.select("m", F.date_add(F.lit(DAY), F.col("k").cast("int")).alias("d"), cell.alias("p"))
    out = L.correlation_matrix(df, "m", "d", "p")
    facts = out.agg(F.count("*"), F.sum("corr"), F.sum(F.col("corr") * (F.col("member_a") - F.col("member_b")))).first()
    m, k = np.arange(n)[:, None], np.arange(days)[None, :]
    z = np.sin(m * 7.3 + k * k * 1.7)
    z = z - z.mean(axis=1, keepdims=True)
    z /= np.sqrt((z**2).sum(axis=1, keepdims=True))
    assert facts[0] == n * n and np.isclose(facts[1], (z.sum(axis=0) ** 2).sum(), rtol=1e-6) and abs(facts[2]) < 1e-3


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, DAY, 1.0), (1, None, 1.0), (1, DAY, None), (2, DAY, 3.0), (2, DAY + dt.timedelta(1), 1.0)], "m long, d date, p double")
    got = {(r.member_a, r.member_b): (r.corr, r.n_days) for r in L.correlation_matrix(df, "m", "d", "p").collect()}
    assert got == {(1, 1): (0.0, 2), (1, 2): (0.0, 2), (2, 1): (0.0, 2), (2, 2): (pytest.approx(1.0), 2)}
    assert L.correlation_matrix(df.where(F.lit(False)), "m", "d", "p").count() == 0
