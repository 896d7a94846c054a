"""Statistics from counted rows, ranks inside equal probabilities and streams handed on in stretches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import compare
from tradeloom.operators import calibrate as C
from tradeloom.plans import ORACLE, QUERIES
from tradeloom.plans import calibrate_queries as Q
from tradeloom.plans.inputs import trades
from tradeloom.streaming import bars as ST

SMALL = f"{compare.ROOT}/sf0.001"


def test_levels_are_counted_without_a_row_for_each(spark):
    cells = Q.level_cells(trades(spark, SMALL), Q.BY)
    t = trades(spark, SMALL).withColumn("rr", F.explode(F.array(*[F.lit(x) for x in Q.FE.RR_LEVELS])))
    won = (F.col("mfe_pts") >= F.col("rr") * F.col("stop_pts") / 5.0).cast("int")
    want = t.groupBy("combo_id", "rr", F.col("pwin").alias("p")).agg(F.count("*").alias("rows"), F.count(won).alias("n"), F.sum(won).alias("s"))
    got = cells.select(want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("bins", [3, 7])
def test_chunks_of_one_probability_are_ranked_in_blocks_of_the_tie(spark, bins):
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"k": "a", "p": np.where(np.arange(400) < 300, 0.5, rng.random(400)), "t": rng.permutation(400), "y": rng.integers(0, 2, 400)})
    got = C.ece_by_chunks(spark.createDataFrame(df).repartition(4), ["k"], "p", "y", ["t"], [F.floor(F.col("t") / 50)], bins).first()
    parts = np.array_split(df.sort_values(["p", "t"])[["p", "y"]].to_numpy(), bins)
    gaps = [abs(x[:, 0].mean() - x[:, 1].mean()) for x in parts]
    assert got.ece == pytest.approx(sum(g * len(x) for g, x in zip(gaps, parts)) / 400) and got.mce == pytest.approx(max(gaps)) and got.n == 400


def test_mean_is_handed_on_in_stretches(monkeypatch):
    class Held:
        def __init__(self):
            self.row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    monkeypatch.setattr(ST, "STRETCH", 10)
    mean = ST._Mean(3)
    mean.mean = Held()
    time = pd.date_range("2024-01-01", periods=35, freq="s")
    ticks = pd.DataFrame({"symbol": "a", "time": time, "tick_id": range(35), "value": np.arange(35.0)}).sample(frac=1, random_state=1)
    out = list(mean.handleInputRows(("a",), iter([ticks[:20], ticks[20:]]), None))
    assert [len(o) for o in out] == [10, 10, 10, 5]
    whole, want = pd.concat(out), ticks.sort_values("time").value.ewm(span=3, adjust=False).mean()
    assert whole.tick_id.tolist() == list(range(35)) and np.allclose(whole.ema, want) and mean.mean.get()[0] == whole.ema.iloc[-1]


@pytest.mark.parametrize("name", ["C11_rolling_recalibration", "C21_own_or_pooled"])
def test_few_probabilities_take_no_row_per_level(spark, monkeypatch, name):
    """Neither trades times ratios nor changes per row are written or sent."""
    def refuse(*args, **kwargs):
        raise AssertionError("a row per level")

    for place, what in ((Q, "leveled"), (Q, "global_levels"), (Q.RC, "recalibrate")):
        monkeypatch.setattr(place, what, refuse)
    monkeypatch.setattr(Q, "POOLED_RANGE", 1)
    assert compare.compare(spark, compare.duck(SMALL), name, QUERIES[name], ORACLE[name], SMALL) == ""
