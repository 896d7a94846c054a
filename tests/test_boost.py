"""Boosted trees on counted levels against Spark ML's on the expanded rows, fold by fold."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tradeloom.operators import boost as BO
from tradeloom.operators import calibrate as C
from tradeloom.operators import learn as ML

RATIOS, FOLDS = [1.0, 1.5, 2.0, 3.0], 3


def trades(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    z, v, stop = rng.integers(0, 11, n) / 10.0, rng.integers(0, 9, n) / 4.0, rng.integers(1, 8, n).astype(float)
    best = stop * (0.5 + 2 * rng.random(n) * (0.5 + z))
    return spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 12, "z": z, "v": v, "stop": stop, "best": best}))


def test_counted_levels_give_the_trees_of_spark_ml(spark):
    t = trades(spark, 700)
    folds_of = t.select("g").distinct().withColumn("fold", (F.col("g") % FOLDS).cast("int"))
    reach = lambda rr: F.col("best") >= rr * F.col("stop")
    got = BO.out_of_fold_levels(t, folds_of, "g", ["z", "v", "stop"], "rr", RATIOS, reach, "y", FOLDS, rounds=4).cache()
    rows = t.join(folds_of, "g").withColumn("rr", F.explode(F.array(*[F.lit(x) for x in RATIOS]))).withColumn("y", reach(F.col("rr")).cast("double"))
    want = ML.out_of_fold_probabilities(rows, ["rr", "z", "v", "stop"], "y", "fold", FOLDS, rounds=4).cache()
    key = lambda df, n: sorted(map(tuple, df.groupBy("rr", "y", F.round("pwin_model", 9).alias("p")).agg(n.cast("long")).collect()))
    assert key(got, F.sum("k")) == key(want, F.count(F.lit(1)))
    a, b = ([[round(x, 9) for x in r] for r in m.orderBy("rr").collect()] for m in (C.classification_metrics(got, ["rr"], "pwin_model", "y", 1, "k"), C.classification_metrics(want, ["rr"], "pwin_model", "y", 1)))
    assert a == b and len(a) == len(RATIOS)


def test_unknown_labels_are_scored_but_not_learned(spark):
    t = trades(spark, 300).withColumn("best", F.when(F.col("v") < 2, F.col("best"))).withColumn("z", F.when(F.col("z") > 0.1, F.col("z")))
    folds_of = t.select("g").distinct().withColumn("fold", (F.col("g") % FOLDS).cast("int"))
    reach = lambda rr: F.col("best") >= rr * F.col("stop")
    fit = lambda df: BO.out_of_fold_levels(df, folds_of, "g", ["z", "stop"], "rr", RATIOS, reach, "y", FOLDS, rounds=2)
    every, known = fit(t), fit(t.filter("best is not null"))
    assert every.agg(F.sum("k")).first()[0] == 300 * len(RATIOS)
    assert sorted(map(tuple, every.filter("y is not null").collect())) == sorted(map(tuple, known.collect()))


def test_bins_end_at_quantiles_beyond_their_number(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(1000)], "a double, b double")
    edges = BO.bin_edges(df, ["a", "b"])
    assert len(edges["a"]) == BO.BINS - 1 and edges["b"] == [0.0, 1.0]
    sizes = np.diff([-1, *edges["a"], 999])
    assert sizes.max() - sizes.min() <= 1
