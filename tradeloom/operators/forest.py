"""Quantile predictions from a Spark ML forest, and the search for parameters that score well.

A forest's leaves keep the targets of the training rows that fall into them as counts per distinct value. A row's
conditional distribution averages the leaves it falls into, each tree with equal weight; its quantiles are read off the
cumulated weights, first over ranges of the target, then inside one range, so that no row meets the contents of its leaves
one by one. Neither training targets nor rows pass through the driver; the trees and their leaves' weights per range do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.maths import hash_uniform
from tradeloom.operators.ordered import place_in, union_all
from tradeloom.session import materialise

TREES, DEPTH, LEAST = 40, 10, 5
RANGES, CHUNK = 64, 256  # ranges of the target, and rows handled at once
SLACK = 1e-9  # weights add up to 1 but for rounding


def fit_forest(df: DataFrame, features: list[str], target: str, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, seed: int = 42) -> PipelineModel:
    """A regression forest whose leaves hold at least ``least`` rows; unknown features are a value of their own."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", leafCol="_leaves", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    return Pipeline(stages=[assemble, forest]).fit(df.filter(F.col(target).isNotNull()))


def leaves(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, _tree, _leaf): the leaf of every row in every tree."""
    placed = model.transform(df).select(*keep, F.posexplode(vector_to_array("_leaves")).alias("_tree", "_leaf"))
    return placed.withColumn("_leaf", F.col("_leaf").cast("int"))


def leaf_counts(model: PipelineModel, train: DataFrame, target: str) -> DataFrame:
    """(_tree, _leaf, _y, _n): training rows of every distinct target in a leaf."""
    rows = leaves(model, train.filter(F.col(target).isNotNull()), [F.col(target).cast("double").alias("_y")])
    return rows.groupBy("_tree", "_leaf", "_y").agg(F.count(F.lit(1)).cast("int").alias("_n"))


def _ranges(batches: Iterator[pa.RecordBatch], sums: np.ndarray, width: int, probs: list[float]) -> Iterator[pa.RecordBatch]:
    """The range of every quantile of every row, the weight below it and the row's leaves."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            found = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            codes = found + np.arange(found.shape[1]) * width
            upto = sums[codes].sum(axis=1)
            packed = pa.array([c.astype(np.int32).tobytes() for c in codes], pa.binary())
            for k, q in enumerate(probs):
                reached = upto >= q - SLACK
                place = np.where(reached.any(axis=1), reached.argmax(axis=1), reached.shape[1] - 1)
                below = np.where(place > 0, upto[np.arange(len(place)), place - 1], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(place), k), pa.int32()), pa.array(place, pa.int32()), pa.array(below), packed], names=["_id", "_q", "_bin", "_base", "_codes"]
                )


def _inside(asked: pa.Table, held: pa.Table, sizes: np.ndarray, width: int, probs: list[float]) -> pa.Table:
    """The quantiles that lie in one range: the values of its leaves are searched by halves, for many rows at once."""
    values, place = np.unique(held["_y"].to_numpy(), return_inverse=True)
    at = (held["_tree"].to_numpy().astype(np.int64) * width + held["_leaf"].to_numpy()) * len(values) + place
    order = np.argsort(at, kind="stable")
    at, cum = at[order], np.concatenate(([0], np.cumsum(held["_n"].to_numpy()[order], dtype=np.int64)))
    answers = []
    for start in range(0, asked.num_rows, CHUNK):
        part = asked.slice(start, CHUNK)
        codes = np.frombuffer(b"".join(part["_codes"].to_pylist()), np.int32).reshape(part.num_rows, -1).astype(np.int64)
        share, first = sizes[codes], cum[np.searchsorted(at, codes * len(values))]
        need = np.array(probs)[part["_q"].to_numpy()] - SLACK - part["_base"].to_numpy()
        low, high = np.zeros(len(need), np.int64), np.full(len(need), len(values))  # the answer's place; the end if none reaches it
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(values) - 1)
            weight = ((cum[np.searchsorted(at, codes * len(values) + mid[:, None], side="right")] - first) * share).sum(axis=1)
            open_ = low < high
            low, high = np.where(open_ & (weight < need), mid + 1, low), np.where(open_ & (weight >= need), mid, high)
        answers.append(pa.array(np.append(values, 0.0)[low], pa.float64(), mask=low == len(values)))
    return pa.table({"_id": asked["_id"], "_q": asked["_q"], "_y": pa.chunked_array(answers, pa.float64())})


def predicted_quantiles(model: PipelineModel, train: DataFrame, rows: DataFrame, row_id: str, target: str, probs: dict[str, float]) -> DataFrame:
    """(row_id, one column per probability): the smallest target whose cumulated weight reaches the probability.

    The targets are cut into ``RANGES``. The weight of every leaf in every range, a table whose size the trees bound, tells
    the range of each answer; one unit of work then holds the leaf contents of one range, never those of a row's leaves.
    """
    names, marks = list(probs), list(probs.values())
    counts = materialise(leaf_counts(model, train, target), "leaf-counts")
    edges = counts.agg(F.percentile_approx("_y", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    counts = counts.withColumn("_bin", place_in(F.lit(sorted(set(edges))).cast("array<double>"), F.col("_y"), RANGES))
    book = counts.groupBy("_tree", "_leaf", "_bin").agg(F.sum("_n").alias("_n")).toArrow()  # trees x leaves x RANGES at most
    trees, width = model.stages[-1].getNumTrees, max(t.numNodes // 2 + 1 for t in model.stages[-1].trees)
    table = np.zeros((trees * width, RANGES))
    table[book["_tree"].to_numpy().astype(np.int64) * width + book["_leaf"].to_numpy(), book["_bin"].to_numpy()] = book["_n"].to_numpy()
    sizes = table.sum(axis=1)
    sizes = np.divide(1.0 / trees, sizes, out=np.zeros_like(sizes), where=sizes > 0)
    shared = rows.sparkSession.sparkContext.broadcast((table.cumsum(axis=1) * sizes[:, None], sizes))
    kind = rows.schema[row_id].dataType.simpleString()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranges(batches, shared.value[0], width, marks)

    def inside(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _inside(asked, held, shared.value[1], width, marks)

    placed = model.transform(rows).select(F.col(row_id).alias("_id"), vector_to_array("_leaves").alias("_at"))
    asked = placed.mapInArrow(ranges, f"_id {kind}, _q int, _bin int, _base double, _codes binary")
    found = asked.groupBy("_bin").cogroup(counts.groupBy("_bin")).applyInArrow(inside, f"_id {kind}, _q int, _y double")
    return found.groupBy(F.col("_id").alias(row_id)).agg(*[F.max(F.when(F.col("_q") == k, F.col("_y"))).alias(name) for k, name in enumerate(names)])


def by_fold(folds: int, work: Callable[[int], DataFrame]) -> DataFrame:
    """``work(fold)`` for every fold, the fits side by side, stacked."""
    with ThreadPool(folds) as pool:
        return union_all(pool.map(work, range(folds)))


def out_of_fold_quantiles(df: DataFrame, features: list[str], row_id: str, target: str, fold: str, folds: int, probs: dict[str, float], **forest) -> DataFrame:
    """(row_id, target, pred, quantiles) of every row by a forest that has not seen the row's fold."""

    def work(f: int) -> DataFrame:
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        model = fit_forest(train, features, target, **forest)
        mean = model.transform(test).select(row_id, target, "pred")
        return mean.join(predicted_quantiles(model, train, test, row_id, target, probs), row_id)

    return by_fold(folds, work)


def quantile_losses(df: DataFrame, truth: str, probs: dict[str, float]) -> DataFrame:
    """Per predicted quantile: its pinball loss, that of the best constant, and the share of rows at or below it."""

    def pinball(guess: Column, q: float) -> Column:
        e = F.col(truth) - guess
        return F.avg(F.greatest(e * q, e * (q - 1.0)))

    from tradeloom.operators.ordered import quantiles

    flat = quantiles(df, [], truth, {f"_{name}": q for name, q in probs.items()})
    rows = df.withColumns({c: flat.select(c).scalar() for c in flat.columns})
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[x.alias(f"{tag}_{name}") for name, q in probs.items() for tag, x in (("loss", pinball(F.col(name), q)), ("flat", pinball(F.col(f"_{name}"), q)), ("below", F.avg((F.col(truth) <= F.col(name)).cast("int"))))],
    )
    long = [F.struct(F.lit(name).alias("quantile"), F.lit(q).alias("tau"), *[F.col(f"{tag}_{name}").alias(to) for tag, to in (("loss", "pinball"), ("flat", "pinball_constant"), ("below", "share_below"))]) for name, q in probs.items()]
    return facts.select("n", F.inline(F.array(*long)))


# ---------------------------------------------------------------- search


def drawn_candidates(draws: DataFrame, tried: DataFrame, columns: list[str], draw_id: str, seed: int) -> DataFrame:
    """A candidate per draw: numbers uniform between the tried minimum and maximum, texts one of the tried values.

    Distinct texts are parameters' names of choices, at most 1,000 each; a column with more raises.
    """
    texts = [c for c in columns if dict(tried.dtypes)[c] == "string"]
    numbers = [c for c in columns if c not in texts]
    facts = [f(c).alias(f"{t}_{c}") for c in numbers for t, f in (("lo", F.min), ("hi", F.max))]
    ends = tried.agg(F.lit(1).alias("_"), *facts).first().asDict()
    out = draws
    for c in numbers:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        out = out.withColumn(c, F.lit(lo).cast("double") + hash_uniform(seed, F.col(draw_id), c) * F.lit(hi - lo if lo is not None else None).cast("double"))
    for c in texts:
        seen = [r[0] for r in tried.filter(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(1001).collect()]
        if len(seen) > 1000:
            raise ValueError(f"{c} has over 1,000 choices")
        pick = F.floor(hash_uniform(seed, F.col(draw_id), c) * len(seen)).cast("int")
        out = out.withColumn(c, F.get(F.array(*map(F.lit, seen)), pick) if seen else F.lit(None).cast("string"))
    return out


def cell_key(tried: DataFrame, columns: list[str], cells: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``_cell``: the grid cell of a parameter set, ``cells`` steps between a column's tried minimum and maximum."""
    numbers = [c for c in columns if dict(tried.dtypes)[c] != "string"]
    ends = tried.agg(F.lit(1).alias("_"), *[f(c).alias(f"{t}_{c}") for c in numbers for t, f in (("lo", F.min), ("hi", F.max))]).first().asDict()

    def add(df: DataFrame) -> DataFrame:
        parts = []
        for c in columns:
            if c in numbers:
                lo, span = ends[f"lo_{c}"], (ends[f"hi_{c}"] or 0) - (ends[f"lo_{c}"] or 0)
                parts.append(F.least(F.floor((F.col(c) - lo) / span * cells), F.lit(cells - 1)).cast("string") if span else F.lit("0"))
            else:
                parts.append(F.coalesce(F.col(c), F.lit("")))
        return df.withColumn("_cell", F.concat_ws("|", *[F.coalesce(p, F.lit("?")) for p in parts]))

    return add


def search(model: PipelineModel, tried: DataFrame, draws: DataFrame, columns: list[str], draw_id: str, seed: int, top: int = 50, cells: int = 16) -> DataFrame:
    """The ``top`` drawn candidates by predicted target outside the cells already tried, with the distance to the nearest tried set.

    Distances are over the numeric columns, each in units of its tried deviation. Ties go to the smaller draw.
    """
    key = cell_key(tried, columns, cells)
    known = key(tried).select("_cell").distinct()
    fresh = key(drawn_candidates(draws, tried, columns, draw_id, seed)).join(known, "_cell", "left_anti")
    scored = model.transform(fresh).select(draw_id, *columns, "pred")
    best = materialise(scored.orderBy(F.desc("pred"), draw_id).limit(top), "best")  # a bounded top, no sort of all candidates
    numbers = [c for c in columns if dict(tried.dtypes)[c] != "string"]
    scale = tried.agg(F.lit(1).alias("_"), *[F.stddev_pop(c).alias(c) for c in numbers]).first().asDict()
    book = best.agg(F.array_sort(F.collect_list(F.struct(draw_id, *numbers)))).scalar()  # ``top`` entries
    gap = lambda c: sum([F.pow((c[n] - F.col(n)) / F.lit(scale[n] or 1.0), F.lit(2.0)) for n in numbers], F.lit(0.0))
    near = tried.dropna(subset=numbers).withColumn("_book", book).select(F.transform("_book", gap).alias("_d"))
    least = near.agg(F.array(*[F.min(F.get("_d", F.lit(k))) for k in range(top)]).alias("_least")).scalar()
    place = F.row_number().over(Window.orderBy(draw_id)) - 1  # of the ``top`` rows
    rank = F.row_number().over(Window.orderBy(F.desc("pred"), draw_id))
    out = best.withColumns({"_at": place, "rank": rank}).withColumn("_least", least)
    return out.withColumn("nearest_tried", F.sqrt(F.get("_least", F.col("_at")))).drop("_at", "_least")
