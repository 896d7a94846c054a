"""Boosted trees on trades and all their target ratios, the models of all folds grown side by side.

A trade's rows differ in the ratio and the label alone, so they stay one row: its features as bins, and one bit per ratio for
known and for won labels. Rows alike in fold, bins and bits are one row with a count. A pass over these rows counts, for every
model, open node, feature and bin, the rows and the sum of their residuals; Spark adds up the tasks' sums, and the driver reads
the splits off at most models x nodes x features x ``BINS`` sums. One pass serves one tree level of all models.

The trees are those of Spark ML's ``GBTClassifier``: variance of the residuals of the log loss, first tree on labels of -1 and 1,
later ones at the learning rate, bins between distinct values, or between quantiles where a feature has over ``BINS`` values.
Quantiles are exact and those of all rows; they use no label. Unknown features lie beyond all values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.operators.ordered import value_cdf
from tradeloom.session import materialise

BINS = 32
RATE = 0.1
LEVELS = 62  # most ratios: their labels are bits of a long

Tree = dict[int, tuple]  # node of a heap: (feature, last bin on the left, mean residual), feature -1 in a leaf


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per feature the values after which a bin ends: all but the last, or those that hold a quantile."""
    each = F.array(*[F.struct(F.lit(n).alias("_what"), F.col(n).cast("double").alias("_value")) for n in features])
    long = df.select(F.inline(each)).filter(~F.isnan("_value"))
    cdf = value_cdf(long, ["_what"], "_value").cache()
    sizes = cdf.groupBy("_what").agg(F.count(F.lit(1)).alias("_distinct"))
    part = lambda rows: F.floor(rows * bins / F.col("_total"))
    ends = part(F.col("_below")) < part(F.col("_below") + F.col("_n"))
    last = F.col("_below") + F.col("_n") == F.col("_total")
    edges: dict[str, list[float]] = {n: [] for n in features}
    for r in cdf.join(sizes, "_what").filter(~last & ((F.col("_distinct") <= bins) | ends)).select("_what", "_value").collect():
        edges[r[0]].append(r[1])
    cdf.unpersist()
    return {n: sorted(v) for n, v in edges.items()}


def _binned(batches: Iterator[pa.RecordBatch], edges: list[list[float]], levels: int) -> Iterator[pa.RecordBatch]:
    """Group, known and won labels as bits of a long, and the bin of each feature: the edges below it, unknown values last."""
    bit = 1 << np.arange(levels)
    for batch in batches:
        won = batch.column(1).flatten()
        known = won.is_valid().to_numpy(zero_copy_only=False).reshape(-1, levels)
        hits = won.fill_null(False).to_numpy(zero_copy_only=False).reshape(-1, levels)
        bins = [pa.array(np.searchsorted(e, c.cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int8)) for e, c in zip(edges, batch.columns[2:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known @ bit), pa.array(hits @ bit), *bins], names=["_group", "_known", "_won", *[f"_b{i}" for i in range(len(edges))]])


def _predict(tree: Tree, x: list[np.ndarray], node: int = 0) -> np.ndarray | float:
    """A tree at columns of bins: (rows, 1) for features, (1, ratios) for the ratio."""
    feature, cut, value = tree[node]
    if feature < 0:
        return value
    return np.where(x[feature] > cut, _predict(tree, x, 2 * node + 2), _predict(tree, x, 2 * node + 1))


def _open(tree: Tree, x: list[np.ndarray], depth: int, node: int = 0, at: int = 0, inside: np.ndarray | bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows in it) of the leaves at ``depth``."""
    feature, cut, _ = tree[node]
    if at == depth:
        yield node, inside
    elif feature >= 0:
        right = x[feature] > cut
        yield from _open(tree, x, depth, 2 * node + 1, at + 1, inside & ~right)
        yield from _open(tree, x, depth, 2 * node + 2, at + 1, inside & right)


def _margin(trees: list[Tree], x: list[np.ndarray], rows: int, levels: int) -> np.ndarray:
    out = np.zeros((rows, levels))
    for i, tree in enumerate(trees):
        out += (RATE if i else 1.0) * np.asarray(_predict(tree, x))
    return out


def _read(batch: pa.RecordBatch, levels: int) -> tuple:
    """fold, count, columns of bins with the ratio first, known and won labels as (rows, ratios)."""
    fold, count, known, won, *bins = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    bit = np.arange(levels)
    x = [bit[None, :], *[b[:, None] for b in bins]]
    return fold, count.astype(float), x, (known[:, None] >> bit) & 1 == 1, (won[:, None] >> bit) & 1 == 1


def _histograms(batches: Iterator[pa.RecordBatch], models: list[list[Tree]], depth: int, levels: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows and residuals per (model, node at ``depth``, feature, bin) of a task's rows."""
    first = (1 << depth) - 1
    sums = None
    for batch in batches:
        fold, count, x, known, won = _read(batch, levels)
        if sums is None:
            sums = np.zeros((2, len(models), first + 1, len(x), width))
        for m, trees in enumerate(models):
            mine = np.flatnonzero(fold != m)
            some = [x[0], *[c[mine] for c in x[1:]]]
            y = np.where(won[mine], 1.0, -1.0)
            rows = count[mine, None] * known[mine]
            residual = y
            if len(trees) > 1:
                residual = 4.0 * y / (1.0 + np.exp(2.0 * y * _margin(trees[:-1], some, len(mine), levels)))
            residual = residual * rows
            for node, inside in _open(trees[-1], some, depth):
                for k, part in enumerate((rows * inside, residual * inside)):
                    into = sums[k, m, node - first]
                    into[0, :levels] += part.sum(axis=0)
                    each = part.sum(axis=1)
                    for j, c in enumerate(some[1:], 1):
                        into[j] += np.bincount(c[:, 0], weights=each, minlength=width)
    if sums is not None:
        n, s = sums.reshape(2, -1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], names=["id", "n", "s"])


def _split(n: np.ndarray, s: np.ndarray) -> tuple[int, int, tuple, tuple] | None:
    """(feature, last bin on the left, means of both sides) of the greatest fall in variance; the first of equal ones."""
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
    all_n, all_s = left_n[:, -1:], left_s[:, -1:]
    right_n, right_s = all_n - left_n, all_s - left_s
    both = (left_n > 0) & (right_n > 0)
    one = np.where(both, 1.0, np.nan)
    gain = np.where(both, left_s**2 / (left_n * one) + right_s**2 / (right_n * one) - all_s**2 / np.maximum(all_n, 1.0), 0.0)
    if gain.max() <= 1e-12 * all_n.max():
        return None
    feature, cut = divmod(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), n.shape[1])
    return feature, cut, left_s[feature, cut] / left_n[feature, cut], right_s[feature, cut] / right_n[feature, cut]


def fit_folds(cells: DataFrame, features: int, levels: int, folds: int, rounds: int, depth: int = 3) -> list[list[Tree]]:
    """The trees of every fold's model, fitted on the counted rows of the other folds."""
    width = max(BINS, levels)
    models: list[list[Tree]] = [[] for _ in range(folds)]
    for _ in range(rounds):
        for trees in models:
            trees.append({0: (-1, 0, 0.0)})
        for d in range(depth):
            shape = (folds, 1 << d, 1 + features, width)
            parts = cells.mapInArrow(lambda rows, d=d: _histograms(rows, models, d, levels, width), "id long, n double, s double")
            n, s = np.zeros(int(np.prod(shape))), np.zeros(int(np.prod(shape)))
            for r in parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
                n[r[0]], s[r[0]] = r[1], r[2]
            n, s = n.reshape(shape), s.reshape(shape)
            for m, trees in enumerate(models):
                tree, first = trees[-1], (1 << d) - 1
                if not d and n[m, 0, 0].sum():
                    tree[0] = (-1, 0, float(s[m, 0, 0].sum() / n[m, 0, 0].sum()))
                for node in [k for k in tree if k >= first]:
                    found = _split(n[m, node - first], s[m, node - first])
                    if found:
                        feature, cut, low, high = found
                        tree[node] = (feature, cut, tree[node][2])
                        tree[2 * node + 1], tree[2 * node + 2] = (-1, 0, float(low)), (-1, 0, float(high))
    return models


def _scores(batches: Iterator[pa.RecordBatch], models: list[list[Tree]], ratios: list[float]) -> Iterator[pa.RecordBatch]:
    """Rows alike in ratio, label and probability, counted."""
    levels = len(ratios)
    for batch in batches:
        fold, count, x, known, won = _read(batch, levels)
        for m, trees in enumerate(models):
            mine = np.flatnonzero(fold == m)
            if not len(mine):
                continue
            p = 1.0 / (1.0 + np.exp(-2.0 * _margin(trees, [x[0], *[c[mine] for c in x[1:]]], len(mine), levels)))
            label = np.where(known[mine], won[mine], 2)
            level = np.broadcast_to(np.arange(levels), p.shape)
            values, place = np.unique(p, return_inverse=True)
            sums = np.bincount((place.reshape(p.shape) * 3 + label).ravel() * levels + level.ravel(), weights=np.repeat(count[mine], levels))
            alike = np.flatnonzero(sums)
            y = (alike // levels % 3).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(ratios)[alike % levels]), pa.array(y, mask=y == 2), pa.array(values[alike // levels // 3]), pa.array(sums[alike].astype(np.int64))],
                names=["ratio", "label", "p", "k"],
            )


def out_of_fold_levels(
    df: DataFrame, folds_of: DataFrame, group: str, features: list[str], ratio: str, ratios: list[float], won: Callable[[Column], Column], label: str, folds: int, rounds: int = 10, depth: int = 3
) -> DataFrame:
    """(ratio, label, pwin_model, k): win probabilities of all trades at all ratios by a model that has not seen the trade's fold.

    ``won`` gives a trade's label at a ratio, NULL where unknown: such rows are scored, not learned from. Rows alike in all of it are
    counted in ``k``. The ratio is an input of the model, before ``features``. ``folds_of``: (group, fold) with folds from 0.
    """
    if len(ratios) > LEVELS:
        raise ValueError(f"more than {LEVELS} ratios")
    edges = list(bin_edges(df, features).values())
    labels = F.transform(F.array(*[F.lit(x) for x in ratios]), won)
    names = ["_known", "_won", *[f"_b{i}" for i in range(len(features))]]
    schema = T.StructType([T.StructField("_group", df.schema[group].dataType), *[T.StructField(c, T.LongType() if c in names[:2] else T.ByteType()) for c in names]])
    binned = df.select(group, labels.alias("_labels"), *features).mapInArrow(lambda rows: _binned(rows, edges, len(ratios)), schema)
    rows = binned.join(folds_of.select(F.col(group).alias("_group"), F.col("fold").cast("int").alias("_fold")), "_group")
    cells = materialise(rows.groupBy("_fold", *names).agg(F.count(F.lit(1)).alias("_n")).select("_fold", "_n", *names), "cells")
    models = fit_folds(cells, len(features), len(ratios), folds, rounds, depth)
    found = cells.mapInArrow(lambda rows: _scores(rows, models, ratios), "ratio double, label double, p double, k long")
    return found.groupBy(F.col("ratio").alias(ratio), F.col("label").alias(label), F.col("p").alias("pwin_model")).agg(F.sum("k").alias("k"))
