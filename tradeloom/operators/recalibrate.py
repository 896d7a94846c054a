"""Recalibration in time order: an isotonic fit per stretch of rows, from mergeable pooled blocks.

Refits of one stream share nearly all of their rows, so no row is handed on to the later refits it counts in. A row is one
change: it enters a cell (stream, probability) at the first refit that sees it, and leaves it at the first that no longer
does. The probability range of a stream is cut into parts; a task follows one part through the refits and pools it again
only where cells changed, which gives a new version of the part's blocks. Pooling the blocks of neighbouring parts equals
pooling their rows, so versions are merged up a tree over the parts, ``FAN`` at a time; the top is the fit.

Streams of few distinct probabilities need no tree: rows are counted per stretch and probability, and the refits of a run of
stretches are fitted side by side from cumulative counts (``stretch_values``), so a long stream is spread over its runs.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradeloom.operators.calibrate import interpolate
from tradeloom.operators.ordered import place_in, running
from tradeloom.session import materialise

UNIT = 512  # distinct probabilities of one part
FAN = 64  # parts merged by one node of the tree
PARTS = 65536  # most parts
ROWS = 4096  # versions per batch a task hands on
FEW = 64  # most distinct probabilities of a stream whose refits are fitted side by side
RUN = 2048  # stretches of a run, unless a window reaches further
CELLS = 1 << 16  # cells a task fits together, beyond whole runs

Block = tuple[float, float, float, float]  # lowest and highest probability, weight, weighted sum of outcomes


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Neighbouring blocks whose means do not rise are one block."""
    stack: list[Block] = []
    for lo, hi, n, s in blocks:
        while stack and stack[-1][3] * n >= s * stack[-1][2]:
            last = stack.pop()
            lo, n, s = last[0], n + last[2], s + last[3]
        stack.append((lo, hi, n, s))
    return stack


class _Cells:
    """Cells of one part, changed by differences."""

    def __init__(self):
        self.at, self.cells = [], {}

    def change(self, row: tuple) -> None:
        p, n, s = row
        if p not in self.cells:
            insort(self.at, p)
            self.cells[p] = (0.0, 0.0)
        old = self.cells[p]
        self.cells[p] = (old[0] + n, old[1] + s)
        if not self.cells[p][0]:
            del self.cells[p], self.at[bisect_left(self.at, p)]

    def blocks(self) -> Iterator[Block]:
        return ((p, p, *self.cells[p]) for p in self.at)


class _Parts:
    """Latest versions of neighbouring parts."""

    def __init__(self):
        self.at, self.versions = [], {}

    def change(self, row: tuple) -> None:
        child, *columns = row
        if child not in self.versions:
            insort(self.at, child)
        self.versions[child] = list(zip(*columns))

    def blocks(self) -> Iterator[Block]:
        return (b for child in self.at for b in self.versions[child])


def _follow(batches: Iterator[pa.RecordBatch], state: type, keys: int, top: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Versions of a node after each refit that changed it; at the top, knots of the refits asked for.

    Rows: keys, node, refit, then a change, or NULLs where the refit is asked for. Sorted by keys, node and refit.
    """
    node, refit, held, asked, changed = None, None, state(), False, False
    done: list[tuple] = []

    def close() -> None:
        if top and asked:
            fit = pooled(held.blocks())
            weight, ones = sum(b[2] for b in fit), sum(b[3] for b in fit)
            if 0 < ones < weight:
                ends = [(x, s / n) for lo, hi, n, s in fit for x in ((lo, hi) if hi > lo else (lo,))]
                done.append((*node[:keys], refit, *map(list, zip(*ends))))
        elif changed and not top:
            columns = [list(c) for c in zip(*pooled(held.blocks()))] or [[], [], [], []]
            done.append((*node, refit, *columns))

    def batch_of() -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*done), out)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            now, k, change = row[: keys + 1], row[keys + 1], row[keys + 2 :]
            if now != node or k != refit:
                if node is not None:
                    close()
                if now != node:
                    held = state()
                node, refit, asked, changed = now, k, False, False
            if change[0] is None:
                asked = True
            else:
                held.change(change)
                changed = True
            if len(done) >= ROWS:
                yield batch_of()
    if node is not None:
        close()
    if done:
        yield batch_of()


def _run(rows: DataFrame, keys: list[str], state: type, top: bool) -> DataFrame:
    head = [rows.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    fit = T.StructField("_fit", T.LongType())
    if top:
        schema = T.StructType([*head, fit, T.StructField("x", doubles), T.StructField("v", doubles)])
    else:
        schema = T.StructType([*head, T.StructField("_part", T.LongType()), fit, *[T.StructField(c, doubles) for c in ("lo", "hi", "n", "s")]])
    work = partial(_follow, state=state, keys=len(keys), top=top, out=to_arrow_schema(schema))
    return rows.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "_fit").mapInArrow(work, schema)


def changes(df: DataFrame, keys: list[str], seq: str, p: str, y: str, min_fit: int, refit: int, window: int | None = None) -> DataFrame:
    """(keys, _fit, p, n, s): weight and outcomes that enter or leave a probability at a refit, at most two rows an input row.

    Refit k sees the rows before position min_fit + k * refit: all, or the last ``window`` of them.
    """
    at, one, hit = F.col(seq), F.lit(1.0), F.col(y).cast("double")
    enter = F.greatest(F.lit(0).cast("bigint"), F.floor((at - min_fit) / refit) + 1)
    moves = [F.struct(enter.alias("_fit"), one.alias("n"), hit.alias("s"))]
    rows = df
    if window is not None:
        leave = F.floor((at + (window - min_fit)) / refit) + 1
        moves.append(F.struct(leave.alias("_fit"), (-one).alias("n"), (-hit).alias("s")))
        rows = df.filter(leave > enter)
    rows = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    long = rows.select(*keys, F.col(p).cast("double").alias("p"), F.inline(F.array(*moves)))
    return long.groupBy(*keys, "_fit", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter((F.col("n") != 0) | (F.col("s") != 0))


def fits(moved: DataFrame, asked: DataFrame, keys: list[str], unit: int = UNIT, fan: int = FAN) -> DataFrame:
    """(keys, _fit, x[], v[]): knots of the isotonic fit at every refit in ``asked`` (keys, _fit) that has both classes."""
    cells = moved.select(*keys, "p").distinct()
    most = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    parts = min(PARTS, -(-most // unit))
    asks = asked.select(*keys, F.lit(0).cast("bigint").alias("_part"), "_fit")
    if parts == 1:
        rows = moved.select(*keys, F.lit(0).cast("bigint").alias("_part"), "_fit", "p", "n", "s")
        return _run(rows.unionByName(asks, allowMissingColumns=True), keys, _Cells, True)
    marks = [i / parts for i in range(1, parts)]
    edges = cells.agg(F.percentile_approx("p", marks, 10 * parts)).first()[0]
    placed = moved.select(*keys, place_in(F.lit(edges), F.col("p"), parts).cast("bigint").alias("_part"), "_fit", "p", "n", "s")
    versions = _run(placed, keys, _Cells, False)
    while True:
        parts = -(-parts // fan)
        up = versions.select(*keys, F.floor(F.col("_part") / fan).cast("bigint").alias("_part"), "_fit", F.col("_part").alias("_child"), "lo", "hi", "n", "s")
        if parts == 1:
            return _run(up.unionByName(asks, allowMissingColumns=True), keys, _Parts, True)
        versions = _run(up, keys, _Parts, False)


def seen_probabilities(rows: DataFrame, keys: list[str], seq: str, p: str, y: str, min_fit: int, refit: int, window: int | None) -> DataFrame:
    """(keys, _fit, _seen): of the probabilities of a stretch's rows, those that the rows its refit learns from have as well."""
    known = F.when(F.col(y).isNotNull(), F.col(seq))
    last = rows.filter(F.col(p).isNotNull()).groupBy(*keys, "_fit", F.col(p).alias("_p")).agg(F.max(known).alias("_last"))
    last = running(last, [*keys, "_p"], ["_fit"], [F.floor(F.col("_fit") / ROWS)], maxes={"_prior": F.col("_last")}, exclusive=True)
    low = F.lit(0) if window is None else F.col("_fit") * refit + (min_fit - window)
    return last.filter((F.col("_fit") >= 0) & (F.col("_prior") >= low)).groupBy(*keys, "_fit").agg(F.collect_list("_p").alias("_seen"))


def recalibrate(df: DataFrame, keys: list[str], seq: str, p: str, y: str, min_fit: int, refit: int, name: str, window: int | None = None, unit: int = UNIT, fan: int = FAN, between: bool = True) -> DataFrame:
    """Refit every ``refit`` rows on the rows before (all, or the last ``window``) and apply to the next.

    A probability that no learned row has lies on the line between its neighbours, or stays raw unless ``between``. Rows before ``min_fit``, and stretches whose history has one class, keep the raw probability; a row without one stays
    without. Rows without an outcome are not learned from. Equal positions are seen by the same refits.
    """
    rows = df.withColumn("_fit", F.floor((F.col(seq) - min_fit) / refit))
    asked = rows.filter("_fit >= 0").select(*keys, "_fit").distinct()
    moved = materialise(changes(df, keys, seq, p, y, min_fit, refit, window), "changes")
    table = fits(moved, asked, keys, unit, fan)
    fitted = interpolate(F.col(p), F.col("x"), F.col("v"))
    if not between:
        table = table.join(seen_probabilities(rows, keys, seq, p, y, min_fit, refit, window), [*keys, "_fit"])
        fitted = F.when(F.array_contains("_seen", F.col(p)), fitted)
    out = rows.join(table, [*keys, "_fit"], "left")
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.coalesce(fitted, F.col(p)))).drop("_fit", "x", "v", "_seen")


# ---------------------------------------------------------------- streams of few distinct probabilities


def most_probabilities(cells: DataFrame, keys: list[str]) -> int:
    """The largest number of distinct probabilities of a stream."""
    per = cells.groupBy(*keys).agg(F.count_distinct("p").alias("d"))
    return per.agg(F.max("d")).first()[0] or 0


def _isotonic(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Fits of many rows of counts at once: the largest over left ends of the smallest mean to right ends."""
    width = n.shape[1]
    cn, cs = (np.concatenate((np.zeros((len(x), 1)), np.cumsum(x, axis=1)), axis=1) for x in (n, s))
    best = np.full(n.shape, -np.inf)
    for lo in range(width):
        weight = cn[:, lo + 1 :] - cn[:, lo : lo + 1]
        mean = np.divide(cs[:, lo + 1 :] - cs[:, lo : lo + 1], weight, out=np.full(weight.shape, np.inf), where=weight > 0)
        least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
        best[:, lo:] = np.maximum(best[:, lo:], least)
    return best


def _own_values(table: pa.Table, group: np.ndarray, span: int, back: int, first: int, plans: list[tuple[int, int | None]], pairs: list[tuple[str, str]]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Which cells are own ones (kind 2) of whole runs, and for each pair of counts their values by each plan.

    Kinds 0 and 1 are counts before the run and borrowed cells.
    """
    unit, at, p, kind = (table.column(c).to_numpy() for c in ("_run", "_at", "p", "_kind"))
    by = np.lexsort((p, group))
    new = np.ones(len(by), bool)
    new[1:] = group[by][1:] != group[by][:-1]
    step = new.copy()
    step[1:] |= p[by][1:] != p[by][:-1]
    count = np.cumsum(step) - 1
    rank = np.empty(len(by), np.int64)
    rank[by] = count - np.maximum.accumulate(np.where(new, count, 0))
    groups, width = int(group.max()) + 1, int(rank.max()) + 1
    rel = np.where(kind > 0, at - (unit * span - back), 0)
    size = np.zeros(groups, np.int64)
    np.maximum.at(size, group, rel + 2)
    base = np.cumsum(size) - size
    own, old, seen = kind == 2, kind == 0, kind > 0
    g, r, t, own_p = group[own], rank[own], at[own], p[own]
    fits = []
    for refit, window in plans:
        k = (t - first) // refit
        anchor = first + k * refit - (unit[own] * span - back)
        fit, where = np.unique(np.where(k >= 0, base[g] + anchor, -1), return_inverse=True)
        of = np.empty(len(fit), np.int64)
        of[where] = g
        fits.append((window, fit, where, of))
    values = []
    for pair in pairs:
        carry, upto = np.zeros((2, groups, width)), np.zeros((2, int(size.sum()), width))
        for i, x in enumerate(table.column(c).to_numpy() for c in pair):
            np.add.at(carry[i], (group[old], rank[old]), x[old])
            np.add.at(upto[i], (base[group[seen]] + rel[seen] + 1, rank[seen]), x[seen])
        upto = np.cumsum(upto, axis=1)
        values.append([])
        for window, fit, where, of in fits:
            if window is None:
                known = carry[:, of] + upto[:, fit] - upto[:, base[of] + back]
            else:
                known = upto[:, fit] - upto[:, np.maximum(fit - window, 0)]
            weight, ones = known.sum(axis=2)
            sound = (fit >= 0) & (ones > 0) & (ones < weight)
            found = np.where((known[0] > 0) & sound[:, None], _isotonic(*known), np.nan)[where, r]
            values[-1].append(np.where(np.isnan(found), own_p, found))
    return own, values


def _fit_runs(table: pa.Table, group: np.ndarray, **how) -> pa.Table:
    """Own cells with one value per plan."""
    own, values = _own_values(table, group, pairs=[("n", "s")], **how)
    out = table.filter(pa.array(own))
    for i, v in enumerate(values[0]):
        out = out.append_column(f"_v{i}", pa.array(v))
    return out


def _sum_runs(table: pa.Table, group: np.ndarray, keys: list[str], levels: dict[float, str], **how) -> pa.Table:
    """Sums over the own cells of each run that are in use, a row per level: see ``stretch_sums``."""
    own, values = _own_values(table, group, pairs=[("n", s) for s in levels.values()], **how)
    use = table.column("use").to_numpy()[own]
    mine = table.filter(pa.array(own)).filter(pa.array(use))
    if not mine.num_rows:
        return pa.table({c: pa.array([], table.schema.field(c).type) for c in keys} | {c: pa.array([], pa.float64()) for c in ("rr", "rows", "known", "n", "c", "b")})
    at = group[own][use]
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    rows, n = (mine.column(c).to_numpy().astype(np.float64) for c in ("rows", "n"))
    heads, out = mine.select(keys).take(pa.array(start)), []
    for (x, name), (v,) in zip(levels.items(), values):
        v, s = v[use], mine.column(name).to_numpy()
        sums = np.add.reduceat((rows, rows, n, v * rows, s * (v - 1.0) * (v - 1.0) + (n - s) * v * v), start, axis=1)
        part = heads.append_column("rr", pa.array(np.full(len(start), x)))
        for c, total in zip(("rows", "known", "n", "c", "b"), sums):
            part = part.append_column(c, pa.array(total))
        out.append(part)
    return pa.concat_tables(out)


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], fit, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows at ends of runs and fits those it has, some ``CELLS`` at a time."""
    def marks(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in names:
            codes = table.column(c).combine_chunks().dictionary_encode()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def done(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from fit(table, np.cumsum(new)).select(out.names).cast(out).to_batches()

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < CELLS:
            continue
        table = pa.Table.from_batches(waiting)
        new = marks(table)
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield from done(table.slice(0, cut), new[:cut])
        waiting = table.slice(cut).combine_chunks().to_batches()
    if any(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting)
        yield from done(table, marks(table))


def stretch_values(cells: DataFrame, keys: list[str], first: int, plans: dict[str, tuple[int, int | None]], run: int = RUN) -> DataFrame:
    """``cells`` with the recalibrated value of every plan {name: (refit, window)}; equals ``recalibrate`` with ``between=False``.

    Cells are (keys, _at, p, rows, n, s): rows of a stretch of the stream with a probability, those of them with an outcome, and
    the sum of these. ``first``, refit and window count stretches; a window of None reads all history. The number of distinct
    probabilities of a stream should be at most ``FEW``. Cells without a probability get NULL.
    """
    rows, span, back = _run_rows(cells, keys, ["n", "s"], list(plans.values()), run)
    schema = T.StructType([rows.schema[c] for c in (*keys, "_at", "p", "rows", "n", "s")] + [T.StructField(f"_v{i}", T.DoubleType()) for i in range(len(plans))])
    out = _in_runs(rows, keys, partial(_fit_runs, span=span, back=back, first=first, plans=list(plans.values())), schema)
    out = out.withColumnsRenamed({f"_v{i}": name for i, name in enumerate(plans)})
    return out.unionByName(cells.filter(F.col("p").isNull()).withColumns({name: F.lit(None).cast("double") for name in plans}))


def stretch_sums(cells: DataFrame, keys: list[str], levels: dict[float, str], first: int, refit: int, window: int | None = None, run: int = RUN) -> DataFrame:
    """(keys, rr, rows, known, n, c, b) of each level {rr: column} after a recalibration as in ``stretch_values``, in a few rows a key.

    Cells are (keys, _at, p, use, rows, n, a column per level): as there, the column of a level instead of s; all cells are
    learned from, those in ``use`` are summed up: rows, those with a value, those of them with an outcome, the values, and
    the squared distances of values and outcomes. No cell of a level leaves its task.
    """
    counts = list(levels.values())
    rows, span, back = _run_rows(cells, keys, ["n", *counts], [(refit, window)], run, use=F.lit(False))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("rr", "rows", "known", "n", "c", "b")])
    out = _in_runs(rows, keys, partial(_sum_runs, keys=keys, levels=levels, span=span, back=back, first=first, plans=[(refit, window)]), schema)
    bare = cells.filter(F.col("p").isNull() & F.col("use")).groupBy(*keys).agg(F.sum("rows").cast("double").alias("rows"))
    bare = bare.select(*keys, F.explode(F.array(*[F.lit(x) for x in levels])).alias("rr"), "rows", *[F.lit(0.0).alias(c) for c in ("known", "n", "c", "b")])
    return out.unionByName(bare)


def _run_rows(cells: DataFrame, keys: list[str], counts: list[str], plans: list[tuple[int, int | None]], run: int, **fill) -> tuple[DataFrame, int, int]:
    """Cells of each run (kind 2), those it borrows from the run before (1) and, where a plan reads all history, the counts before it (0)."""
    back = max(refit + (window or 0) for refit, window in plans)
    span = max(run, back)
    home = F.floor(F.col("_at") / span).cast("bigint")
    known = cells.filter(F.col("p").isNotNull()).withColumn("_run", home)
    known = known.withColumns({"p": F.col("p").cast("double")} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in counts})
    mine = known.withColumn("_kind", F.lit(2))
    lent = known.filter(F.col("_at") - F.col("_run") * span >= span - back).withColumns({"_run": F.col("_run") + 1, "_kind": F.lit(1)})
    last = known.groupBy(*keys).agg(F.max("_run").alias("_last")).filter("_last > 0")
    rows = mine.unionByName(lent.join(last, keys).filter("_run <= _last").drop("_last"))
    if any(window is None for _, window in plans):
        sums = known.groupBy(*keys, "_run", "p").agg(*[F.sum(c).alias(c) for c in counts]).join(last, keys)
        runs = sums.select(*keys, "p", "_last").distinct().select(*keys, "p", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_run"))
        before = Window.partitionBy(*keys, "p").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        past = runs.join(sums.drop("_last"), [*keys, "p", "_run"], "left").select(*keys, "p", "_run", *[F.sum(c).over(before).alias(c) for c in counts])
        rows = rows.unionByName(past.filter(F.col(counts[0]).isNotNull()).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumns({"_at": F.coalesce("_at", F.lit(0).cast("bigint")), "rows": F.coalesce("rows", F.lit(0).cast("bigint"))} | {c: F.coalesce(c, v) for c, v in fill.items()})
    return rows.select(*keys, "_run", "_at", "p", *fill, "rows", *counts, "_kind"), span, back


def _in_runs(rows: DataFrame, keys: list[str], fit, schema: T.StructType) -> DataFrame:
    """``fit`` over whole runs of sorted rows."""
    work = partial(_whole_runs, names=[*keys, "_run"], fit=fit, out=to_arrow_schema(schema))
    return rows.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run").mapInArrow(work, schema)
