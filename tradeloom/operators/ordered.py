"""Ordered computations over long, possibly skewed series.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. The functions here cut every key
into blocks that follow its order, work inside the blocks in parallel, and carry a small summary
from block to block, so the largest unit of work is one block however large a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.session import materialise

ROWS_PER_BLOCK = 4096


def _sorted(cols: Sequence[str | Column], reverse: bool) -> list[Column]:
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [c.desc() for c in cols] if reverse else [c.asc() for c in cols]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running sums, maxima and minima per key, plus whole-key totals.

    Each row sees the rows up to itself, or only those before it if ``exclusive``.

    ``block`` must rise with ``order``. Rows are windowed per (key, block); one summary row per block
    is scanned per key and added back. Both sides are partitioned alike, so rows move once.
    """
    sums, maxes, mins, totals = sums or {}, maxes or {}, mins or {}, totals or {}
    by = [*keys, "_block"]
    rows = df.withColumn("_block", F.struct(*block))
    inside = Window.partitionBy(*by).orderBy(*_sorted(order, reverse))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    folds = {"s": (F.sum, sums), "x": (F.max, maxes), "n": (F.min, mins)}

    summary = [fn(c).alias(f"_b{tag}_{name}") for tag, (fn, cols) in folds.items() for name, c in cols.items()]
    summary += [F.sum(c).alias(f"_bt_{name}") for name, c in totals.items()]
    across = Window.partitionBy(*keys).orderBy(*_sorted(["_block"], reverse))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    blocks = rows.groupBy(*by).agg(*summary)
    carried = blocks.select(
        *by,
        *[fn(f"_b{tag}_{name}").over(before).alias(f"_o{tag}_{name}") for tag, (fn, cols) in folds.items() for name in cols],
        *[F.sum(f"_bt_{name}").over(whole).alias(name) for name in totals],
    )
    out = rows.withColumns({f"_l{tag}_{name}": fn(c).over(inside) for tag, (fn, cols) in folds.items() for name, c in cols.items()})
    out = out.join(carried, by)
    final = {}
    for name in sums:
        carry, local = F.col(f"_os_{name}"), F.col(f"_ls_{name}")
        final[name] = F.coalesce(carry + local, carry, local)
    for name in maxes:
        final[name] = F.greatest(f"_ox_{name}", f"_lx_{name}")
    for name in mins:
        final[name] = F.least(f"_on_{name}", f"_ln_{name}")
    scratch = [c for c in out.columns if c.startswith(("_ls_", "_lx_", "_ln_", "_os_", "_ox_", "_on_"))]
    return out.withColumns(final).drop("_block", *scratch)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    name: str = "pos",
    count: str | None = None,
) -> DataFrame:
    """Dense position from 0 per key, and the key's row count if ``count`` names it."""
    one = F.lit(1).cast("bigint")
    out = running(df, keys, order, block, sums={name: one}, totals={count: one} if count else None)
    return out.withColumn(name, F.col(name) - 1)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    build: Callable[[DataFrame, Window], DataFrame],
    back: int = 0,
    ahead: int = 0,
    size: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Windows of bounded reach, one task unit per block of positions.

    Each block of ``size`` positions borrows the ``back`` rows before it and the ``ahead`` rows after it;
    ``build(frame, window)`` adds columns whose frames stay within that reach; borrowed rows are dropped.
    """
    size = max(size, back, ahead)
    home = F.floor(F.col(pos) / size)
    offset = F.col(pos) - home * size
    homes = [home]
    if back:
        homes.append(F.when(offset >= size - back, home + 1))
    if ahead:
        homes.append(F.when((offset < ahead) & (home > 0), home - 1))
    rows = df.withColumns({"_home": home, "_block": F.explode(F.array_compact(F.array(*homes)))})
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    return build(rows, window).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


def equity_curve(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    pnl: Column,
    start: float | Column,
    start_is_peak: bool = True,
) -> DataFrame:
    """Equity after each row and its running peak; the start counts as a peak unless told otherwise."""
    start = F.lit(start) if not isinstance(start, Column) else start
    by = [*keys, "_block"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.struct(*block)).withColumn("_cum", F.sum(pnl).over(inside))
    blocks = rows.groupBy(*by).agg(F.sum(pnl).alias("_total"), F.max("_cum").alias("_high"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    carried = carried.withColumn("_prior", F.max(F.col("_base") + F.col("_high")).over(before))
    out = rows.join(carried.select(*by, "_base", "_prior"), by)
    high = F.col("_base") + F.max("_cum").over(inside)
    out = out.withColumns(
        {
            "equity": start + F.col("_base") + F.col("_cum"),
            "peak": start + F.greatest(F.lit(0.0 if start_is_peak else None).cast("double"), F.col("_prior"), high),
        }
    )
    return out.drop("_block", "_cum", "_base", "_prior")


def default_splits(df: DataFrame) -> int:
    """Value ranges for ``value_cdf``: they follow the shuffle width the cluster is set to."""
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def place_in(edges: Column, value: Column, most: int) -> Column:
    """How many of at most ``most`` ascending ``edges`` are below ``value``, by halving steps."""
    halves = F.array(*[F.lit(1 << k) for k in range(max(1, most).bit_length() - 1, -1, -1)])
    beyond = lambda at, step: (at + step <= F.size(edges)) & (F.get(edges, at + step - 1) < value)
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(beyond(at, step), at + step).otherwise(at))


def value_cdf(
    df: DataFrame, keys: Sequence[str], value: str, grid: Column | None = None, splits: int | None = None, weight: str | None = None
) -> DataFrame:
    """Distinct values per key with their count ``_n``, the rows ``_below`` them and the key's ``_total``.

    ``weight`` counts a row so many times.

    Equal values are counted first, so ties cost one row. Blocks are value ranges: ``grid`` if given,
    else ``splits`` ranges of near-equal weight from a bounded quantile sketch.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("_n"))
    if grid is None:
        splits = splits or default_splits(df)
        marks = [i / splits for i in range(1, splits)] or [0.5]
        edges = counts.agg(F.percentile_approx(value, marks, 10 * splits).alias("edges")).scalar()
        counts = counts.withColumn("_edges", edges)
        grid = place_in(F.col("_edges"), F.col(value), splits)
    out = running(counts, keys, [value], [grid], sums={"_cum": F.col("_n")}, totals={"_total": F.col("_n")})
    return out.withColumn("_below", F.col("_cum") - F.col("_n")).drop("_cum", "_edges")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    grid: Column | None = None,
    splits: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, whatever the size of a key."""
    cdf = value_cdf(df, keys, value, grid, splits, weight)
    aggs, final = [], []
    for name, q in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_n"))
        aggs += [
            F.max(F.when(covers(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(covers(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_w_{name}"),
        ]
        final.append((F.col(f"_lo_{name}") + F.col(f"_w_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return cdf.groupBy(*keys).agg(*aggs).select(*keys, *final)


def many_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]], splits: int | None = None
) -> DataFrame:
    """Exact quantiles of several expressions at once: {name: (expression, probability)}.

    Rows of a key meet before their values are counted, so that a task counts the values of its share of the keys only; large keys
    are split over tasks by adaptive execution. The counts are written once for the sketch and both passes of ``value_cdf``.
    """
    frame = df.select(*keys, *[c.cast("double").alias(f"_v_{name}") for name, (c, _) in wanted.items()])
    if keys:
        near = frame.withColumn("_near", F.xxhash64(*keys)).hint("rebalance", "_near")  # no grouping column: counts are dealt anew
        frame = near.drop("_near")
    entries = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("_what"), F.col(f"_v_{n}").alias("_value")) for i, n in enumerate(wanted)])
    long = frame.select(*keys, F.inline(entries)).filter("_value is not null")
    counts = materialise(long.groupBy(*keys, "_what", "_value").agg(F.count(F.lit(1)).alias("_k")), "value-counts")
    out = value_cdf(counts, [*keys, "_what"], "_value", splits=splits, weight="_k")
    aggs, final = [], []
    for i, (name, (_, q)) in enumerate(wanted.items()):
        mine = F.col("_what") == i
        h = (F.col("_total") - 1) * F.lit(float(q))
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = mine & (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(F.when(mine, h - F.floor(h))).alias(f"_w_{name}"))
        final.append((F.col(f"_lo_{name}") + F.col(f"_w_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return out.groupBy(*keys).agg(*aggs).select(*keys, *final)


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str, grid: Column | None = None, nulls_last: bool = False
) -> DataFrame:
    """Rank from 1 in rising order, ties averaged; NULLs stay NULL, or share the bottom rank."""
    cdf = value_cdf(df, keys, value, grid)
    ranks = cdf.select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    out = df.join(ranks, [*keys, value], "left")
    if nulls_last:
        sizes = df.groupBy(*keys).agg(
            F.count(value).alias("_known"), F.count(F.lit(1)).alias("_all")
        )
        out = attach(out, sizes, keys)
        bottom = F.col("_known") + (F.col("_all") - F.col("_known") + 1) / 2.0
        out = out.withColumn(name, F.coalesce(F.col(name), bottom)).drop("_known", "_all")
    return out


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key facts; with no keys the facts are one row, read as scalar subqueries."""
    if keys:
        return df.join(facts, list(keys), "left")
    return df.withColumns({c: facts.select(c).scalar() for c in facts.columns})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
