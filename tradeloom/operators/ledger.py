"""Daily ledgers, per-bar equity, benchmark alignment and daily correlations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.functions.maths import safe_div
from tradeloom.operators.calendar import day_spine
from tradeloom.operators.ordered import ROWS_PER_BLOCK, running
from tradeloom.session import materialise

TILE, TILE_DAYS = 256, 4096  # members and days of a correlation task


def month_block(day: str) -> list[Column]:
    return [F.year(day) * 12 + F.month(day)]


def daily_ledger(df: DataFrame, keys: list[str], day: str, pnl: str, start: float) -> DataFrame:
    """Every calendar day with its trades, its result and the equity at its end."""
    daily = df.groupBy(*keys, F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n_trades"), F.sum(pnl).alias("pnl_day"))
    full = day_spine(df, F.col(day), keys).join(daily, [*keys, "day"], "left")
    full = full.withColumns({"n_trades": F.coalesce("n_trades", F.lit(0)), "pnl_day": F.coalesce("pnl_day", F.lit(0.0))})
    out = running(full, keys, ["day"], month_block("day"), sums={"_sum": F.col("pnl_day")})
    return out.withColumn("equity_eod", F.col("_sum") + start).drop("_sum")


def daily_returns(curve: DataFrame, keys: list[str], day: str, order: str) -> DataFrame:
    """Last equity of each day and its change to the day before; one row per key and trading day."""
    last = curve.groupBy(*keys, F.col(day).alias("day")).agg(F.max_by("equity", order).alias("equity"))
    w = Window.partitionBy(*keys).orderBy("day")  # bounded by the calendar
    return last.withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1.0)


def equity_by_bar(bars: DataFrame, exits: DataFrame, keys: list[str], start: float, bar: str = "bar_idx") -> DataFrame:
    """Equity after the last exit at or before every bar."""
    per_bar = exits.groupBy(*keys, F.col("exit_bar").alias(bar)).agg(F.sum("pnl").alias("_pnl"))
    rows = bars.select(*keys, bar).join(per_bar, [*keys, bar], "left")
    block = [F.floor(F.col(bar) / ROWS_PER_BLOCK)]
    out = running(rows, keys, [bar], block, sums={"_sum": F.coalesce("_pnl", F.lit(0.0))})
    return out.withColumn("equity", F.col("_sum") + start).drop("_sum", "_pnl")


def align_benchmark(days: DataFrame, quotes: DataFrame, start: float) -> DataFrame:
    """Latest quote at or before each day, scaled to ``start`` on the first quoted day.

    ``days``: (day); ``quotes``: (day, close). Both have at most one row per calendar day.
    """
    both = days.select("day", F.lit(True).alias("_ask"), F.lit(None).cast("double").alias("close")).unionByName(
        quotes.select("day", F.lit(False).alias("_ask"), "close")
    )
    per_day = both.groupBy("day").agg(F.bool_or("_ask").alias("_ask"), F.max("close").alias("close"))
    at = F.when(F.col("close").isNotNull(), F.struct("day", "close"))
    seen = running(per_day, [], ["day"], month_block("day"), maxes={"_last": at})
    asked = seen.filter(F.col("_ask")).select("day", F.col("_last.close").alias("close"))
    first = asked.filter(F.col("close").isNotNull()).agg(F.min_by("close", "day")).scalar()
    return asked.withColumn("scaled", F.col("close") / F.nullif(first, F.lit(0.0)) * start)


def _cross_products(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial sums of products for all pairs of one cell, the upper half where both tiles are one."""
    i, j, _ = (k.as_py() for k in key)
    member = rows["member"].combine_chunks().dictionary_encode()
    names, at = member.dictionary, member.indices.to_numpy()
    side = np.zeros(len(names), dtype=np.int64)
    side[at] = rows["side"].to_numpy()
    day = rows["day"].combine_chunks().dictionary_encode()
    seen = day.indices.is_valid().to_numpy(zero_copy_only=False)
    grid = np.zeros((len(names), max(1, len(day.dictionary))))
    grid[at[seen], day.indices.fill_null(0).to_numpy()[seen]] = rows["p"].to_numpy()[seen]
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == (i != j))
    xy = grid[first] @ grid[second].T
    rank = np.empty(len(names), dtype=np.int64)  # the same order of a pair in every stretch
    rank[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(names))
    keep = rank[first][:, None] <= rank[second][None, :] if i == j else np.ones(xy.shape, dtype=bool)
    a, b = np.nonzero(keep)
    return pa.table([names.take(pa.array(first[a])), names.take(pa.array(second[b])), pa.array(xy[keep])], names=["member_a", "member_b", "xy"])


def correlation_matrix(df: DataFrame, key: str, day: str, pnl: str, tile: int = TILE, days: int = TILE_DAYS) -> DataFrame:
    """Pearson correlation of daily sums between all members of a pool; a missing day counts 0, a member without spread gives 0.

    Members are dealt to tiles and days to stretches. A task owns a pair of tiles and a stretch and multiplies two small
    matrices; partial products add up over the stretches. Only pairs of tiles i <= j are computed, the other half mirrored,
    and no task or driver sees all members. The result has a row per ordered pair. Rows without a member or day are left out,
    a missing result counts 0.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    daily = materialise(rows.groupBy(F.col(key).alias("member"), F.col(day).alias("day")).agg(F.sum(F.coalesce(F.col(pnl).cast("double"), F.lit(0.0))).alias("p")), "daily")
    members = daily.groupBy("member").agg(F.sum("p").alias("x"), F.sum(F.col("p") * F.col("p")).alias("xx"))
    size, n_days = daily.agg(F.count_distinct("member"), F.count_distinct("day")).first()
    tiles, stretches = -(-size // tile) or 1, -(-n_days // days) or 1
    home = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    cells = daily.select("member", "day", "p", home("day", stretches).alias("stretch"))
    every = members.select("member", F.lit(None).cast(daily.schema["day"].dataType).alias("day"), F.lit(0.0).alias("p"), F.lit(0).alias("stretch"))  # all pairs exist
    placed = cells.unionByName(every).withColumn("t", home("member", tiles)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = placed.select(F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "stretch", "member", "day", "p", (F.col("t") > F.col("other")).cast("int").alias("side"))
    kind = T.StructType([T.StructField(c, daily.schema["member"].dataType) for c in ("member_a", "member_b")] + [T.StructField("xy", T.DoubleType())])
    parts = dealt.groupBy("i", "j", "stretch").applyInArrow(_cross_products, kind)
    total = parts.groupBy("member_a", "member_b").agg(F.sum("xy").alias("xy"))
    n = F.lit(float(max(1, n_days)))
    spread = members.select("member", (F.col("x") / n).alias("mean"), (F.col("xx") / n - (F.col("x") / n) * (F.col("x") / n)).alias("var"))
    for side in ("a", "b"):
        total = total.join(spread.withColumnsRenamed({"member": f"member_{side}", "mean": f"mean_{side}", "var": f"var_{side}"}), f"member_{side}")
    cov = F.col("xy") / n - F.col("mean_a") * F.col("mean_b")
    flat = (F.col("var_a") <= 1e-12) | (F.col("var_b") <= 1e-12)
    upper = total.select("member_a", "member_b", F.when(flat, 0.0).otherwise(safe_div(cov, F.sqrt(F.col("var_a") * F.col("var_b")))).alias("corr"), F.lit(n_days).alias("n_days"))
    lower = upper.filter(~F.col("member_a").eqNullSafe(F.col("member_b"))).select(F.col("member_b").alias("member_a"), F.col("member_a").alias("member_b"), "corr", "n_days")
    return upper.unionByName(lower)
