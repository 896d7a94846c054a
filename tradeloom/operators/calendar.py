"""Day spines, shifted cutoffs and time lookups by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.clock import years_between


def day_spine(df: DataFrame, day: Column, keys: list[str] | None = None) -> DataFrame:
    """One row per calendar day between the first and the last day."""
    ends = df.groupBy(*(keys or [])).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    days = F.explode(F.sequence("_first", "_last", F.expr("interval 1 day")))
    return ends.select(*(keys or []), days.alias("day"))


def shifted_cutoffs(bars: DataFrame, ratio: float, shifts: list[int], keys: list[str] | None = None) -> DataFrame:
    """Train cutoffs moved by whole days' worth of bars, kept inside the series."""
    keys = keys or ["symbol"]
    n = F.count(F.lit(1))
    shape = bars.groupBy(*keys).agg(
        n.alias("_n"),
        F.min("time").alias("_first"),
        F.floor(n * ratio).alias("_base"),
        (n / F.count_distinct(F.to_date("time"))).alias("_per_day"),
    )
    arms = shape.withColumn("shift_days", F.explode(F.array(*[F.lit(s) for s in shifts])))
    arms = arms.withColumn("shift_bars", F.rint(F.col("shift_days") * F.col("_per_day")).cast("bigint"))
    wanted = F.col("_base") + F.col("shift_bars")
    arms = arms.withColumn("cutoff_bar", F.greatest(F.lit(1).cast("bigint"), F.least("_n", wanted)))
    arms = arms.withColumns({"was_clipped": F.col("cutoff_bar") != wanted, "_end_bar": F.col("cutoff_bar") - 1})
    out = lookup_time(arms, bars, "_end_bar", "_end", keys)
    return out.withColumns(
        {"train_frac": F.col("cutoff_bar") / F.col("_n"), "years_span": years_between(F.col("_first"), F.col("_end"))}
    )


def lookup_time(df: DataFrame, bars: DataFrame, position: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """The time of the bar at a position."""
    keys = keys or ["symbol"]
    times = bars.select(*keys, F.col("bar_idx").alias(position), F.col("time").alias(name))
    return df.join(times, [*keys, position])
