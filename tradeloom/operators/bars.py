"""Bar building, indexing and session marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType

from tradeloom.functions.clock import epoch_seconds
from tradeloom.operators.ordered import ROWS_PER_BLOCK, rolling, running, with_position


def index_bars(bars: DataFrame, keys: list[str] | None = None, order: str = "time") -> DataFrame:
    """Dense ``bar_idx`` per symbol, counted month by month rather than by one global sort."""
    keys = keys or ["symbol"]
    month = F.year(order) * 12 + F.month(order)
    return with_position(bars, keys, [order], [month], "bar_idx")


def resample(
    bars: DataFrame, every: str, expected: int | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Left-closed, left-labelled OHLCV windows; windows without ``expected`` source bars are dropped."""
    keys = keys or ["symbol"]
    flags = [F.bool_or("session_break").alias("session_break")] if "session_break" in bars.columns else []
    out = bars.groupBy(*keys, F.window("time", every).start.alias("_start")).agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
        *flags,
        F.count(F.lit(1)).alias("n_source"),
    )
    if expected is not None:
        out = out.filter(F.col("n_source") == expected)
    return out.withColumnRenamed("_start", "time")


def add_session_break(bars: DataFrame, gap_seconds: float, keys: list[str] | None = None) -> DataFrame:
    """True where the previous bar is more than the gap away; the first bar opens a session."""

    def build(frame, w):
        gap = epoch_seconds(F.col("time")) - F.lag(epoch_seconds(F.col("time"))).over(w)
        return frame.withColumn("session_break", F.coalesce(gap > gap_seconds, F.lit(True)))

    return rolling(bars, keys or ["symbol"], "bar_idx", build, back=1)


def add_session_id(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running count of session breaks from 1."""
    block = [F.floor(F.col("bar_idx") / ROWS_PER_BLOCK)]
    opens = (F.col("session_break") | (F.col("bar_idx") == 0)).cast("bigint")
    return running(bars, keys or ["symbol"], ["bar_idx"], block, sums={"session_id": opens})


def split_by_ratio(bars: DataFrame, ratio: float, keys: list[str] | None = None) -> DataFrame:
    """``is_train`` for the first floor(ratio * n) bars of each symbol."""
    keys = keys or ["symbol"]
    sizes = bars.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("n_bars"))
    return bars.join(sizes, keys).withColumn("is_train", F.col("bar_idx") < F.floor(F.col("n_bars") * ratio))


def split_by_time(bars: DataFrame, cutoff: Column) -> DataFrame:
    """``is_train`` up to and including the cutoff."""
    return bars.withColumn("is_train", F.col("time") <= cutoff)


def drop_malformed(raw: DataFrame, time_format: str, prices: list[str]) -> DataFrame:
    """Remove footer and unparsable rows: no valid time or a missing price."""
    parsed = raw.withColumn("time", F.try_to_timestamp(F.col("time"), F.lit(time_format)))
    return parsed.dropna(subset=["time", *prices])


def check_contract(bars: DataFrame, first_year: int = 2005) -> DataFrame:
    """One row: row count, first and last year, and whether the years are plausible. Times with a zone are refused."""
    if not isinstance(bars.schema["time"].dataType, (TimestampNTZType, DateType)):
        raise TypeError("bar times must be free of zones: cast them to timestamp_ntz first")
    last = F.year(F.max("time"))
    first = F.year(F.min("time"))
    return bars.agg(
        F.count(F.lit(1)).alias("n_rows"),
        first.alias("first_year"),
        last.alias("last_year"),
        ((first >= first_year) & (last <= F.year(F.current_date()))).alias("ok"),
    )


def temporal_filter(df: DataFrame, time: Column, cutoff: Column) -> DataFrame:
    """Rows with a known time before the cutoff."""
    return df.filter(time < cutoff)


def temporal_filter_report(
    df: DataFrame, keys: list[str], time: Column, cutoff: Column, max_null_share: float
) -> DataFrame:
    """Counts behind ``temporal_filter`` and whether too many times are unknown or nothing is left."""
    n, kept, null = F.count(F.lit(1)), F.count_if(time < cutoff), F.count_if(time.isNull())
    status = F.when(null > n * max_null_share, "NULL_TIME").when(kept == 0, "EMPTY").otherwise("OK")
    return df.groupBy(*keys).agg(n.alias("n_rows"), kept.alias("n_kept"), null.alias("n_null"), status.alias("status"))


def resample_checks(bars: DataFrame, every: str, expected: int, keys: list[str] | None = None) -> DataFrame:
    """Per symbol: whole windows against their source bars, by summed volume and by extremes."""
    keys = keys or ["symbol"]
    whole = resample(bars, every, expected, keys).select(*keys, F.col("time").alias("_start"), "high", "low", "volume")
    source = bars.withColumn("_start", F.window("time", every).start)
    kept = source.join(whole.select(*keys, "_start"), [*keys, "_start"], "left_semi")
    facts = kept.groupBy(*keys, "_start").agg(
        F.max("high").alias("_high"), F.min("low").alias("_low"), F.sum("volume").alias("_volume")
    )
    both = whole.join(facts, [*keys, "_start"])
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("volume").alias("kept_volume"),
        F.sum("_volume").alias("source_volume"),
        (F.sum("volume") == F.sum("_volume")).alias("conserved"),
        F.bool_and((F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low"))).alias("extremes_ok"),
    )
