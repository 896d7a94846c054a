"""Vendor bar files: schema, scan, footer removal and incremental append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.bars import drop_malformed

# Columns of the vendor file, its time format and its footer.
VENDOR_SCHEMA = (
    "`Symbol` string, `Time` string, `Open` double, `High` double, `Low` double, `Latest` double, `Change` string, "
    "`%Change` string, `Volume` double, `Open Int` string, `synthetic` boolean, `session_break` boolean"
)
RENAMED = {
    "Symbol": "symbol", "Time": "time", "Open": "open", "High": "high", "Low": "low", "Latest": "close", "Volume": "volume",
}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
FOOTER = "Downloaded from"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Canonical bars of vendor files: footer and malformed rows dropped, synthetic rows left out."""
    raw = spark.read.schema(VENDOR_SCHEMA).option("header", True).csv(path)
    raw = raw.filter(~F.coalesce(F.col("Symbol").startswith(FOOTER), F.lit(False)))
    raw = raw.withColumnsRenamed(RENAMED).drop("Change", "%Change", "Open Int")
    bars = drop_malformed(raw, TIME_FORMAT, ["open", "high", "low", "close"])
    return bars.filter(~F.coalesce("synthetic", F.lit(False))).drop("synthetic")


def vendor_rows(bars: DataFrame, synthetic: Column) -> DataFrame:
    """Bars in the vendor's columns."""
    return bars.select(
        F.col("symbol").alias("Symbol"), F.date_format("time", TIME_FORMAT).alias("Time"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Latest"), F.lit("0").alias("Change"), F.lit("0%").alias("%Change"),
        F.col("volume").alias("Volume"), F.lit("0").alias("Open Int"), synthetic.alias("synthetic"), F.lit(False).alias("session_break"),
    )


def footer_row(like: DataFrame, text: str = f"{FOOTER} the vendor") -> DataFrame:
    """One footer line in the columns of ``like``."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields[1:]]
    return like.sparkSession.range(1).select(F.lit(text).alias(like.columns[0]), *nulls)


def only_newer(stored: DataFrame, fresh: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Fresh rows after the last stored time of their key; keys without stored rows come whole."""
    last = stored.groupBy(*keys).agg(F.max(time).alias("_last"))
    return fresh.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last")
