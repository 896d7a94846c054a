"""Streaming bars, deduplicated append, session windows and a running mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tradeloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STRETCH = 1 << 16  # ticks handed on at once


def read_ticks(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Tick files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def streaming_bars(ticks: DataFrame, every: str, delay: str, least_ticks: int = 1) -> DataFrame:
    """Bars of (symbol, time, tick_id, value); a bar appears once the watermark passes its end.

    Bars with fewer than ``least_ticks`` ticks are partial and dropped at that point.
    """
    at = F.struct("time", "tick_id")
    bars = ticks.withWatermark("time", delay).groupBy("symbol", F.window("time", every)).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return bars.filter(F.col("volume") >= least_ticks).select("symbol", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")


def deduplicated(ticks: DataFrame, keys: list[str], delay: str, time: str = "time") -> DataFrame:
    """The first of repeated rows that arrive within the watermark delay."""
    return ticks.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sessions(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of ticks per symbol closed by a gap without any."""
    grouped = ticks.withWatermark("time", delay).groupBy("symbol", F.session_window("time", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_ticks"), F.sum("value").alias("total")).select(
        "symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ticks", "total"
    )


class _Mean(StatefulProcessor):
    """Keeps one number per key: the exponential mean so far."""

    def __init__(self, span: int):
        self.alpha = 2.0 / (span + 1.0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [tuple(r[c].to_numpy() for c in ("time", "tick_id", "value")) for r in rows]
        time, tick, value = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((tick, time))
        del time
        mean = self.mean.get()[0] if self.mean.exists() else None
        for low in range(0, len(order), STRETCH):
            at = order[low : low + STRETCH]
            out = []
            for v in value[at].tolist():
                mean = v if mean is None else self.alpha * v + (1.0 - self.alpha) * mean
                out.append(mean)
            yield pd.DataFrame({"symbol": key[0], "tick_id": tick[at], "ema": out})
        self.mean.update((float(mean),))

    def close(self) -> None:
        pass


def streaming_ema(ticks: DataFrame, span: int) -> DataFrame:
    """Exponential mean per symbol in arrival order of the micro-batches, time order within one."""
    return ticks.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Mean(span), outputStructType="symbol string, tick_id bigint, ema double", outputMode="Append", timeMode="None"
    )


def run_available(stream: DataFrame, name: str, rocksdb: bool = False) -> DataFrame:
    """Process what is there, write it to the shared folder and read the result back."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    if rocksdb:
        spark.conf.set(setting, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(path)
