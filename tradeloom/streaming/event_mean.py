"""Exponential mean per symbol in event time, the same however the ticks are split over files and batches.

Ticks wait in the state, packed per symbol and stretch of time, until the watermark is past their stretch; an event-time
timer then takes out that stretch, sorts it and moves the mean on. Nothing is emitted earlier, so a late tick within the
delay still takes its place. The state of a symbol is one number and the stretches of the delay; a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PACKED = np.dtype([("at", "<i8"), ("tick_id", "<i8"), ("value", "<f8")])


class _EventMean(StatefulProcessor):
    def __init__(self, span: int, stretch: int):
        self.alpha, self.stretch = 2.0 / (span + 1.0), stretch * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "mean double")
        self.waiting = handle.getMapState("waiting", "stop bigint", "ticks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            packed = np.empty(len(batch), _PACKED)
            packed["at"], packed["tick_id"], packed["value"] = batch["at"], batch["tick_id"], batch["value"]
            end = packed["at"] // self.stretch * self.stretch + self.stretch
            for stop in np.unique(end[end > closed]).tolist():  # others come too late
                new = packed[end == stop].tobytes()
                if self.waiting.containsKey((stop,)):
                    new = bytes(self.waiting.getValue((stop,))[0]) + new
                else:
                    self.handle.registerTimer(stop // 1000)
                self.waiting.updateValue((stop,), (new,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stop = (expiredTimerInfo.getExpiryTimeInMs() * 1000,)
        ticks = np.frombuffer(bytes(self.waiting.getValue(stop)[0]), _PACKED)
        self.waiting.removeKey(stop)
        mean, out = (self.mean.get()[0] if self.mean.exists() else None), []
        ticks = ticks[np.lexsort((ticks["tick_id"], ticks["at"]))]
        for value in ticks["value"].tolist():
            mean = value if mean is None else self.alpha * value + (1.0 - self.alpha) * mean
            out.append(mean)
        self.mean.update((float(mean),))
        yield pd.DataFrame({"symbol": key[0], "tick_id": ticks["tick_id"], "ema": out})

    def close(self) -> None:
        pass


def event_time_ema(ticks: DataFrame, span: int, delay: str, stretch: int = 60) -> DataFrame:
    """(symbol, tick_id, ema) of ticks (symbol, time, tick_id, value), in order of time and then tick_id.

    A tick appears once the watermark, ``delay`` behind the latest time, is past its stretch of ``stretch`` seconds; a tick later than that is dropped.
    Ticks without a time or value are left out; repeated ticks count each.
    """
    rows = ticks.filter(F.col("time").isNotNull() & F.col("value").isNotNull()).withWatermark("time", delay)
    rows = rows.select("symbol", "time", F.unix_micros("time").alias("at"), F.coalesce("tick_id", F.lit(-1)).alias("tick_id"), "value")
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_EventMean(span, stretch), outputStructType="symbol string, tick_id bigint, ema double", outputMode="Append", timeMode="EventTime"
    )
