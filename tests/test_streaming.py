"""Streams over several files: late rows, repeats and state kept between batches."""

import datetime as dt

import numpy as np
import pytest

from tradeloom.session import scratch_path
from tradeloom.streaming import bars as ST
from tradeloom.streaming import event_mean as EV

SCHEMA = "symbol string, time timestamp, tick_id bigint, value double"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


@pytest.fixture()
def folder(spark):
    """Four files in order; the last holds a row far too late.

    Late rows are judged by the watermark of the batch before, hence the file in between.
    """
    path = scratch_path(spark, "ticks")
    put(spark, path, [("s", at(1, 5), 1, 10.0), ("s", at(1, 50), 2, 12.0)])
    put(spark, path, [("s", at(2, 10), 3, 11.0), ("s", at(2, 10), 3, 11.0), ("s", at(6), 4, 9.0)])
    put(spark, path, [("s", at(6, 30), 7, 9.5)])
    put(spark, path, [("s", at(1, 30), 5, 99.0), ("s", at(9), 6, 8.0)])
    return path


def stream(spark, folder):
    return ST.read_ticks(spark, folder, SCHEMA, files_per_trigger=1)


def test_bars_close_behind_the_watermark(spark, folder):
    got = ST.run_available(ST.streaming_bars(stream(spark, folder), "1 hour", "1 hour"), "bars").orderBy("time").collect()
    assert [(r.time.hour, r.open, r.high, r.close, r.volume) for r in got] == [(1, 10.0, 12.0, 12.0, 2), (2, 11.0, 11.0, 11.0, 2), (6, 9.0, 9.5, 9.5, 2)]


def test_partial_bars_are_dropped(spark, folder):
    got = ST.run_available(ST.streaming_bars(stream(spark, folder), "1 hour", "1 hour", least_ticks=2), "bars")
    assert sorted(r.time.hour for r in got.collect()) == [1, 2, 6]


def test_repeats_are_dropped(spark, folder):
    got = ST.run_available(ST.deduplicated(stream(spark, folder), ["tick_id"], "12 hours"), "dedup")
    assert sorted(r.tick_id for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_sessions_split_on_gaps(spark, folder):
    got = ST.run_available(ST.sessions(stream(spark, folder), "1 hour", "1 hour"), "sessions").orderBy("start").collect()
    assert [(r.start.hour, r.n_ticks) for r in got] == [(1, 4), (6, 2)]


def test_mean_survives_batches(spark, folder):
    got = ST.run_available(ST.streaming_ema(stream(spark, folder), 3), "ema", rocksdb=True).orderBy("tick_id").collect()
    y, want = None, {}
    for tick, v in ((1, 10.0), (2, 12.0), (3, 11.0), (3, 11.0), (4, 9.0), (7, 9.5), (5, 99.0), (6, 8.0)):
        y = v if y is None else 0.5 * v + 0.5 * y
        want.setdefault(tick, []).append(y)
    assert np.allclose(sorted(r.ema for r in got), sorted(v for vs in want.values() for v in vs))


@pytest.mark.parametrize("files", [1, 4, 9])
def test_event_mean_is_the_same_over_any_split(spark, files):
    """Ticks out of order by less than the delay, dealt to files in order of arrival; two symbols, ties in time."""
    rng = np.random.default_rng(6)
    rows = []
    for symbol, n in (("hot", 60), ("b", 15)):
        minutes = np.sort(rng.integers(0, 600, n))
        rows += [(int(m + rng.integers(0, 40)), symbol, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)), i, float(v)) for i, (m, v) in enumerate(zip(minutes, rng.normal(size=n)))]
    rows.sort()
    path = scratch_path(spark, "ticks")
    for part in np.array_split(np.arange(len(rows)), files):
        put(spark, path, [rows[k][1:] for k in part])
    put(spark, path, [("b", dt.datetime(2024, 1, 2), 99, 0.0)])  # moves the watermark past the others
    put(spark, path, [("b", dt.datetime(2024, 1, 2, 0, 1), 100, 0.0), ("hot", dt.datetime(2024, 1, 1), 101, 50.0)])  # the second is too late
    got = {(r.symbol, r.tick_id): r.ema for r in ST.run_available(EV.event_time_ema(stream(spark, path), 5, "1 hour"), "ema", rocksdb=True).collect()}
    want = {}
    for symbol in ("hot", "b"):
        y = None
        for _, i, v in sorted((t, i, v) for _, s, t, i, v in rows if s == symbol):
            y = v if y is None else v / 3 + y * 2 / 3
            want[symbol, i] = y
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
