"""Entry signals as predicates over indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.clock import session_ok
from tradeloom.operators.ordered import rolling


def reversal(z: Column, z_prev: Column, band: Column) -> tuple[Column, Column]:
    """(long, short): the score comes back through the lower or the upper band."""
    return (z_prev <= -band) & (z > -band), (z_prev >= band) & (z < band)


def crossover(up: Column, down: Column, z: Column | None = None, band: float | None = None) -> tuple[Column, Column]:
    """(long, short) on a mean crossing; with a band, only from stretched scores."""
    if band is None:
        return up, down
    return up & (z <= -band), down & (z >= band)


def with_trend(sides: tuple[Column, Column], fast: Column, slow: Column) -> tuple[Column, Column]:
    return sides[0] & (fast > slow), sides[1] & (fast < slow)


def gated(sides: tuple[Column, Column], *gates: Column) -> tuple[Column, Column]:
    """Both sides kept only where every gate is true; an unknown gate closes."""
    long, short = sides
    for gate in gates:
        long, short = long & gate, short & gate
    return long, short


def fading(z: Column, z_prev: Column) -> Column:
    """The score's size is shrinking."""
    return F.abs(z) < F.abs(z_prev)


def volume_gate(volume_z: Column, least: Column) -> Column:
    return (least <= 0) | (volume_z >= least)


def regime_gate(rank: Column, low: float, high: float) -> Column:
    return rank.between(low, high)


def session_gate(time: Column, mode: Column) -> Column:
    return session_ok(F.hour(time), mode)


def encode(sides: tuple[Column, Column]) -> Column:
    """-1, 1 or 0; short wins where both hold."""
    long, short = sides
    return F.when(short, -1).when(long, 1).otherwise(0).cast("tinyint")


def delay(bars: DataFrame, by: int, keys: list[str] | None = None) -> DataFrame:
    """Move every signal ``by`` bars later; the first bars get 0."""

    def build(frame, w):
        return frame.withColumn("signal", F.lag("signal", by, 0).over(w).cast("tinyint"))

    return rolling(bars, keys or ["symbol"], "bar_idx", build, back=by) if by else bars
