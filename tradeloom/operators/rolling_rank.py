"""Rank of each value among the last n, at a cost of n log n per block whatever the window.

A block of positions borrows the rows its windows reach back to. Its values become ranks, and the block is sorted bit by
bit from the highest down (a wavelet matrix); a window then follows one path through the bits, which counts the values
below its own and equal to it. All windows of a block move one bit at a time together, as array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.functions.maths import probit
from tradeloom.operators.ordered import ROWS_PER_BLOCK


def counts_in_windows(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many of the last ``n`` values up to it are below and equal to its own; early windows are short."""
    _, code = np.unique(x, return_inverse=True)
    end = np.arange(1, len(x) + 1)
    start = np.maximum(0, end - n)
    below, values, wanted = np.zeros(len(x), np.int64), code.astype(np.int64), code.astype(np.int64)
    for bit in range(int(code.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (values >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - ones)))
        high = ((wanted >> bit) & 1).astype(bool)
        low_start, low_end = zeros[start], zeros[end]
        below += np.where(high, low_end - low_start, 0)
        start = np.where(high, zeros[-1] + start - low_start, low_start)
        end = np.where(high, zeros[-1] + end - low_end, low_end)
        values = np.concatenate((values[ones == 0], values[ones == 1]))
    return below, end - start


def rolling_rank(df: DataFrame, keys: list[str], pos: str, x: str, n: int, name: str, size: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with ``name``: the rank of ``x`` among its key's last ``n`` rows by ``pos``, ties averaged, from 1.

    NULL where the window is short or holds an unknown value. Positions are dense and distinct per key. A key of any length is
    cut into blocks of ``size`` positions, or ``n`` if that is more.
    """
    size = max(size, n)
    home = F.floor(F.col(pos) / size)
    homes = F.array(home, F.when((F.col(pos) - home * size) > size - n, home + 1))
    rows = df.withColumns({"_home": home, "_block": F.explode(F.array_compact(homes))})
    columns = df.columns
    schema = T.StructType([*df.schema, T.StructField(name, T.DoubleType())])

    def ranks(block: pa.Table) -> pa.Table:
        block = block.sort_by(pos).combine_chunks()
        column = block[x]
        known = column.is_valid().to_numpy()
        values = np.where(known, column.cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0)
        below, equal = counts_in_windows(values, n)
        seen = np.concatenate(([0], np.cumsum(known)))
        end = np.arange(1, len(values) + 1)
        full = seen[end] - seen[np.maximum(0, end - n)] == n
        rank = pa.array(below + (equal + 1) / 2.0, mask=~full)
        own = block["_home"].to_numpy() == block["_block"].to_numpy()
        return block.select(columns).append_column(name, rank).filter(pa.array(own))

    return rows.groupBy(*keys, "_block").applyInArrow(ranks, schema)


def mid_share(rank: Column, n: int) -> Column:
    return (rank - 0.5) / n


def rank_score(rank: Column, n: int) -> Column:
    """Normal score of the mid-rank, scaled so that the largest possible score is 3."""
    return probit(mid_share(rank, n)) * (F.lit(3.0) / probit(F.lit((n - 0.5) / n)))
