"""One position at a time: keep each candidate that starts once the last kept one is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.ordered import running
from tradeloom.session import materialise

BARS_PER_BLOCK = 4096


def select_non_overlapping(
    cands: DataFrame, keys: list[str], start: str = "signal_bar", free: str = "free_at", longest_fold: int = 512
) -> DataFrame:
    """Keep the first candidate per key, then the first with ``start >= free`` of the last kept, and so on.

    A candidate that starts after every earlier one is over is kept whatever happened before it, so
    these points cut a key into independent runs. Short runs are folded in place; a run longer than
    ``longest_fold`` is followed by pointer doubling, which needs no ordered pass over the run.
    """
    block = [F.floor(F.col(start) / BARS_PER_BLOCK)]
    rows = running(cands, keys, [start], block, maxes={"_busy": F.col(free)}, exclusive=True)
    opens = F.col("_busy").isNull() | (F.col(start) >= F.col("_busy"))
    rows = running(rows, keys, [start], block, maxes={"_run": F.when(opens, F.col(start))}).drop("_busy")
    rows = materialise(rows, "runs")
    sizes = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_size"))
    longest = sizes.agg(F.max("_size")).first()[0] or 0
    if longest <= longest_fold:
        return _fold(rows, [*keys, "_run"], start, free, cands.columns)
    sized = rows.join(sizes, [*keys, "_run"])
    short = sized.filter(F.col("_size") <= longest_fold).drop("_size")
    long = sized.filter(F.col("_size") > longest_fold).drop("_size")
    kept = _fold(short, [*keys, "_run"], start, free, cands.columns)
    return kept.unionByName(_double(long, [*keys, "_run"], start, free).select(*cands.columns))


def _fold(rows: DataFrame, keys: list[str], start: str, free: str, columns: list[str]) -> DataFrame:
    """Walk each bounded run in order inside the engine."""
    rest = [c for c in columns if c not in (*keys, start, free)]
    item = F.struct(F.col(start).alias("_s"), F.col(free).alias("_f"), F.struct(*rest).alias("_row") if rest else F.lit(0).alias("_row"))
    runs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = f"array<{rows.select(item.alias('i')).schema['i'].dataType.simpleString()}>"
    begin = F.struct(F.lit(None).cast("bigint").alias("busy"), F.array().cast(kind).alias("kept"))

    def step(acc, c):
        free_now = acc.busy.isNull() | (c["_s"] >= acc.busy)
        return F.when(
            free_now, F.struct(c["_f"].cast("bigint").alias("busy"), F.concat(acc.kept, F.array(c)).alias("kept"))
        ).otherwise(acc)

    kept = runs.select(*keys, F.inline(F.aggregate("_items", begin, step, lambda acc: acc.kept)))
    picks = [F.col("_s").alias(c) if c == start else F.col("_f").alias(c) if c == free else F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns]
    return kept.select(*picks)


def _double(rows: DataFrame, keys: list[str], start: str, free: str) -> DataFrame:
    """Follow next-candidate pointers from the first of each run, twice as far in every round."""
    starts = rows.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.col(start).cast("bigint").alias("_from"))
    asks = rows.select(*keys, F.col(free).alias("_at"), F.lit(0).alias("_kind"), F.col(start).cast("bigint").alias("_from"))
    block = [F.floor(F.col("_at") / BARS_PER_BLOCK)]
    own = F.when(F.col("_kind") == 1, F.col("_from"))
    seen = running(starts.unionByName(asks), keys, ["_at", "_kind"], block, mins={"_to": own}, reverse=True)
    jump = seen.filter((F.col("_kind") == 0) & F.col("_to").isNotNull()).select(*keys, "_from", "_to")
    jump = materialise(jump, "pointers")
    marked = rows.groupBy(*keys).agg(F.min(start).cast("bigint").alias("_from"))
    while True:
        marked = materialise(marked, "kept")
        step = marked.join(jump, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))
        if step.isEmpty():
            break
        marked = marked.unionByName(step)
        far = jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jump = materialise(jump.join(far, [*keys, "_to"]).select(*keys, "_from", F.col("_next").alias("_to")), "pointers")
    return rows.join(marked.withColumnRenamed("_from", start), [*keys, start], "left_semi")
