"""First-touch searches and extremes over long bar series by equi-joins on a summary tree.

Bars are grouped into nodes of 64; a node's row holds its children's highs and lows, and so on
upwards. A search climbs from its start until some later sibling reaches the level, then descends to
the first bar that does: a few equi-joins, whatever the distance to the hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.ordered import running

FAN = 64


def summary_tree(bars: DataFrame, keys: list[str], longest: int | None = None) -> list[DataFrame]:
    """Levels of (keys, node, children[at, hi, lo]) until one node spans the longest series."""
    if longest is None:
        longest = bars.agg(F.max("bar_idx")).first()[0] or 0
    depth, span = 1, FAN
    while span <= longest:
        depth, span = depth + 1, span * FAN
    child = bars.select(*keys, F.col("bar_idx").alias("at"), F.col("high").alias("hi"), F.col("low").alias("lo"))
    levels = []
    for _ in range(depth):
        node = child.groupBy(*keys, F.floor(F.col("at") / FAN).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("at", "hi", "lo"))).alias("children")
        )
        levels.append(node)
        child = node.select(
            *keys,
            F.col("node").alias("at"),
            F.array_max(F.transform("children", lambda c: c.hi)).alias("hi"),
            F.array_min(F.transform("children", lambda c: c.lo)).alias("lo"),
        )
    return levels


def _visit(df: DataFrame, level: DataFrame, keys: list[str], node: Column) -> DataFrame:
    return df.withColumn("node", node).join(level, [*keys, "node"], "left").drop("node")


def first_touch(
    df: DataFrame, tree: list[DataFrame], keys: list[str], start: Column, level: Column, up: Column, name: str
) -> DataFrame:
    """First bar from ``start`` on whose high (``up``) or low reaches ``level``; NULL if none or no start."""

    def earliest(since: Column | None) -> Column:
        def touches(c):
            hit = F.when(F.col("_up"), c.hi >= F.col("_level")).otherwise(c.lo <= F.col("_level"))
            return hit if since is None else (c["at"] >= since) & hit

        return F.get(F.filter("children", touches), F.lit(0))["at"]

    out = df.withColumns(
        {"_level": level, "_up": up, "_at": start, "_hit": F.lit(None).cast("bigint"), "_depth": F.lit(None).cast("int")}
    )
    for depth, nodes in enumerate(tree):
        out = _visit(out, nodes, keys, F.coalesce(F.floor(F.col("_at") / FAN), F.lit(0).cast("bigint")))
        hit = F.when(F.col("_hit").isNull() & F.col("_at").isNotNull(), earliest(F.col("_at")))
        out = out.withColumn("_found", hit).withColumns(
            {
                "_hit": F.coalesce("_hit", "_found"),
                "_depth": F.coalesce("_depth", F.when(F.col("_found").isNotNull(), F.lit(depth))),
                "_at": F.floor(F.col("_at") / FAN) + 1,
            }
        ).drop("children")
    for depth in range(len(tree) - 1, 0, -1):
        out = _visit(out, tree[depth - 1], keys, F.coalesce("_hit", F.lit(0).cast("bigint")))
        deeper = F.when(F.col("_depth") >= depth, earliest(None)).otherwise(F.col("_hit"))
        out = out.withColumn("_hit", deeper).drop("children")
    return out.withColumnRenamed("_hit", name).drop("_level", "_up", "_at", "_depth", "_found")


def range_extremes(
    df: DataFrame, tree: list[DataFrame], keys: list[str], first: Column, last: Column, high: str, low: str
) -> DataFrame:
    """Highest high and lowest low over bars first..last."""
    out = df.withColumns({"_a": first, "_b": last, high: F.lit(None).cast("double"), low: F.lit(None).cast("double")})

    def gather(frame: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
        frame = _visit(frame, nodes, keys, F.coalesce(F.floor(F.col(end) / FAN), F.lit(0).cast("bigint")))
        inside = F.filter("children", lambda c: (c["at"] >= F.col("_a")) & (c["at"] <= F.col("_b")))
        return frame.withColumn("_in", inside).withColumns(
            {
                high: F.greatest(high, F.array_max(F.transform("_in", lambda c: c.hi))),
                low: F.least(low, F.array_min(F.transform("_in", lambda c: c.lo))),
            }
        ).drop("children", "_in")

    for depth, nodes in enumerate(tree):
        out = gather(out, nodes, "_a")
        if depth + 1 < len(tree):
            out = gather(out, nodes, "_b")
        out = out.withColumns({"_a": F.floor(F.col("_a") / FAN) + 1, "_b": F.floor(F.col("_b") / FAN) - 1})
    return out.drop("_a", "_b")


def next_bar_at_hour(bars: DataFrame, hours: list[int], keys: list[str]) -> DataFrame:
    """(keys, entry_bar, tod_exit_hour) -> first bar from there on that starts in that hour."""
    rows = bars.select(*keys, F.col("bar_idx").alias("entry_bar"), F.hour("time").alias("_h"))
    rows = rows.withColumn("tod_exit_hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    due = F.when(F.col("_h") == F.col("tod_exit_hour"), F.col("entry_bar"))
    block = [F.floor(F.col("entry_bar") / 4096)]
    out = running(rows, [*keys, "tod_exit_hour"], ["entry_bar"], block, mins={"hour_bar": due}, reverse=True)
    return out.drop("_h")
