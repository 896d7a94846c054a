"""Ranks, top-k selection, baskets, pools and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.maths import hash_draw, hash_uniform, safe_div
from tradeloom.operators.metrics import COST, TRAIN_YEARS, melt, sharpe
from tradeloom.operators.ordered import average_rank, default_splits, place_in, quantiles, with_position
from tradeloom.session import materialise

# Metric weights of the composite score.
COMPOSITE_WEIGHTS = {"sharpe_ratio": 0.4, "total_return_pct": 0.3, "profit_factor": 0.15, "max_drawdown_pct": 0.15}


def composite_score(
    df: DataFrame, key: str, weights: dict[str, float] | None = None, inverted: tuple[str, ...] = ("max_drawdown_pct",)
) -> DataFrame:
    """(key, composite_score): weighted sum of rank shares, NULLs ranked last; inverted metrics count down.

    All metrics are ranked in one pass over (key, metric, value) rows.
    """
    weights = weights or COMPOSITE_WEIGHTS
    df = materialise(df.select(key, *weights), "metrics")
    long = melt(df, [key], list(weights), "metric", "value")
    ranked = average_rank(long, ["metric"], "value", "_rank", nulls_last=True)
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    share = ranked.withColumn("_total", total).withColumn("_share", F.col("_rank") / F.col("_total"))
    part = F.when(F.col("metric").isin(*inverted), 1.0 - F.col("_share")).otherwise(F.col("_share"))
    return share.groupBy(key).agg(F.sum(part * table[F.col("metric")]).alias("composite_score"))


def top_k(df: DataFrame, score: str, k: int, tie: str, least_trades: int = 0) -> DataFrame:
    """The k best rows that pass the trade-count gate: one bounded heap per task, then a merge."""
    rows = df.filter(F.col("n_trades") >= least_trades) if least_trades else df
    return rows.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def top_per_group(df: DataFrame, groups: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows per group; Spark prunes each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(F.col("rank_in_group") <= k)


def upper_bound_score(p10: Column, p50: Column, p90: Column, kappa: float = 1.0) -> Column:
    return p50 + (p90 - p10) * (kappa / 2.0)


def rank_of(df: DataFrame, key: str, score: str) -> DataFrame:
    """Rank and percentile of every row by descending score, ties by key."""
    splits = default_splits(df)
    rows = df.withColumn("_down", -F.col(score))
    edges = rows.agg(F.percentile_approx("_down", [i / splits for i in range(1, splits)], 10 * splits)).scalar()
    rows = rows.withColumn("_edges", edges)
    bucket = place_in(F.col("_edges"), F.col("_down"), splits)
    out = with_position(rows, [], ["_down", key], [bucket], "_pos", "_total")
    return out.withColumns({"rank": F.col("_pos") + 1, "percentile": 1.0 - F.col("_pos") / F.col("_total")}).drop(
        "_pos", "_total", "_edges", "_down"
    )


def jaccard_matrix(baskets: DataFrame, basket: str, member: str) -> DataFrame:
    """Overlap of every pair of top-k baskets.

    Baskets are few (one per ranker or arm) and bounded by k, so each is one array and all of them
    fit into one row.
    """
    sets = baskets.groupBy(F.col(basket).alias("basket_a")).agg(F.collect_set(member).alias("_set"))
    book = sets.agg(F.collect_list(F.struct(F.col("basket_a").alias("basket_b"), F.col("_set").alias("_other")))).scalar()
    pairs = sets.withColumn("_book", book).select("basket_a", "_set", F.inline("_book"))
    both = F.size(F.array_intersect("_set", "_other"))
    either = F.size(F.array_union("_set", "_other"))
    return pairs.select("basket_a", "basket_b", both.alias("n_shared"), F.coalesce(safe_div(both, either), F.lit(0.0)).alias("jaccard"))


def basket_difference(df: DataFrame, member: str, in_left: Column, in_right: Column, least: int) -> DataFrame:
    """Members with at least ``least`` rows in exactly one of two baskets, with its side; one count per member and no join of rows."""
    sizes = df.filter(F.col(member).isNotNull()).groupBy(member).agg(F.count_if(in_left).alias("_a"), F.count_if(in_right).alias("_b"))
    a, b = F.col("_a") >= least, F.col("_b") >= least
    return sizes.filter(a != b).select(member, F.when(a, "a").otherwise("b").alias("only_in"))


def stability_arms(df: DataFrame, keys: list[str], gross: str, fractions: list[float], k: int, least: int, years: float = TRAIN_YEARS,
                   seq: str = "seq", count: str = "n_combo") -> DataFrame:
    """Top-k per arm, an arm being the first ``fraction`` of every combo's trades."""
    arms = df.withColumn("arm", F.explode(F.array(*[F.lit(f) for f in fractions])))
    cut = F.rint(F.col(count) * F.col("arm"))
    arms = arms.filter((F.col(seq) < cut) & (cut >= least)).withColumn("_net", F.col(gross) - COST)
    n = F.count(F.lit(1))
    per = arms.groupBy("arm", *keys).agg(n.alias("n_trades"), (sharpe(F.col("_net")) * F.sqrt(n / (F.col("arm") * years))).alias("sharpe"), F.stddev_samp("_net").alias("_sd"))
    per = per.filter(F.col("_sd") > 0).drop("_sd").withColumn("sharpe", F.round("sharpe", 9))
    return top_per_group(per, ["arm"], "sharpe", k, keys[0])


def against_baseline(top: DataFrame, arm: str, baseline, member: str) -> DataFrame:
    """Overlap of each arm's basket with the baseline arm's."""
    pairs = jaccard_matrix(top, arm, member)
    return pairs.filter(F.col("basket_b") == baseline).select(F.col("basket_a").alias(arm), "n_shared", "jaccard")


def union_pool(*pools: DataFrame) -> DataFrame:
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.distinct()


def random_pool(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in a seeded random order."""
    return df.orderBy(hash_draw(seed, F.col(key)), key).limit(k)


def stratified_budgets(df: DataFrame, stratum: str, total: int, cap_share: float = 0.25) -> DataFrame:
    """Rows to take per stratum: its share of ``total`` up to a cap; what caps leave over is split
    evenly among the strata below the cap."""
    cap = int(total * cap_share)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    share = F.least(F.rint(F.col("size") * total / sizes.agg(F.sum("size")).scalar()), F.lit(float(cap))).cast("bigint")
    first = sizes.withColumn("take", share)
    below = F.col("take") < cap
    facts = first.agg(F.struct((F.lit(total) - F.sum("take")).alias("short"), F.count_if(below).alias("open"))).scalar()
    out = first.withColumn("_facts", facts)
    extra = F.when(below & (F.col("_facts.short") > 0), F.floor(F.col("_facts.short") / F.greatest(F.col("_facts.open"), F.lit(1)))).otherwise(0)
    return out.select(stratum, "size", (F.col("take") + extra).alias("budget"))


def stratified_sample(df: DataFrame, stratum: str, key: list[str], total: int, seed: int, cap_share: float = 0.25) -> DataFrame:
    """Seeded sample of each stratum's budget; positions are counted within ranges of the draw."""
    budgets = stratified_budgets(df, stratum, total, cap_share).select(stratum, "budget")
    rows = df.withColumn("_draw", hash_draw(seed, *[F.col(c) for c in key]))
    rows = with_position(rows, [stratum], ["_draw", *key], [F.floor(F.col("_draw") * default_splits(df) / 2**32)], "_pos")
    return rows.join(budgets, stratum).filter(F.col("_pos") < F.col("budget")).drop("_pos", "_draw", "budget")


def bernoulli_sample(df: DataFrame, key: list[str], share: Column | float, seed: int) -> DataFrame:
    return df.filter(hash_uniform(seed, *[F.col(c) for c in key]) < share)


def with_least_rows(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups of at least that size."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return df.join(groups, keys, "left_semi")


def frequency_pools(df: DataFrame, count: str = "n_trades") -> DataFrame:
    """low up to the median, high from the larger of p95 and ten medians, else middle."""
    marks = quantiles(df, [], count, {"p50": 0.5, "p95": 0.95}).select(F.struct(F.floor("p50").alias("p50"), F.floor("p95").alias("p95"))).scalar()
    out = df.withColumn("_m", marks)
    high = F.greatest(F.col("_m.p95"), F.col("_m.p50") * 10)
    return out.withColumn("pool", F.when(F.col(count) >= high, "high").when(F.col(count) <= F.col("_m.p50"), "low").otherwise("middle")).drop("_m")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
