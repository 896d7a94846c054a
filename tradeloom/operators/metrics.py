"""Performance statistics of trade tables, per combo or any other key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.maths import safe_div
from tradeloom.operators.ordered import average_rank, equity_curve, many_quantiles, running
from tradeloom.operators.trades import START_EQUITY
from tradeloom.session import materialise

# Walk-forward gates, training span and caps.
TRAIN_YEARS = 5.8056
WINDOWS = 5
MIN_WINDOW_TRADES = 30
MIN_VALID_WINDOWS = 4
MIN_TRADES = 500
PROFIT_FACTOR_CAP = 100.0
MIN_DRAWDOWN = 0.01
COST = 5.0


def sharpe(x: Column) -> Column:
    """Mean over sample deviation of an aggregated column; 0 for fewer than two rows or no spread."""
    return F.coalesce(safe_div(F.avg(x), F.stddev_samp(x)), F.lit(0.0))


def annual_sharpe(x: Column, years: float | Column) -> Column:
    return sharpe(x) * F.sqrt(F.count(x) / years)


def profit_factor(x: Column) -> Column:
    """Wins over losses, capped; the cap itself when nothing was lost."""
    won = F.sum(F.when(x > 0, x).otherwise(0.0))
    lost = F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
    return F.when(lost == 0, PROFIT_FACTOR_CAP).otherwise(F.least(safe_div(won, lost), F.lit(PROFIT_FACTOR_CAP)))


def trade_metrics(df: DataFrame, keys: list[str], pnl: str = "net_pnl", start: float = START_EQUITY) -> DataFrame:
    """Order-free metrics: counts, rates, totals, means, deviation, Sharpe and profit factor."""
    x = F.col(pnl)
    total = F.sum(x)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg("win").alias("win_rate"),
        total.alias("total_return_dollars"),
        (total / start * 100.0).alias("total_return_pct"),
        (total + start).alias("final_equity"),
        F.avg(x).alias("avg_trade_pnl"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std_trade_pnl"),
        F.avg("r_multiple").alias("avg_r_multiple"),
        sharpe(x).alias("sharpe_ratio"),
        profit_factor(x).alias("profit_factor"),
    )


def max_drawdown(
    df: DataFrame, keys: list[str], order: list[str], block: list[Column], pnl: str, start: float, start_is_peak: bool = True
) -> DataFrame:
    """Deepest fall from a running peak, in percent of the peak and in units of ``pnl``."""
    curve = equity_curve(df, keys, order, block, F.col(pnl), start, start_is_peak)
    fall = F.col("peak") - F.col("equity")
    return curve.groupBy(*keys).agg(
        (F.max(F.coalesce(safe_div(fall, F.col("peak")), F.lit(0.0))) * 100.0).alias("max_drawdown_pct"),
        F.max(fall).alias("max_drawdown_dollars"),
    )


def losing_streak(df: DataFrame, keys: list[str], order: list[str], block: list[Column], win: str = "win") -> DataFrame:
    """Longest run of losses: rows between two wins share the running count of wins."""
    runs = running(df, keys, order, block, sums={"_wins": F.col(win)})
    lengths = runs.groupBy(*keys, "_wins").agg(F.count_if(F.col(win) == 0).alias("_len"))
    return lengths.groupBy(*keys).agg(F.max("_len").alias("max_consecutive_losses"))


def full_metrics(df: DataFrame, keys: list[str], order: list[str], block: list[Column]) -> DataFrame:
    """All metrics of one combo, the ordered ones included."""
    out = trade_metrics(df, keys)
    median = many_quantiles(df, keys, {"median_r_multiple": (F.col("r_multiple"), 0.5)})
    for part in (median, max_drawdown(df, keys, order, block, "net_pnl", START_EQUITY), losing_streak(df, keys, order, block)):
        out = out.join(part, keys)
    return out.withColumn("calmar_ratio", calmar(F.col("total_return_pct"), F.col("max_drawdown_pct")))


def calmar(return_pct: Column, drawdown_pct: Column) -> Column:
    return return_pct / F.greatest(drawdown_pct, F.lit(MIN_DRAWDOWN))


def partial_moments(df: DataFrame, keys: list[str], batch: list[Column], x: str) -> DataFrame:
    """Count, mean and squared deviation of each batch."""
    return df.groupBy(*keys, *batch).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")
    )


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Batch moments combined into the mean and sample deviation of the whole.

    The spread adds each batch's own to that of its mean around the whole mean, so a mean far from 0 cancels nothing.
    """
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    out = parts.join(whole, keys).groupBy(*keys).agg(
        F.max("_all").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("_spread")
    )
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_spread") / F.nullif(F.col("n") - 1, F.lit(0))))
    return out.withColumn("std", std).drop("_spread")


def moments_from_sums(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean and sample deviation from a count, a sum and a sum of squares."""
    n, s, ss = F.count(x), F.sum(x), F.sum(F.col(x) * F.col(x))
    var = (ss - s * s / n) / F.nullif(n - 1, F.lit(0))
    return df.groupBy(*keys).agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def slice_number(seq: Column, n: Column, slices: int) -> Column:
    """Equal ordinal slices: slice i starts at floor(i * n / slices)."""
    return sum(((seq >= F.floor(n * i / slices)).cast("int") for i in range(1, slices)), F.lit(0))


def walk_forward(
    df: DataFrame,
    keys: list[str],
    net: Column,
    years: float = TRAIN_YEARS,
    min_trades: int = MIN_TRADES,
    min_window: int = MIN_WINDOW_TRADES,
    min_valid: int = MIN_VALID_WINDOWS,
    windows: int = WINDOWS,
    seq: str = "seq",
    count: str = "n_combo",
) -> DataFrame:
    """Median, deviation and robust value of annual Sharpe ratios over ordinal windows."""
    rows = df.filter(F.col(count) >= min_trades).withColumns(
        {"_net": net, "_window": slice_number(F.col(seq), F.col(count), windows)}
    )
    n = F.count(F.lit(1))
    per = rows.groupBy(*keys, "_window").agg(
        n.alias("_n"),
        (safe_div(F.avg("_net"), F.stddev_samp("_net")) * F.sqrt(n * windows / years)).alias("_sharpe"),
    )
    per = per.filter((F.col("_n") >= min_window) & F.col("_sharpe").isNotNull())
    median = F.percentile("_sharpe", F.lit(0.5))  # at most `windows` values per key
    spread = F.coalesce(F.stddev_samp("_sharpe"), F.lit(0.0))
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid_windows"), median.alias("median_wf_sharpe"), spread.alias("std_wf_sharpe"),
        (median - spread * 0.5).alias("robust_sharpe"),
    )
    return out.filter(F.col("n_valid_windows") >= min_valid)


def audit_columns(df: DataFrame, keys: list[str], years: float = TRAIN_YEARS) -> DataFrame:
    """Per-combo audit facts; never inputs of a model, hence the prefix."""
    gross, net = F.col("gross_pnl"), F.col("gross_pnl") - COST
    edge = F.avg(gross)
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("audit_n_trades"),
        annual_sharpe(net, years).alias("audit_full_net_sharpe"),
        annual_sharpe(gross, years).alias("audit_full_gross_sharpe"),
        F.avg("win").alias("audit_gross_win_rate"),
        F.when(edge > 0, F.lit(COST) / F.greatest(edge, F.lit(1e-6))).alias("audit_cost_as_pct_of_edge"),
    )
    basic = basic.withColumn("audit_gross_net_gap", F.col("audit_full_gross_sharpe") - F.col("audit_full_net_sharpe"))
    ratio = F.coalesce(safe_div(F.col("mfe_pts"), F.abs(F.col("mae_pts"))), F.lit(0.0))
    wanted = {
        "audit_median_stop_pts": (F.col("stop_pts"), 0.5),
        "audit_median_hold_bars": (F.col("hold_bars"), 0.5),
        "audit_p90_hold_bars": (F.col("hold_bars"), 0.9),
        "audit_median_mfe_pts": (F.col("mfe_pts"), 0.5),
        "audit_median_mae_pts": (F.col("mae_pts"), 0.5),
        "audit_median_mfe_mae_ratio": (ratio, 0.5),
        "audit_zscore_entry_median_abs": (F.abs(F.col("zscore_entry")), 0.5),
    }
    return basic.join(many_quantiles(df, keys, wanted), keys)


def early_late(
    df: DataFrame, keys: list[str], block: list[Column], share: float = 0.8, risk: float = 500.0, seq: str = "seq", count: str = "n_combo"
) -> DataFrame:
    """Slice aggregates of the first ``share`` of trades and of the rest, sized at a fixed risk."""
    part = F.when(F.col(seq) < F.floor(F.col(count) * share), "early").otherwise("late")
    rows = df.withColumns({"_part": part, "_pnl": F.col("r_multiple") * risk})
    by = [*keys, "_part"]
    x = F.col("_pnl")
    won, lost = F.sum(F.when(x > 0, x).otherwise(0.0)), -F.sum(F.when(x < 0, x).otherwise(0.0))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("win").alias("wr"),
        F.avg("r_multiple").alias("avg_r"),
        sharpe(F.col("r_multiple")).alias("sharpe"),
        F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).alias("pf"),
        F.sum(x).alias("total_pnl"),
    )
    falls = max_drawdown(rows, by, [seq], block, "_pnl", 0.0, start_is_peak=False)
    stats = stats.join(falls.select(*by, F.col("max_drawdown_dollars").alias("max_dd")), by)
    names = ["n", "wr", "avg_r", "sharpe", "pf", "total_pnl", "max_dd"]
    picks = [F.max(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("early", "late") for c in names]
    return stats.groupBy(*keys).agg(*picks)


def composites(df: DataFrame) -> DataFrame:
    """Nine candidate scores from the early-slice aggregates; NULL where a part is, as the profit factor without losses."""
    c = lambda name: F.col(f"early_{name}")
    log_n, root_n, root_dd = F.log1p(c("n")), F.sqrt(c("n")), F.sqrt(c("max_dd"))
    return df.withColumns(
        {
            "C1_sharpe_log_n": c("sharpe") * log_n,
            "C2_avg_r_root_n": c("avg_r") * root_n,
            "C3_avg_r_n": c("avg_r") * c("n"),
            "C4_pf_log_n": F.when(c("pf").isNotNull(), F.least(F.greatest(c("pf"), F.lit(0.0)), F.lit(10.0)) * log_n),
            "C5_sharpe": c("sharpe"),
            "C6_avg_r": c("avg_r"),
            "C7_wr_edge_root_n": (c("wr") - 0.5) * root_n,
            "C8_pnl_minus_dd": c("total_pnl") - c("max_dd"),
            "C9_return_per_dd": safe_div(c("avg_r"), root_dd),
        }
    )


COMPOSITES = [
    "C1_sharpe_log_n", "C2_avg_r_root_n", "C3_avg_r_n", "C4_pf_log_n", "C5_sharpe", "C6_avg_r",
    "C7_wr_edge_root_n", "C8_pnl_minus_dd", "C9_return_per_dd",
]


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*ids, F.inline(F.array(*entries)))


def spearman(df: DataFrame, keys: list[str], row_id: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation per key over complete pairs; NULL below ``least`` pairs.

    ``row_id`` with the keys identifies a pair; both sides are ranked in one pass.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    long = melt(pairs, [*keys, *row_id], [x, y], "_side", "_value")
    ranked = average_rank(long, [*keys, "_side"], "_value", "_rank")
    side = lambda c: F.max(F.when(F.col("_side") == c, F.col("_rank")))
    both = ranked.groupBy(*keys, *row_id).agg(side(x).alias("_rx"), side(y).alias("_ry"))
    flat = (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    n = F.count(F.lit(1))
    return both.groupBy(*keys).agg(n.alias("n_pairs"), F.when((n >= least) & flat, F.corr("_rx", "_ry")).alias("rho"))


def spearman_table(df: DataFrame, row_id: str, scores: list[str], truths: list[str]) -> DataFrame:
    """Rank correlation of every score with every truth; the score table is written once and reused."""
    df = materialise(df.select(row_id, *scores, *truths), "scores")
    long = melt(df, [row_id, *truths], scores, "score", "_x")
    long = melt(long, [row_id, "score", "_x"], truths, "truth", "_y")
    return spearman(long, ["score", "truth"], [row_id], "_x", "_y")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column> over the whole table; NULLs stay NULL, a column without spread scores 0."""
    facts = df.agg(F.struct(*[f(c).alias(f"{t}_{c}") for c in columns for t, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("f"))
    out = df.withColumn("_facts", facts.scalar())
    z = {}
    for c in columns:
        sd = F.col(f"_facts.s_{c}")
        z[f"z_{c}"] = F.when(sd == 0, F.col(c) * 0).otherwise((F.col(c) - F.col(f"_facts.m_{c}")) / F.nullif(sd, F.lit(0.0)))
    return out.withColumns(z).drop("_facts")


def welch(df: DataFrame, keys: list[str], arm: str, a: str, b: str, x: str, least: int = 50, gate: float = 2.0) -> DataFrame:
    """Welch's t between two arms per key, NULL with too few rows or no variance."""
    side = lambda v, f: f(F.when(F.col(arm) == v, F.col(x)))
    out = df.groupBy(*keys).agg(
        side(a, F.count).alias("n_a"), side(b, F.count).alias("n_b"), side(a, F.avg).alias("mean_a"), side(b, F.avg).alias("mean_b"),
        side(a, F.var_samp).alias("var_a"), side(b, F.var_samp).alias("var_b"),
    )
    short = (F.col("n_a") < least) | (F.col("n_b") < least)
    error = F.sqrt(F.col("var_a") / F.nullif(F.col("n_a"), F.lit(0)) + F.col("var_b") / F.nullif(F.col("n_b"), F.lit(0)))
    t = F.when(~short, safe_div(F.col("mean_a") - F.col("mean_b"), error))
    return out.withColumns({"welch_t": t, "insufficient_n": short}).withColumn("gate_pass", F.coalesce(F.col("welch_t") >= gate, F.lit(False)))


def variance_split(df: DataFrame, group: str, x: str, least: int = 50) -> DataFrame:
    """Spread within groups against spread between group means, over groups of enough rows."""
    groups = df.groupBy(group).agg(F.count(x).alias("_n"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_var")).filter(F.col("_n") >= least)
    out = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.stddev_pop("_mean").alias("between_std"),
        F.sqrt(F.sum(F.col("_var") * F.col("_n")) / F.sum("_n")).alias("within_std"),
    )
    ratio = F.when(F.col("between_std") > 1e-9, F.col("within_std") / F.col("between_std"))
    verdict = F.when(ratio.isNull() | (ratio >= 1.0), "dynamic").when(ratio >= 0.3, "partial").otherwise("identity_proxy")
    return out.withColumns({"ratio": ratio, "verdict": verdict})


def sharpe_interval(ratio: Column, years: Column | float, per_year: Column) -> tuple[Column, Column, Column]:
    """Standard error of an annual Sharpe ratio and its 95 % interval."""
    trades = per_year * years
    error = F.sqrt(per_year / trades * (1.0 + ratio * ratio / (per_year * 2.0)))
    return error, ratio - error * 1.96, ratio + error * 1.96


def gates(sharpe_: Column, n: Column, dollars: Column, least_sharpe: float, least_n: int, least_dollars: float) -> dict[str, Column]:
    """The three parts of the gate and their conjunction."""
    parts = {"ok_sharpe": sharpe_ >= least_sharpe, "ok_n": n >= least_n, "ok_dollars": dollars >= least_dollars}
    return {**parts, "gate_pass": parts["ok_sharpe"] & parts["ok_n"] & parts["ok_dollars"]}
