"""Trade features, target-ratio expansion and expected-value filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.maths import safe_div
from tradeloom.operators.metrics import sharpe
from tradeloom.operators.ordered import quantiles, rolling, running
from tradeloom.operators.trades import DOLLARS_PER_POINT, START_EQUITY, contracts

# Target ratios 1.0 to 5.0 in steps of a quarter; history mark; filter grid and guards.
RR_LEVELS = [1.0 + 0.25 * i for i in range(17)]
HISTORY_POSITION = 25
EV_THRESHOLDS = [round(-0.5 + 0.05 * i, 2) for i in range(21)]
MIN_FILTERED_TRADES = 20
SHARPE_LIMIT = 5.0
RISK_CAP = 0.05


def lagged_outcomes(df: DataFrame, keys: list[str], seq: str = "seq", win: str = "win", r: str = "r_multiple") -> DataFrame:
    """Rates and means over the trades before each one, with defaults while history is short."""

    def build(frame, w):
        def prior(x, n, least, default):
            past = w.rowsBetween(-n, -1)
            return F.coalesce(F.when(F.count(x).over(past) >= least, F.avg(x).over(past)), F.lit(default))

        return frame.withColumns(
            {
                "prior_wr_10": prior(win, 10, 3, 0.5),
                "prior_wr_50": prior(win, 50, 10, 0.5),
                "prior_r_ma10": prior(r, 10, 3, 0.0),
            }
        )

    out = rolling(df, keys, seq, build, back=50)
    return out.withColumn("has_history_50", (F.col(seq) >= HISTORY_POSITION).cast("tinyint"))


def recency(df: DataFrame, keys: list[str], seq: str = "seq", bar: str = "entry_bar") -> DataFrame:
    """Bars since the previous trade, -1 for the first, and its logarithm."""

    def build(frame, w):
        gap = F.coalesce(F.col(bar) - F.lag(bar).over(w), F.lit(-1))
        return frame.withColumn("bars_since_last", gap)

    out = rolling(df, keys, seq, build, back=1)
    gap = F.col("bars_since_last")
    return out.withColumn("log_bars_since_last", F.when(gap < 0, F.lit(-1.0)).otherwise(F.log1p(F.greatest(gap, F.lit(0)))))


def unsorted_rows(df: DataFrame, keys: list[str], seq: str, bar: str) -> DataFrame:
    """Per key, rows that lie before their predecessor."""

    def build(frame, w):
        return frame.withColumn("_back", (F.col(bar) < F.lag(bar).over(w)).cast("int"))

    out = rolling(df, keys, seq, build, back=1)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("_back"), F.lit(0)).alias("n_unsorted"))


def reaches(rr: Column) -> Column:
    """Whether a trade's best excursion reaches a target ratio."""
    return F.col("mfe_pts") >= rr * F.col("stop_pts")


def expand_levels(df: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """One row per trade and target ratio, with whether its best excursion reaches the target."""
    out = df.withColumn("candidate_rr", F.explode(F.array(*[F.lit(x) for x in levels or RR_LEVELS])))
    return out.withColumn("would_win", reaches(F.col("candidate_rr")).cast("tinyint"))


def expected_r(p: Column, rr: Column) -> Column:
    return p * rr - (1.0 - p)


def best_level(p_of, levels: list[float] | None = None) -> Column:
    """struct(rr, ev) of the ratio with the highest expected R, the lowest ratio on ties.

    ``p_of(rr)`` is the win probability at a ratio. Evaluated within the row: no expansion, no shuffle.
    """
    choices = F.transform(
        F.array(*[F.lit(x) for x in levels or RR_LEVELS]),
        lambda rr: F.struct(F.round(expected_r(p_of(rr), rr), 9).alias("ev"), (-rr).alias("minus")),
    )
    best = F.array_max(choices)
    return F.struct((-best["minus"]).alias("rr"), best["ev"].alias("ev"))


def threshold_sweep(df: DataFrame, keys: list[str], ev: Column, pnl: str, thresholds: list[float] | None = None) -> DataFrame:
    """Metrics of the trades kept at each threshold.

    Rows are summed once per interval between thresholds; the intervals above a threshold are then
    added up, so trades are not repeated per threshold.
    """
    thresholds = thresholds or EV_THRESHOLDS
    bucket = sum(((ev >= t).cast("int") for t in thresholds), F.lit(-1))
    x = F.col(pnl)
    parts = df.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"), F.sum("win").alias("_w")
    )
    total = parts.groupBy(*keys).agg(F.sum("_n").alias("n_all"))
    marks = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    spread = parts.select("*", F.inline(marks)).filter(F.col("_bucket") >= F.col("_i"))
    n, s, ss = F.sum("_n"), F.sum("_s"), F.sum("_ss")
    var = (ss - s * s / n) / F.nullif(n - 1, F.lit(0))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    out = spread.groupBy(*keys, "threshold").agg(
        n.alias("n_trades"),
        (F.sum("_w") / n).alias("win_rate"),
        s.alias("total_pnl"),
        F.coalesce(safe_div(s / n, F.when(std > 1e-9, std)), F.lit(0.0)).alias("sharpe"),
    )
    out = out.join(total, keys)
    return out.withColumn("skip_rate", 1.0 - F.col("n_trades") / F.col("n_all"))


def best_threshold(sweep: DataFrame, keys: list[str], least: int = MIN_FILTERED_TRADES, limit: float | None = None) -> DataFrame:
    """The threshold of the highest Sharpe among those with enough trades; the lowest one on ties."""
    ok = F.col("n_trades") >= least
    if limit is not None:
        ok = ok & (F.col("sharpe") < limit)
    rank = F.when(ok, F.struct(F.round("sharpe", 9).alias("s"), (-F.col("threshold")).alias("t")))
    pick = F.struct("threshold", "n_trades", "sharpe", "total_pnl", "win_rate", "skip_rate")
    best = sweep.groupBy(*keys).agg(F.max_by(pick, rank).alias("best"), F.max(rank).isNotNull().alias("found"))
    return best.select(*keys, "found", *[F.when(F.col("found"), F.col(f"best.{c}")).alias(c) for c in ("threshold", "n_trades", "sharpe", "total_pnl", "win_rate", "skip_rate")])


def threshold_or_zero(sweep: DataFrame, keys: list[str], least: int, limit: float = SHARPE_LIMIT) -> DataFrame:
    """``best_threshold`` with guards; a key without a fitting one falls back to threshold 0."""
    best = best_threshold(sweep, keys, least, limit).select(*keys, "found", "threshold")
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))


def percentile_filter(df: DataFrame, keys: list[str], ev: str, pnl: str, shares: list[int]) -> DataFrame:
    """Metrics of the top share of trades by expected value, one row per key and share."""
    cuts = quantiles(df, keys, ev, {f"_q{s}": 1.0 - s / 100.0 for s in shares})
    rows = df.join(cuts, keys)
    marks = F.array(*[F.struct(F.lit(s).alias("top_pct"), F.col(f"_q{s}").alias("cutoff")) for s in shares])
    kept = rows.select(*keys, ev, pnl, "win", F.inline(marks)).filter(F.col(ev) >= F.col("cutoff"))
    return kept.groupBy(*keys, "top_pct").agg(
        F.max("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("n_trades"), F.avg("win").alias("win_rate"),
        F.sum(pnl).alias("total_pnl"), sharpe(F.col(pnl)).alias("sharpe"),
    )


def net_expected_r(p: Column, rr: Column | float, stop: Column, cost: float) -> Column:
    """Expected R after friction, friction being in units of the risked dollars."""
    rr = rr if isinstance(rr, Column) else F.lit(rr)
    return expected_r(p, rr) - F.lit(cost) / F.greatest(stop * DOLLARS_PER_POINT, F.lit(1e-9))


def kelly_fraction(p: Column, rr: Column | float, cap: float = RISK_CAP) -> Column:
    rr = rr if isinstance(rr, Column) else F.lit(rr)
    return F.greatest(F.lit(0.0), F.least(p - (1.0 - p) / rr, F.lit(cap)))


def kelly_sized(df: DataFrame, p: Column, rr: float) -> DataFrame:
    """Contracts at the Kelly fraction of the starting equity; no contract means a skipped trade."""
    f = kelly_fraction(p, rr)
    lots = contracts(f * START_EQUITY, F.col("stop_pts"))
    return df.withColumns({"kelly": f, "lots": lots, "skipped": (lots <= 0).cast("int")})


def portfolio_equity(df: DataFrame, order: list[str], bar: str = "exit_bar", pnl: str = "pnl", start: float = START_EQUITY,
                     same_bar_trades: bool = True, block: list[Column] | None = None) -> DataFrame:
    """All combos in one account: results arrive at exit bars, in order within a bar.

    Sums are carried from bar to bar; ``block`` splits busy bars further and must rise with ``order``.
    ``same_bar_trades=False`` leaves out trades that enter and exit on one bar.
    """
    rows = df if same_bar_trades else df.filter(F.col("exit_bar") > F.col("entry_bar"))
    out = running(rows, [], [bar, *order], [F.col(bar), *(block or [])], sums={"_sum": F.col(pnl)})
    return out.withColumn("equity_after", F.col("_sum") + start).drop("_sum")


def open_positions(df: DataFrame, keys: list[str], entry: str = "entry_bar", exit_: str = "exit_bar") -> DataFrame:
    """Number of open positions after each bar with an entry or an exit."""
    moves = F.array(F.struct(F.col(entry).alias("bar"), F.lit(1).alias("change")), F.struct(F.col(exit_).alias("bar"), F.lit(-1).alias("change")))
    net = df.select(*keys, F.inline(moves)).groupBy(*keys, "bar").agg(F.sum("change").alias("change"))
    out = running(net, keys, ["bar"], [F.floor(F.col("bar") / 4096)], sums={"n_open": F.col("change")})
    return out.drop("change")


def taken_and_available(df: DataFrame, keys: list[str], taken: Column, pnl: Column) -> DataFrame:
    x = F.when(taken, pnl)
    return df.groupBy(*keys).agg(
        F.count_if(taken).alias("n_taken"), F.count(F.lit(1)).alias("n_available"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum_pnl"),
        F.coalesce(safe_div(F.count_if(x > 0).cast("double"), F.count_if(taken).cast("double")), F.lit(0.0)).alias("win_rate"),
    )


def encoded(df: DataFrame, column: str, values: list[str], index: bool = True) -> DataFrame:
    """0/1 columns per known value, and its position in the list (-1 for an unknown one)."""
    c = F.col(column)
    cols = {f"{column}_{v}": (c == v).cast("tinyint") for v in values}
    if index:
        cols[f"{column}_index"] = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1, F.lit(-1)).cast("int")
    return df.withColumns(cols)


def friction_features(df: DataFrame, tight: float = 5.0) -> DataFrame:
    """Friction as a share of the risk, and a flag for tight stops."""
    return df.withColumns(
        {"friction_pct": F.lit(2.5) / F.greatest(F.col("stop_pts"), F.lit(1e-6)), "tight_stop": (F.col("stop_pts") < tight).cast("tinyint")}
    )
