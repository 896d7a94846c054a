"""Trade construction: entries, exits, path extremes, sizing and money columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.maths import clip, safe_div, tick_round
from tradeloom.operators.barriers import first_touch, next_bar_at_hour, range_extremes, summary_tree
from tradeloom.operators.ordered import rolling, running
from tradeloom.operators.selection import select_non_overlapping
from tradeloom.session import materialise

# Account, contract and friction constants.
START_EQUITY = 50_000.0
RISK_SHARE = 0.05
FIXED_RISK = 500.0
DOLLARS_PER_POINT = 2.0
TICK = 0.25
ROUND_TRIP_COST = 5.0
MIN_ADVERSE_POINTS = 0.25

# Exit reason codes.
EXIT_REASONS = {1: "stop", 2: "take_profit", 3: "opposite", 4: "end_of_data", 5: "time"}

SYMBOL = ["symbol"]
CANDIDATE = ["combo_id", "symbol", "signal_bar"]


def price_bars(bars: DataFrame) -> DataFrame:
    """Bars with the next open, NULL on the last bar."""
    return rolling(
        bars, SYMBOL, "bar_idx", lambda f, w: f.withColumn("next_open", F.lead("open").over(w)), ahead=1
    )


def entries(signals: DataFrame, priced: DataFrame) -> DataFrame:
    """Candidates (combo parameters, symbol, bar_idx, signal) entering at the next bar's open."""
    opens = priced.filter(F.col("next_open").isNotNull()).select(*SYMBOL, "bar_idx", F.col("next_open").alias("entry_price"))
    out = signals.filter(F.col("signal") != 0).join(opens, [*SYMBOL, "bar_idx"])
    side = F.col("signal").cast("int")
    return out.withColumnsRenamed({"bar_idx": "signal_bar"}).withColumns(
        {
            "side": side,
            "entry_bar": F.col("signal_bar") + 1,
            "sl_price": F.col("entry_price") - F.col("stop_pts") * side,
            "tp_price": F.col("entry_price") + F.col("stop_pts") * F.col("min_rr") * side,
        }
    ).drop("signal")


def next_opposite(cands: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds ``opposite_bar``: the next bar after the signal with a signal of the other side."""
    rows = signals.filter(F.col("signal") != 0).select("combo_id", *SYMBOL, F.col("bar_idx").alias("signal_bar"), "signal")
    bar = F.col("signal_bar")
    near = running(
        rows,
        ["combo_id", *SYMBOL],
        ["signal_bar"],
        [F.floor(bar / 4096)],
        mins={"_long": F.when(F.col("signal") == 1, bar), "_short": F.when(F.col("signal") == -1, bar)},
        reverse=True,
    )
    other = F.when(F.col("signal") == 1, F.col("_short")).otherwise(F.col("_long"))
    return cands.join(near.select("combo_id", *SYMBOL, "signal_bar", other.alias("opposite_bar")), CANDIDATE)


def resolve_exits(cands: DataFrame, signals: DataFrame, bars: DataFrame, tp_first: bool = True) -> DataFrame:
    """Exit bar, price, reason and path extremes of every candidate, each on its own.

    A candidate's exit depends only on bars after its signal, so all are resolved at once; which of
    them are traded is decided afterwards. Expects per candidate: exit_on_opposite, use_breakeven,
    max_hold_bars, tod_exit_hour, cooldown_bars (0 or false switches a rule off).
    """
    tree = [materialise(level, "tree") for level in summary_tree(bars, SYMBOL)]
    priced = price_bars(bars)
    out = next_opposite(cands, signals)
    hours = [r[0] for r in signals.select("tod_exit_hour").distinct().filter("tod_exit_hour > 0").collect()]
    if hours:
        due = next_bar_at_hour(bars, hours, SYMBOL)
        out = out.join(due, [*SYMBOL, "entry_bar", "tod_exit_hour"], "left")
    else:
        out = out.withColumn("hour_bar", F.lit(None).cast("bigint"))
    lengths = bars.groupBy(*SYMBOL).agg(F.max("bar_idx").alias("last_bar"))
    out = materialise(out.join(lengths, SYMBOL), "asked")  # read twice: by the walk and by what follows it

    long = F.col("side") == 1
    one_r = F.col("entry_price") + F.col("stop_pts") * F.col("side")
    start = F.col("entry_bar")
    searches = [
        F.struct(F.lit("tp").alias("_kind"), F.col("tp_price").alias("_goal"), long.alias("_rising")),
        F.struct(F.lit("sl").alias("_kind"), F.col("sl_price").alias("_goal"), (~long).alias("_rising")),
        F.when(F.col("use_breakeven"), F.struct(F.lit("be").alias("_kind"), one_r.alias("_goal"), long.alias("_rising"))),
    ]
    walk = out.select(*CANDIDATE, "entry_bar", F.inline(F.array_compact(F.array(*searches))))
    walk = first_touch(walk, tree, SYMBOL, start, F.col("_goal"), F.col("_rising"), "_bar")
    touched = walk.groupBy(*CANDIDATE).agg(
        *[F.max(F.when(F.col("_kind") == k, F.col("_bar"))).alias(f"_{k}_bar") for k in ("tp", "sl", "be")]
    )
    out = out.join(touched, CANDIDATE)
    moved = F.col("_be_bar").isNotNull() & (F.col("_sl_bar").isNull() | (F.col("_sl_bar") >= F.col("_be_bar")))
    out = first_touch(out, tree, SYMBOL, F.when(moved, F.col("_be_bar")), F.col("entry_price"), ~long, "_back_bar")

    def leave(bar: Column, rank: int, reason: int, price: Column | None, ok: Column | None = None) -> Column:
        price = F.lit(None).cast("double") if price is None else price
        s = F.struct(bar.cast("bigint").alias("bar"), F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), price.alias("price"))
        return F.when(bar.isNotNull() if ok is None else bar.isNotNull() & ok, s)

    stop_bar = F.when(moved, F.col("_back_bar")).otherwise(F.col("_sl_bar"))
    stop_price = F.when(moved, F.col("entry_price")).otherwise(F.col("sl_price"))
    more = lambda bar: bar < F.col("last_bar")
    held = F.when(F.col("max_hold_bars") > 0, start + F.col("max_hold_bars") - 1)
    exits = [
        leave(F.col("_tp_bar"), 1 if tp_first else 2, 2, F.col("tp_price")),
        leave(stop_bar, 2 if tp_first else 1, 1, stop_price),
        leave(F.col("opposite_bar"), 3, 3, None, F.col("exit_on_opposite") & more(F.col("opposite_bar"))),
        leave(held, 4, 5, None, more(held)),
        leave(F.col("hour_bar"), 5, 5, None, more(F.col("hour_bar"))),
        leave(F.col("last_bar"), 6, 4, None),
    ]
    out = out.withColumn("_exit", F.array_min(F.array_compact(F.array(*exits))))
    out = out.withColumns({"exit_bar": F.col("_exit.bar"), "exit_reason": F.col("_exit.reason"), "_fixed": F.col("_exit.price")})
    fills = priced.select(*SYMBOL, F.col("bar_idx").alias("exit_bar"), F.col("next_open").alias("_next_open"), F.col("close").alias("_close"))
    out = out.join(fills, [*SYMBOL, "exit_bar"])
    filled = F.coalesce("_fixed", F.when(F.col("exit_reason") == 4, F.col("_close")).otherwise(F.col("_next_open")))
    out = range_extremes(out, tree, SYMBOL, start, F.col("exit_bar"), "_high", "_low")
    up, down = F.col("_high") - F.col("entry_price"), F.col("_low") - F.col("entry_price")
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            "exit_price": filled,
            "mfe_pts": F.greatest(zero, F.when(long, up).otherwise(-down)),
            "mae_pts": F.least(zero, F.when(long, down).otherwise(-up)),
            "hold_bars": F.col("exit_bar") - start + 1,
            "free_at": F.greatest(F.col("exit_bar") + 1, F.col("exit_bar") + F.col("cooldown_bars")),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def backtest(cands: DataFrame, signals: DataFrame, bars: DataFrame, tp_first: bool = True) -> DataFrame:
    """The trades taken, one position at a time per combo and symbol."""
    resolved = materialise(resolve_exits(cands, signals, bars, tp_first), "candidates")
    return select_non_overlapping(resolved, ["combo_id", *SYMBOL])


def contracts(risk: Column, stop_pts: Column) -> Column:
    """Whole contracts a risk budget affords; 0 for no stop."""
    return F.coalesce(F.floor(safe_div(risk, stop_pts * DOLLARS_PER_POINT)), F.lit(0)).cast("bigint")


def round_trip_cost(slippage_ticks: Column) -> Column:
    """Friction per contract: base cost plus both sides' slippage."""
    return slippage_ticks * (2.0 * TICK * DOLLARS_PER_POINT) + ROUND_TRIP_COST


def money(df: DataFrame, points: Column, n: Column, cost: Column) -> DataFrame:
    """Gross, friction and net dollars, R multiples before and after friction, and the win label."""
    risk = F.col("stop_pts") * n * DOLLARS_PER_POINT
    out = df.withColumns({"gross_pnl": points * n * DOLLARS_PER_POINT, "friction": n * cost, "risk_dollars": risk})
    net = F.col("gross_pnl") - F.col("friction")
    return out.withColumns(
        {
            "net_pnl": net,
            "gross_r": safe_div(F.col("gross_pnl"), F.col("risk_dollars")),
            "r_multiple": safe_div(net, F.col("risk_dollars")),
            "win": (net > 0).cast("int"),
        }
    )


def points(df_side: Column, entry: Column, exit_: Column) -> Column:
    return (exit_ - entry) * df_side


def path_ratio(mfe: Column, mae: Column) -> Column:
    """Favourable over adverse excursion, NULL while the adverse one is below a tick."""
    return F.when(F.abs(mae) >= MIN_ADVERSE_POINTS, mfe / F.nullif(F.abs(mae), F.lit(0.0)))


def breaks_min_rr(rr_planned: Column, min_rr: Column) -> Column:
    return (rr_planned < min_rr - 1e-9).cast("int")


def reprice(rr: Column, mfe: Column, mae: Column, stop: Column, original_r: Column) -> Column:
    """R multiple under another target: target if reached, else stop if reached, else the original exit."""
    eps = 1e-9
    return F.when(mfe >= rr * stop - eps, rr).when(mae <= -stop + eps, F.lit(-1.0)).otherwise(original_r)


def tick_stop(distance: Column, tick: float = TICK) -> Column:
    """A stop distance on the tick grid, one tick at least."""
    return F.greatest(tick_round(distance, tick), F.lit(tick))


def stop_from_distance(side: Column, entry: Column, distance: Column, tick: float = TICK) -> Column:
    return tick_round(entry - side * tick_stop(distance, tick), tick)


def stop_from_swing(side: Column, entry: Column, low: Column, high: Column, buffer_ticks: int, tick: float = TICK) -> Column:
    """Beyond the recent swing, and at least a tick on the losing side of the entry."""
    raw = tick_round(F.when(side == 1, low - buffer_ticks * tick).otherwise(high + buffer_ticks * tick), tick)
    wrong = F.when(side == 1, raw >= entry).otherwise(raw <= entry)
    return F.when(wrong, tick_round(entry - side * tick, tick)).otherwise(raw)


def target_from_stop(side: Column, entry: Column, stop: Column, rr: Column | float, tick: float = TICK) -> Column:
    return tick_round(entry + side * F.greatest(F.abs(entry - stop) * rr, F.lit(tick)), tick)


# Weights of the entry score and the session scores by clock time.
SCORE_WEIGHTS = {"zscore": 0.25, "volume": 0.20, "ema": 0.20, "body": 0.20, "session": 0.15}
SESSION_SCORES = {"rth": 1.0, "extended": 0.6, "overnight": 0.3}


def session_score(hhmm: Column) -> Column:
    t = F.coalesce(hhmm, F.lit(0))
    regular = (t >= 830) & (t < 1515)
    extended = ((t >= 600) & (t < 830)) | ((t >= 1515) & (t < 1700))
    return (
        F.when(regular, SESSION_SCORES["rth"])
        .when(extended, SESSION_SCORES["extended"])
        .otherwise(SESSION_SCORES["overnight"])
    )


def entry_score(
    z: Column, volume_z: Column, ema_spread: Column, body: Column, span: Column, hhmm: Column, band: float, ema_norm: float
) -> Column:
    """Weighted mean of the known components, each limited to [0, 1]."""
    parts = {
        "zscore": clip(F.abs(z) / band, 0.0, 1.0),
        "volume": clip((volume_z + 2.0) / 4.0, 0.0, 1.0),
        "ema": clip(F.abs(ema_spread) / ema_norm, 0.0, 1.0),
        "body": clip(F.when(span >= TICK, body / F.nullif(span, F.lit(0.0))), 0.0, 1.0),
        "session": session_score(hhmm),
    }
    total = sum((F.coalesce(p * SCORE_WEIGHTS[k], F.lit(0.0)) for k, p in parts.items()), F.lit(0.0))
    weight = sum((F.when(p.isNotNull(), SCORE_WEIGHTS[k]).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    return safe_div(total, weight)


def compounded_equity(
    df: DataFrame, keys: list[str], order: list[str], block: list[Column], r: Column, share: float, start: float
) -> DataFrame:
    """Equity of one stream that risks a fixed share per trade; ruin keeps it at 0.

    Growth factors multiply, so their logarithms add up block by block.
    """
    factor = F.lit(1.0) + r * share
    growth = F.when(factor > 0, F.ln(factor)).otherwise(F.lit(0.0))
    ruin = F.coalesce(factor <= 0, F.lit(False)).cast("int")
    rows = df.withColumns({"_growth": growth, "_ruin": ruin})
    out = running(rows, keys, order, block, sums={"_log": F.col("_growth"), "_ruins": F.col("_ruin")})
    before = F.exp(F.col("_log") - F.col("_growth")) * start
    prior = F.when(F.col("_ruins") > F.col("_ruin"), 0.0).otherwise(before)
    equity = F.when(F.col("_ruins") > 0, 0.0).otherwise(F.exp("_log") * start)
    return out.withColumns({"equity": equity, "trade_pnl": equity - prior}).drop("_growth", "_ruin", "_log", "_ruins")
