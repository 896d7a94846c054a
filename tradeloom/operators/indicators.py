"""Rolling, cumulative and recursive indicators on bars with a dense ``bar_idx`` per symbol."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions.maths import normal_cdf, probit, safe_div
from tradeloom.operators.ordered import ROWS_PER_BLOCK, rolling, running

# Single-bar range volatility scales for price points and for log ranges.
RANGE_SCALE = math.sqrt(1.0 / (4.0 * math.log(2.0)))
LOG_RANGE_SCALE = math.sqrt(4.0 * math.log(2.0))
MIN_DENOMINATOR = 1e-12
KEYS = ["symbol"]


def over_last(w: Window, n: int) -> Window:
    """The last ``n`` rows up to the current one."""
    return w.rowsBetween(-(n - 1), 0)


def full_window(value: Column, x: Column, w: Window, n: int) -> Column:
    """``value`` where the window holds ``n`` known values of ``x``, else NULL."""
    return F.when(F.count(x).over(over_last(w, n)) == n, value)


def rolling_mean(x: Column, w: Window, n: int) -> Column:
    return full_window(F.avg(x).over(over_last(w, n)), x, w, n)


def rolling_std(x: Column, w: Window, n: int, ddof: int = 0) -> Column:
    fn = F.stddev_pop if ddof == 0 else F.stddev_samp
    return full_window(fn(x).over(over_last(w, n)), x, w, n)


def zscore(x: Column, w: Window, n: int, ddof: int = 0) -> Column:
    """Rolling z-score; a window without spread scores 0."""
    sd = rolling_std(x, w, n, ddof)
    return F.when(sd == 0, F.lit(0.0)).otherwise((x - rolling_mean(x, w, n)) / F.nullif(sd, F.lit(0.0)))


def true_range(w: Window) -> Column:
    """First bar: high minus low."""
    prev = F.lag("close").over(w)
    spread = F.col("high") - F.col("low")
    return F.greatest(spread, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def window_rank(x: Column, w: Window, n: int) -> Column:
    """Rank of the current value among the last ``n``, ties averaged, from 1."""
    seen = F.collect_list(x).over(over_last(w, n))
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return full_window(below + (equal + 1) / 2.0, x, w, n)


def mid_rank(x: Column, w: Window, n: int) -> Column:
    return (window_rank(x, w, n) - 0.5) / n


def percent_rank(x: Column, w: Window, n: int) -> Column:
    return window_rank(x, w, n) / n


def rank_zscore(x: Column, w: Window, n: int) -> Column:
    """Normal score of the mid-rank, scaled so that the largest possible score is 3."""
    top = probit(F.lit((n - 0.5) / n))
    return probit(mid_rank(x, w, n)) * (F.lit(3.0) / top)


def log_return(w: Window) -> Column:
    return F.ln(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def range_points() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.lit(0.0)) * RANGE_SCALE


def range_log() -> Column:
    ok = (F.col("low") > 0) & (F.col("high") >= F.col("low"))
    return F.when(ok, F.ln(F.col("high") / F.nullif(F.col("low"), F.lit(0.0))) / LOG_RANGE_SCALE)


def with_rolling(bars: DataFrame, reach: int, **columns) -> DataFrame:
    """Add columns built by ``fn(window)``; each may look back ``reach`` bars and use earlier columns."""

    def build(frame, w):
        for name, fn in columns.items():
            frame = frame.withColumn(name, fn(w))
        return frame

    return rolling(bars, KEYS, "bar_idx", build, back=reach)


def add_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range and its simple moving average."""
    return with_rolling(bars, n, tr=true_range, atr=lambda w: rolling_mean(F.col("tr"), w, n))


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the last session break; typical price while volume is 0."""
    block = [F.floor(F.col("bar_idx") / ROWS_PER_BLOCK)]
    out = running(
        bars,
        ["symbol", "session_id"],
        ["bar_idx"],
        block,
        sums={"_pv": typical_price() * F.col("volume"), "_v": F.col("volume")},
    )
    vwap = F.when(F.col("_v") > 0, safe_div(F.col("_pv"), F.col("_v"))).otherwise(typical_price())
    return out.withColumn("vwap", vwap).drop("_pv", "_v")


def emas(
    df: DataFrame, x: str, spans: dict[str, int], keys: list[str] | None = None, pos: str = "bar_idx"
) -> DataFrame:
    """Exponential means {column: span} with alpha = 2 / (span + 1), each seeded by the first value.

    The recursion y = q*y + u is linear, so a block of rows acts on its carry-in as q^size*y + b.
    Block sums b come from a grouped sum; a carry is the decayed sum of the blocks before it, as far
    back as a weight still matters in double precision; rows then need only their own block.
    All spans share one pass: rows are repeated per span and folded back at the end.
    """
    keys = keys or KEYS
    entries, deepest = [], 1
    for i, (name, span) in enumerate(spans.items()):
        q = 1.0 - 2.0 / (span + 1.0)
        decay = -math.log(q) if q > 0 else math.inf
        size = max(2, min(256, int(25.0 / decay)))
        deepest = max(deepest, math.ceil(42.0 / (decay * size)))
        row = F.when(F.lit(i == 0), F.struct(*[c for c in df.columns if c not in keys and c != pos]))
        fields = {"_span": F.lit(name), "_q": F.lit(q), "_size": F.lit(size), "_row": row}
        entries.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    q, at = F.col("_q"), F.col(pos) % F.col("_size")
    rows = df.select(*keys, pos, F.col(x).alias("_seed"), F.explode(F.array(*entries)).alias("_e"))
    u = F.when(F.col(pos) == 0, F.col("_seed")).otherwise(F.col("_seed") * (1.0 - q))
    rows = rows.select(*keys, pos, "_seed", "_e.*").withColumns({"_u": u, "_at": at, "_blk": F.floor(F.col(pos) / F.col("_size"))})
    by = [*keys, "_span", "_blk"]
    weight = F.when(at == F.col("_size") - 1, F.lit(1.0)).otherwise(F.pow(q, F.col("_size") - 1 - F.col("_at")))
    sums = rows.groupBy(*by, (F.pow(q, F.col("_size"))).alias("_fade")).agg(F.sum(F.col("_u") * weight).alias("_b"))

    def carry(frame, w):
        earlier = F.collect_list("_b").over(w.rowsBetween(-deepest, -1))
        fold = F.aggregate(earlier, F.lit(0.0), lambda acc, b: acc * F.col("_fade") + b)
        return frame.withColumn("_carry", fold)

    carries = rolling(sums, [*keys, "_span"], "_blk", carry, back=deepest).select(*by, "_carry")
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.col("_u") / F.nullif(F.pow(q, F.col("_at")), F.lit(0.0))).over(w)
    y = F.when(q == 0, F.col("_seed")).otherwise(F.pow(q, F.col("_at")) * (q * F.col("_carry") + local))
    out = rows.join(carries, by).withColumn("_y", y)
    picks = [F.max(F.when(F.col("_span") == n, F.col("_y"))).alias(n) for n in spans]
    folded = out.groupBy(*keys, pos).agg(F.first("_row", ignorenulls=True).alias("_row"), *picks)
    rest = [F.col(f"_row.{c}").alias(c) if c not in keys and c != pos else F.col(c) for c in df.columns]
    return folded.select(*rest, *spans)


def add_ema_pair(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Fast and slow mean, their spread and crossings; before the first bar fast is not above slow."""
    out = emas(bars, "close", {"ema_fast": fast, "ema_slow": slow})
    above = F.col("ema_fast") > F.col("ema_slow")

    def build(frame, w):
        was = F.lag(above, 1, False).over(w)
        return frame.withColumns(
            {
                "ema_spread": F.col("ema_fast") - F.col("ema_slow"),
                "ema_cross_up": above & ~was,
                "ema_cross_down": ~above & was,
            }
        )

    return rolling(out, KEYS, "bar_idx", build, back=1)


def variant_zscore(
    bars: DataFrame,
    window: int,
    name: str,
    source: str = "close",
    anchor: str = "rolling_mean",
    spread: str = "rolling_std",
    form: str = "parametric",
    atr_window: int = 14,
) -> DataFrame:
    """Z-score of a chosen series around a chosen anchor in units of a chosen spread.

    Log returns keep to the rolling mean, and to standard deviation or log range as the spread.
    Needs ``ema_fast``, ``ema_slow`` or ``vwap`` on the bars when one of them is the anchor.
    """
    if source == "returns":
        anchor = "rolling_mean"
        spread = spread if spread in ("rolling_std", "parkinson") else "rolling_std"
    reach = max(window, atr_window) + 1

    def build(frame, w):
        series = {"close": lambda: F.col("close"), "typical_price": typical_price, "returns": lambda: log_return(w)}
        frame = frame.withColumns({"_x": series[source](), "_tr": true_range(w)})
        x = F.col("_x")
        if form == "quantile_rank":
            return frame.withColumn(name, rank_zscore(x, w, window))
        anchors = {"rolling_mean": rolling_mean(x, w, window), "vwap_session": "vwap"}
        centre = anchors.get(anchor, anchor)
        centre = F.col(centre) if isinstance(centre, str) else centre
        if spread == "atr":
            unit = rolling_mean(F.col("_tr"), w, atr_window)
        elif spread == "parkinson":
            unit = rolling_mean(range_log() if source == "returns" else range_points(), w, window)
        else:
            unit = rolling_std(x, w, window)
        frame = frame.withColumns({"_dev": x - centre, "_unit": unit})
        return frame.withColumn(name, F.when(F.col("_unit") > MIN_DENOMINATOR, F.col("_dev") / F.col("_unit")))

    return rolling(bars, KEYS, "bar_idx", build, back=reach).drop("_x", "_tr", "_dev", "_unit")


def blend(z1: Column, z2: Column, weight: float) -> Column:
    """Weighted mix of two scores, NULL where either is."""
    return (1.0 - weight) * z1 + weight * z2


def regime_percentile(x: Column, w: Window, reach: int = 500, least: int = 30) -> Column:
    """Normal-curve percentile of a value against the rows before it; 0.5 while history is short or flat."""
    past = w.rowsBetween(-reach, -1)
    known = F.count(x).over(past) >= least
    z = safe_div(x - F.avg(x).over(past), F.stddev_pop(x).over(past))
    return F.coalesce(F.when(known, normal_cdf(z)), F.lit(0.5))


def bar_shape(df: DataFrame) -> DataFrame:
    """Body, range and distances to the two means; the body keeps no sign."""
    return df.withColumns(
        {
            "bar_body": F.abs(F.col("close") - F.col("open")),
            "bar_range": F.col("high") - F.col("low"),
            "to_ema_fast": F.col("close") - F.col("ema_fast"),
            "to_ema_slow": F.col("close") - F.col("ema_slow"),
        }
    )


def zscores_by_window(bars: DataFrame, windows: Iterable[int], x: str = "close") -> DataFrame:
    """One row per (bar, distinct window) with its z-score and the one before it."""
    windows = sorted(set(windows))

    def build(frame, w):
        scores = {f"_z{n}": zscore(F.col(x), w, n) for n in windows}
        frame = frame.withColumns(scores)
        entries = [
            F.struct(
                F.lit(n).alias("z_window"),
                F.col(f"_z{n}").alias("zscore"),
                F.lag(f"_z{n}").over(w).alias("zscore_prev"),
            )
            for n in windows
        ]
        return frame.withColumn("_scores", F.array(*entries)).drop(*scores)

    wide = rolling(bars, KEYS, "bar_idx", build, back=max(windows) + 1)
    return wide.select(*bars.columns, F.inline("_scores"))


def emas_by_span(bars: DataFrame, spans: Iterable[int], x: str = "close") -> DataFrame:
    """One row per (bar, distinct span) with its exponential mean."""
    names = {f"_e{s}": s for s in sorted(set(spans))}
    wide = emas(bars.select(*KEYS, "bar_idx", x), x, names)
    entries = [F.struct(F.lit(s).alias("span"), F.col(n).alias("ema")) for n, s in names.items()]
    return wide.select(*KEYS, "bar_idx", F.inline(F.array(*entries)))
