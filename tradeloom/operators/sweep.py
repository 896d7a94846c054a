"""Tables of parameter sets and their expansion over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.maths import hash_uniform
from tradeloom.operators import indicators as N
from tradeloom.operators import signals as G
from tradeloom.operators.ordered import quantiles

BROADCAST_ROWS = 200_000
SALTS = 64


def product(df: DataFrame, **choices: list) -> DataFrame:
    """Every row with every combination of the listed values."""
    for name, values in choices.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def join_params(rows: DataFrame, params: DataFrame, on: list[str], condition: Column | None = None) -> DataFrame:
    """Rows with every parameter set that shares ``on``: broadcast when few, else salted.

    The join keys take few values, so a plain shuffle would pile each value into one task.
    """
    if params.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(params), on)
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(SALTS)))
        spread = params.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        out = salted.join(spread, [*on, "_salt"]).drop("_salt")
    return out if condition is None else out.filter(condition)


def sweep_signals(bars: DataFrame, combos: DataFrame) -> DataFrame:
    """Non-zero reversal signals of every combo, with its parameters.

    Scores are computed once per distinct window; a combo meets only the bars whose score crosses its band.
    """
    windows = [r[0] for r in combos.select("z_window").distinct().collect()]
    scores = N.zscores_by_window(bars.select("symbol", "bar_idx", "close"), windows)
    scores = scores.filter(F.col("zscore_prev").isNotNull()).drop("close")
    sides = G.reversal(F.col("zscore"), F.col("zscore_prev"), F.col("z_band_k"))
    hit = join_params(scores, combos, ["z_window"], sides[0] | sides[1])
    return hit.withColumn("signal", G.encode(sides))


def resolve_stops(combos: DataFrame, bars: DataFrame, atr_window: int = 14) -> DataFrame:
    """``stop_pts`` per (combo, symbol): fixed, a multiple of the median ATR, or half the median swing plus a tick."""
    swings = [r[0] for r in combos.select("swing_lookback").distinct().dropna().collect()]

    def spreads(frame, w):
        frame = frame.withColumn("_tr", N.true_range(w))
        entries = [F.struct(F.lit("atr").alias("stop_method"), F.lit(None).cast("int").alias("swing_lookback"),
                            N.rolling_mean(F.col("_tr"), w, atr_window).alias("_spread"))]
        for n in swings:
            high, low = F.max("high").over(N.over_last(w, n)), F.min("low").over(N.over_last(w, n))
            entries.append(F.struct(F.lit("swing").alias("stop_method"), F.lit(n).cast("int").alias("swing_lookback"),
                                    N.full_window(high - low, F.col("high"), w, n).alias("_spread")))
        return frame.withColumn("_all", F.array(*entries))

    reach = max([atr_window + 1, *swings])
    long = N.rolling(bars, ["symbol"], "bar_idx", spreads, back=reach).select("symbol", F.inline("_all"))
    long = long.withColumn("swing_lookback", F.coalesce("swing_lookback", F.lit(0)))
    medians = quantiles(long, ["symbol", "stop_method", "swing_lookback"], "_spread", {"_median": 0.5})
    symbols = bars.select("symbol").distinct()
    every = symbols.withColumn("stop_method", F.lit("fixed")).select("symbol", "stop_method", F.lit(0).alias("swing_lookback"), F.lit(None).cast("double").alias("_median"))
    medians = medians.unionByName(every)
    wanted = combos.withColumn("_lookback", F.when(F.col("stop_method") == "swing", F.col("swing_lookback")).otherwise(0))
    facts = medians.withColumnRenamed("swing_lookback", "_lookback")
    out = facts.join(wanted, ["stop_method", "_lookback"])
    stop = (
        F.when(F.col("stop_method") == "fixed", F.col("stop_fixed_pts"))
        .when(F.col("stop_method") == "atr", F.col("_median") * F.col("atr_multiplier"))
        .otherwise(F.col("_median") * 0.5 + 0.25)
    )
    return out.withColumn("stop_pts", stop).drop("_lookback", "_median")


def neighbourhood(combos: DataFrame, columns: list[str], factors: list[float]) -> DataFrame:
    """Each combo's grid of neighbours: every listed column times every factor."""
    out = combos
    for c in columns:
        out = out.withColumn(f"{c}_factor", F.explode(F.array(*[F.lit(f) for f in factors])))
        out = out.withColumn(c, F.col(c) * F.col(f"{c}_factor"))
    return out


def sample_params(draws: DataFrame, ranges: DataFrame, draw_id: str, seed: int) -> DataFrame:
    """Parameters drawn per (draw, mode) from a table of ranges, one map per draw.

    ``ranges``: mode, param, kind ('float', 'int' or 'choice'), lo, hi, choices. The upper end of an
    int range is excluded. The ranges are a small parameter table.
    """
    joined = draws.join(F.broadcast(ranges), "mode")
    u = hash_uniform(seed, F.col(draw_id), F.col("param"))
    span = F.col("hi") - F.col("lo")
    pick = F.floor(u * F.size("choices")).cast("int")
    value = (
        F.when(F.col("kind") == "choice", F.get("choices", pick))
        .when(F.col("kind") == "int", (F.floor(u * span) + F.col("lo")).cast("bigint").cast("string"))
        .otherwise(F.round(u * span + F.col("lo"), 4).cast("string"))
    )
    rows = joined.withColumn("_value", value)
    return rows.groupBy(draw_id, "mode").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", "_value")))).alias("params")
    )


def compatible(params: DataFrame) -> DataFrame:
    """Sampled parameters made consistent: slow above fast, returns only with fitting anchor and spread."""
    p = lambda name: F.col("params")[name]
    returns = p("z_input") == "returns"
    spread = F.when(p("z_type") == "quantile_rank", "n/a").when(
        returns & ~p("z_denom").isin("rolling_std", "parkinson"), "rolling_std"
    )
    fast, slow = p("ema_fast").cast("int"), p("ema_slow").cast("int")
    return params.select(
        *[c for c in params.columns if c != "params"],
        fast.alias("ema_fast"),
        F.greatest(slow, fast + 1).alias("ema_slow"),
        p("z_window").cast("int").alias("z_window"),
        p("z_band_k").cast("double").alias("z_band_k"),
        p("z_input").alias("z_input"),
        F.when(returns, "rolling_mean").otherwise(p("z_anchor")).alias("z_anchor"),
        F.coalesce(spread, p("z_denom")).alias("z_denom"),
        p("z_type").alias("z_type"),
        p("stop_method").alias("stop_method"),
    )


def draw_by_rules(draws: DataFrame, rules: list[tuple], draw_id: str, seed: int) -> DataFrame:
    """Parameters drawn one after the other, so that a range or a choice may depend on those before it.

    ``rules``: (parameter, cases); a case is (condition or None, kind, ...), the first that holds applies. Kinds: ``int`` and ``float``
    with SQL texts of the lower and the excluded upper end, ``choice`` with a list (repeat a value to favour it), ``is``
    with a SQL text. An empty int range gives its lower end.
    """
    out = draws
    for name, cases in rules:
        u = hash_uniform(seed, F.col(draw_id), name)
        value = None
        for condition, kind, *args in reversed(cases):
            if kind == "int":
                lo, hi = F.expr(args[0]), F.expr(args[1])
                here = (lo + F.floor(u * F.greatest(hi - lo, F.lit(0)))).cast("bigint")
            elif kind == "float":
                lo, hi = (F.expr(a).cast("double") for a in args)
                here = F.round(lo + u * (hi - lo), 4)
            elif kind == "choice":
                here = F.get(F.array(*map(F.lit, args[0])), F.floor(u * len(args[0])).cast("int"))
            else:
                here = F.expr(args[0])
            value = here if condition is None else F.when(F.expr(condition), here).otherwise(value)
        out = out.withColumn(name, value)
    return out


def range_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "mode string, param string, kind string, lo double, hi double, choices array<string>"
    return spark.createDataFrame(rows, schema)


def uniform_search(draws: DataFrame, observed: DataFrame, columns: list[str], draw_id: str, seed: int) -> DataFrame:
    """Each draw with a value per column, uniform between its observed minimum and maximum."""
    ends = observed.agg(*[f(c).alias(f"{t}_{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select(F.struct(*ends.columns).alias("_ends")).scalar()
    out = draws.withColumn("_ends", ends)
    for c in columns:
        lo, hi = F.col(f"_ends.lo_{c}"), F.col(f"_ends.hi_{c}")
        out = out.withColumn(c, lo + hash_uniform(seed, F.col(draw_id), c) * (hi - lo))
    return out.drop("_ends")


