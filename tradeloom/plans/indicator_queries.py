"""Rolling, cumulative and recursive indicators over the hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.maths import normal_cdf, probit, tidy
from tradeloom.operators import bars as B
from tradeloom.operators import indicators as N
from tradeloom.operators import rolling_rank as RR
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, bars, session_bars, sql
from tradeloom.plans.registry import query

col = F.col


def out(df, *names, digits=6):
    return df.select("symbol", "bar_idx", *[tidy(col(n), digits).alias(n) for n in names])


def text(source, digits=6, ctes=S.SERIES, **cols):
    picks = ", ".join(f"{S.r6(e, digits)} AS {n}" for n, e in cols.items())
    return sql(f"{ctes} SELECT symbol, bar_idx, {picks} FROM {source}", BARS)


PAIR = S.SERIES + S.EMA_PAIR


@query("N1_ema", sql(S.ema_cte("e2", 2) + S.ema_cte("e8", 8) + S.ema_cte("e21", 21) + S.ema_cte("e200", 200) + f"""
  SELECT symbol, bar_idx, {S.r6('e2.y')} AS ema_2, {S.r6('e8.y')} AS ema_8, {S.r6('e21.y')} AS ema_21,
         {S.r6('e200.y')} AS ema_200
  FROM e2 JOIN e8 USING (symbol, bar_idx) JOIN e21 USING (symbol, bar_idx) JOIN e200 USING (symbol, bar_idx)""", BARS))
def n1(spark, d):
    df = N.emas(bars(spark, d), "close", {f"ema_{n}": n for n in (2, 8, 21, 200)})
    return out(df, "ema_2", "ema_8", "ema_21", "ema_200")


@query("N2_ema_cross", sql(PAIR + f"""SELECT symbol, bar_idx, {S.r6('ema_fast - ema_slow')} AS ema_spread,
  above AND NOT was AS ema_cross_up, NOT above AND was AS ema_cross_down FROM pair""", BARS))
def n2(spark, d):
    df = N.add_ema_pair(bars(spark, d), 8, 21)
    return df.select("symbol", "bar_idx", tidy(col("ema_spread")).alias("ema_spread"), "ema_cross_up", "ema_cross_down")


@query("N3_zscore", text("s", z_10=S.zscore("close", 10), z_50=S.zscore("close", 50)))
def n3(spark, d):
    df = N.with_rolling(bars(spark, d), 50, z_10=lambda w: N.zscore(col("close"), w, 10),
                        z_50=lambda w: N.zscore(col("close"), w, 50))
    return out(df, "z_10", "z_50")


@query("N4_volume_zscore", text("s", volume_zscore=S.zscore("volume", 20)))
def n4(spark, d):
    df = N.with_rolling(bars(spark, d), 20, volume_zscore=lambda w: N.zscore(col("volume"), w, 20))
    return out(df, "volume_zscore")


@query("N5_atr", text("s", tr="tr", atr=S.mean("tr", 14)))
def n5(spark, d):
    return out(N.add_atr(bars(spark, d), 14), "tr", "atr")


@query("N6_rolling_mean_std", text("s", mean_20=S.mean("close", 20), std_20=S.std("close", 20)))
def n6(spark, d):
    df = N.with_rolling(bars(spark, d), 20, mean_20=lambda w: N.rolling_mean(col("close"), w, 20),
                        std_20=lambda w: N.rolling_std(col("close"), w, 20))
    return out(df, "mean_20", "std_20")


@query("N7_mid_rank", text("s", mid_rank=f"({S.rank('close', 30)} - 0.5) / 30"))
def n7(spark, d):
    df = RR.rolling_rank(bars(spark, d), N.KEYS, "bar_idx", "close", 30, "rank")
    return out(df.withColumn("mid_rank", RR.mid_share(col("rank"), 30)), "mid_rank")


@query("N8_probit", sql(f"""SELECT symbol, bar_idx, {S.r6(S.probit('p'))} AS z
  FROM (SELECT symbol, bar_idx, close / 500.0::DOUBLE AS p FROM bars)""", BARS))
def n8(spark, d):
    df = bars(spark, d).withColumn("p", col("close") / 500.0)
    return out(df.withColumn("z", probit(col("p"))), "z")


@query("N9_rank_zscore", sql(S.SERIES + f"""SELECT symbol, bar_idx,
  {S.r6(S.probit('m') + ' * (3.0 / ' + S.probit('(29.5::DOUBLE / 30)') + ')')} AS rank_z
  FROM (SELECT symbol, bar_idx, ({S.rank('close', 30)} - 0.5) / 30 AS m FROM s)""", BARS))
def n9(spark, d):
    df = RR.rolling_rank(bars(spark, d), N.KEYS, "bar_idx", "close", 30, "rank")
    return out(df.withColumn("rank_z", RR.rank_score(col("rank"), 30)), "rank_z")


VWAP = """, sess AS (SELECT *, sum(session_break::INT) OVER (PARTITION BY symbol ORDER BY bar_idx) AS sid FROM s),
vw AS MATERIALIZED (SELECT *, CASE WHEN sum(volume) OVER v > 0 THEN sum(tp * volume) OVER v / sum(volume) OVER v ELSE tp END AS vwap
  FROM sess WINDOW v AS (PARTITION BY symbol, sid ORDER BY bar_idx))"""


@query("N10_session_vwap", sql(S.SERIES + VWAP + f"SELECT symbol, bar_idx, {S.r6('vwap')} AS vwap FROM vw", BARS))
def n10(spark, d):
    return out(N.session_vwap(B.add_session_id(session_bars(spark, d))), "vwap")


@query("N11_input_series", text("s", close="close", ret="ret", tp="tp"))
def n11(spark, d):
    df = N.with_rolling(bars(spark, d), 1, ret=N.log_return, tp=lambda w: N.typical_price())
    return out(df, "close", "ret", "tp")


@query("N12_anchors", sql(S.SERIES + VWAP + S.EMA_PAIR + f"""SELECT symbol, bar_idx,
  {S.r6('close - m')} AS dev_mean, {S.r6('close - vwap')} AS dev_vwap,
  {S.r6('close - ema_fast')} AS dev_fast, {S.r6('close - ema_slow')} AS dev_slow
  FROM (SELECT *, {S.mean('close', 20)} AS m FROM pair) JOIN (SELECT symbol, bar_idx, vwap FROM vw) USING (symbol, bar_idx)""", BARS))
def n12(spark, d):
    df = N.session_vwap(B.add_session_id(session_bars(spark, d)))
    df = N.add_ema_pair(df, 8, 21)
    df = N.with_rolling(df, 20, _m=lambda w: N.rolling_mean(col("close"), w, 20))
    for name, anchor in (("mean", "_m"), ("vwap", "vwap"), ("fast", "ema_fast"), ("slow", "ema_slow")):
        df = df.withColumn(f"dev_{name}", col("close") - col(anchor))
    return out(df, "dev_mean", "dev_vwap", "dev_fast", "dev_slow")


@query("N13_denominators", text("s", den_std=S.std("close", 20), den_atr=S.mean("tr", 14),
                                den_range=f"avg({S.RANGE_POINTS}) OVER {S.w(20)}", den_log=S.mean(S.RANGE_LOG, 20)))
def n13(spark, d):
    df = N.with_rolling(
        bars(spark, d), 21,
        den_std=lambda w: N.rolling_std(col("close"), w, 20),
        tr=N.true_range,
        den_atr=lambda w: N.rolling_mean(col("tr"), w, 14),
        den_range=lambda w: F.avg(N.range_points()).over(N.over_last(w, 20)),
        den_log=lambda w: N.rolling_mean(N.range_log(), w, 20),
    )
    return out(df, "den_std", "den_atr", "den_range", "den_log")


def param(x, m, den):
    return f"(CASE WHEN {den} > 1e-12 THEN ({x} - {m}) / {den} END)"


@query("N14_parametric_zscore", sql(S.SERIES + VWAP + f"""SELECT symbol, bar_idx,
  {S.r6(param('close', S.mean('close', 20), S.std('close', 20)))} AS z_close_std,
  {S.r6(param('tp', 'vwap', S.mean('tr', 14)))} AS z_tp_vwap_atr,
  {S.r6(param('ret', S.mean('ret', 20), S.mean(S.RANGE_LOG, 20)))} AS z_ret_range FROM vw""", BARS))
def n14(spark, d):
    df = N.session_vwap(B.add_session_id(session_bars(spark, d)))
    df = N.variant_zscore(df, 20, "z_close_std")
    df = N.variant_zscore(df, 20, "z_tp_vwap_atr", "typical_price", "vwap_session", "atr")
    df = N.variant_zscore(df, 20, "z_ret_range", "returns", "vwap_session", "parkinson")
    return out(df, "z_close_std", "z_tp_vwap_atr", "z_ret_range")


@query("N15_two_window_blend", sql(S.SERIES + f"""SELECT symbol, bar_idx, {S.r6('0.7::DOUBLE * z1 + 0.3::DOUBLE * z2')} AS z_blend
  FROM (SELECT symbol, bar_idx, {param('close', S.mean('close', 20), S.std('close', 20))} AS z1,
               {param('close', S.mean('close', 45), S.std('close', 45))} AS z2 FROM s)""", BARS))
def n15(spark, d):
    df = N.variant_zscore(N.variant_zscore(bars(spark, d), 20, "z1"), 45, "z2")
    return out(df.withColumn("z_blend", N.blend(col("z1"), col("z2"), 0.3)), "z_blend")


@query("N16_atr_percent_rank", sql(S.SERIES + f"""SELECT symbol, bar_idx, {S.r6(S.rank('atr', 100) + ' / 100')} AS atr_rank
  FROM (SELECT *, round({S.mean('tr', 14)}, 8) AS atr FROM s)""", BARS))
def n16(spark, d):
    return atr_rank(spark, d, 100)


def atr_rank(spark, d, lookback):
    df = N.add_atr(bars(spark, d), 14).withColumn("atr", F.round("atr", 8))
    df = RR.rolling_rank(df, N.KEYS, "bar_idx", "atr", lookback, "rank")
    return out(df.withColumn("atr_rank", col("rank") / lookback), "atr_rank")


@query("N16b_long_percent_rank", sql(S.SERIES + f"""SELECT symbol, bar_idx, {S.r6(S.rank('atr', 500) + ' / 500')} AS atr_rank
  FROM (SELECT *, round({S.mean('tr', 14)}, 8) AS atr FROM s)""", BARS))
def n16b(spark, d):
    """The longest lookback in use."""
    return atr_rank(spark, d, 500)


@query("N17_bar_range_volatility", sql(S.SERIES + f"""SELECT symbol, bar_idx, {S.r6(S.RANGE_LOG)} AS range_pct,
  {S.r6('CASE WHEN atr > 0 THEN ' + S.RANGE_POINTS + ' / atr END')} AS range_vs_atr
  FROM (SELECT *, {S.mean('tr', 14)} AS atr FROM s)""", BARS))
def n17(spark, d):
    df = N.add_atr(bars(spark, d), 14)
    vs_atr = F.when(col("atr") > 0, N.range_points() / col("atr"))
    return out(df.withColumns({"range_pct": N.range_log(), "range_vs_atr": vs_atr}), "range_pct", "range_vs_atr")


@query("N18_swing_range", text("s", swing=S.full("high", f"max(high) OVER {S.w(12)} - min(low) OVER {S.w(12)}", 12)))
def n18(spark, d):
    def swing(w):
        high, low = F.max("high").over(N.over_last(w, 12)), F.min("low").over(N.over_last(w, 12))
        return N.full_window(high - low, col("high"), w, 12)

    return out(N.with_rolling(bars(spark, d), 12, swing=swing), "swing")


PAST = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)"


@query("N19_regime_percentile", sql(S.SERIES + f"""SELECT symbol, bar_idx, {S.r6('coalesce(CASE WHEN k >= 30 THEN ' + S.normal_cdf('z') + ' END, 0.5)')} AS regime
  FROM (SELECT symbol, bar_idx, count(tr) OVER {PAST} AS k,
        (tr - avg(tr) OVER {PAST}) / nullif(stddev_pop(tr) OVER {PAST}, 0) AS z FROM s)""", BARS))
def n19(spark, d):
    df = N.with_rolling(bars(spark, d), 501, tr=N.true_range, regime=lambda w: N.regime_percentile(col("tr"), w))
    return out(df, "regime")


@query("N20_bar_geometry", sql(PAIR + f"""SELECT symbol, bar_idx, {S.r6('abs(close - open)')} AS bar_body,
  {S.r6('high - low')} AS bar_range, {S.r6('close - ema_fast')} AS to_ema_fast, {S.r6('close - ema_slow')} AS to_ema_slow
  FROM pair""", BARS))
def n20(spark, d):
    df = N.bar_shape(N.add_ema_pair(bars(spark, d), 8, 21))
    return out(df, "bar_body", "bar_range", "to_ema_fast", "to_ema_slow")


@query("N21_indicator_reuse", sql(S.SERIES + " , zz AS (" + " UNION ALL ".join(
    f"SELECT symbol, bar_idx, {n} AS z_window, {S.zscore('close', n)} AS z FROM s" for n in (10, 20, 40)) + f""")
  SELECT symbol, bar_idx, z_window, {S.r6('z')} AS zscore,
  {S.r6('lag(z) OVER (PARTITION BY symbol, z_window ORDER BY bar_idx)')} AS zscore_prev FROM zz""", BARS))
def n21(spark, d):
    df = N.zscores_by_window(bars(spark, d), [10, 20, 40, 20])
    return df.select("symbol", "bar_idx", "z_window", tidy(col("zscore")).alias("zscore"), tidy(col("zscore_prev")).alias("zscore_prev"))


@query("N22_normal_cdf", sql(f"""SELECT symbol, bar_idx, {S.r6(S.normal_cdf('z'), 9)} AS p
  FROM (SELECT symbol, bar_idx, (close - 100.0::DOUBLE) / 25.0::DOUBLE AS z FROM bars)""", BARS))
def n22(spark, d):
    df = bars(spark, d).withColumn("z", (col("close") - 100.0) / 25.0)
    return out(df.withColumn("p", normal_cdf(col("z"))), "p", digits=9)
