"""Entry signals over the hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.operators import indicators as N
from tradeloom.operators import signals as G
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, bars, sql
from tradeloom.plans.registry import query

col = F.col
LAG = "OVER (PARTITION BY symbol ORDER BY bar_idx)"

# z on 20 bars, volume z on 20 bars, ATR rank on 100 bars, previous z
SCORED = S.SERIES + f""", scored0 AS MATERIALIZED (SELECT *, {S.zscore('close', 20)} AS z, {S.zscore('volume', 20)} AS vz,
  round({S.mean('tr', 14)}, 8) AS atr FROM s),
scored AS MATERIALIZED (SELECT *, lag(z) {LAG} AS zp, {S.rank('atr', 100)} / 100 AS atr_rank FROM scored0)"""
LONG, SHORT = "coalesce(zp <= -1.5 AND z > -1.5, false)", "coalesce(zp >= 1.5 AND z < 1.5, false)"


def encoded(long, short):
    return f"(CASE WHEN {short} THEN -1 WHEN {long} THEN 1 ELSE 0 END)::TINYINT"


def signal_text(long=LONG, short=SHORT, extra="", source="scored", ctes=SCORED):
    return sql(f"{ctes} SELECT symbol, bar_idx, {encoded(f'({long}) {extra}', f'({short}) {extra}')} AS signal FROM {source}", BARS)


def scored(spark, d, trend=False):
    df = bars(spark, d)
    if trend:
        df = N.add_ema_pair(df, 8, 21)
    df = N.with_rolling(
        df, 22,
        tr=N.true_range,
        atr=lambda w: F.round(N.rolling_mean(col("tr"), w, 14), 8),
        z=lambda w: N.zscore(col("close"), w, 20),
        vz=lambda w: N.zscore(col("volume"), w, 20),
        zp=lambda w: F.lag("z").over(w),
    )
    return df


def emit(df, sides):
    return df.withColumn("signal", G.encode(sides)).select("symbol", "bar_idx", "signal")


def rev():
    return G.reversal(col("z"), col("zp"), F.lit(1.5))


PAIRED = SCORED + S.EMA_PAIR + """, paired AS (SELECT scored.*, ema_fast, ema_slow, above, was
  FROM scored JOIN (SELECT symbol, bar_idx, ema_fast, ema_slow, above, was FROM pair) USING (symbol, bar_idx))"""


@query("G1_ema_crossover", sql(PAIRED + f"""SELECT symbol, bar_idx, {encoded('above AND NOT was', 'NOT above AND was')} AS plain,
  {encoded('above AND NOT was AND z <= -0.5', 'NOT above AND was AND z >= 0.5')} AS gated FROM paired""", BARS))
def g1(spark, d):
    df = scored(spark, d, trend=True)
    up, down = col("ema_cross_up"), col("ema_cross_down")
    return df.select("symbol", "bar_idx", G.encode(G.crossover(up, down)).alias("plain"),
                     G.encode(G.crossover(up, down, col("z"), 0.5)).alias("gated"))


@query("G2_z_reversal", signal_text(LONG + " AND ema_fast > ema_slow", SHORT + " AND ema_fast < ema_slow", source="paired", ctes=PAIRED))
def g2(spark, d):
    df = scored(spark, d, trend=True)
    return emit(df, G.with_trend(rev(), col("ema_fast"), col("ema_slow")))


@query("G3_z_fading", signal_text(extra="AND abs(z) < abs(zp)"))
def g3(spark, d):
    df = scored(spark, d)
    return emit(df, G.gated(rev(), G.fading(col("z"), col("zp"))))


@query("G4_volume_gate", signal_text(extra="AND vz >= 0.25"))
def g4(spark, d):
    return emit(scored(spark, d), G.gated(rev(), G.volume_gate(col("vz"), F.lit(0.25))))


@query("G5_regime_gate", signal_text(extra="AND atr_rank BETWEEN 0.2 AND 0.9"))
def g5(spark, d):
    df = N.with_rolling(scored(spark, d), 100, atr_rank=lambda w: N.percent_rank(col("atr"), w, 100))
    return emit(df, G.gated(rev(), G.regime_gate(col("atr_rank"), 0.2, 0.9)))


@query("G6_session_gate", signal_text(extra="AND hour(time) >= 9 AND hour(time) < 16"))
def g6(spark, d):
    return emit(scored(spark, d), G.gated(rev(), G.session_gate(col("time"), F.lit(2))))


@query("G7_encode", signal_text(long="coalesce(z > -0.5, false)", short="coalesce(z > 0.5, false)"))
def g7(spark, d):
    return emit(scored(spark, d), (col("z") > -0.5, col("z") > 0.5))


@query("G8_delayed_entry", sql(SCORED + f"""SELECT symbol, bar_idx,
  coalesce(lag(sig, 3) {LAG}, 0)::TINYINT AS signal FROM (SELECT *, {encoded(LONG, SHORT)} AS sig FROM scored)""", BARS))
def g8(spark, d):
    return G.delay(emit(scored(spark, d), rev()), 3)
