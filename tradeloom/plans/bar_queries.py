"""Bar preparation, time handling and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import clock
from tradeloom.functions.maths import tidy
from tradeloom.operators import bars as B
from tradeloom.operators import calendar as C
from tradeloom.plans.inputs import BARS, TRADES, bars, raw_bars, session_bars, sql, table, trades
from tradeloom.plans.registry import query


def secs(c):
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


OHLCV = "open, high, low, close, volume"
FOUR_HOURS = """, four AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', time, TIMESTAMP '2000-01-01') AS start,
         arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close,
         sum(volume) AS volume, count(*) AS n_source
  FROM bars GROUP BY 1, 2)"""


@query("T1_resample", sql(FOUR_HOURS + f"SELECT symbol, epoch(start)::BIGINT AS start_s, {OHLCV} FROM four", BARS))
def t1(spark, d):
    out = B.resample(raw_bars(spark, d), "4 hours")
    return out.select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("T2_whole_windows", sql(FOUR_HOURS + f"SELECT symbol, epoch(start)::BIGINT AS start_s, {OHLCV} FROM four WHERE n_source = 4", BARS))
def t2(spark, d):
    out = B.resample(raw_bars(spark, d), "4 hours", expected=4)
    return out.select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("T3_session_break", sql("SELECT symbol, bar_idx, session_break FROM session_bars", BARS))
def t3(spark, d):
    return session_bars(spark, d).select("symbol", "bar_idx", "session_break")


@query("T4_session_id", sql("""SELECT symbol, bar_idx,
  sum(session_break::INT) OVER (PARTITION BY symbol ORDER BY bar_idx)::BIGINT AS session_id FROM session_bars""", BARS))
def t4(spark, d):
    return B.add_session_id(session_bars(spark, d)).select("symbol", "bar_idx", "session_id")


@query("T5_split_by_ratio", sql("""SELECT symbol, bar_idx,
  bar_idx < floor(0.8::DOUBLE * count(*) OVER (PARTITION BY symbol)) AS is_train FROM bars""", BARS))
def t5(spark, d):
    return B.split_by_ratio(bars(spark, d), 0.8).select("symbol", "bar_idx", "is_train")


@query("T6_split_by_time", sql("""SELECT symbol, bar_idx, time <= TIMESTAMP '2024-01-20 05:07:00' AS is_train FROM bars""", BARS))
def t6(spark, d):
    cut = F.lit("2024-01-20 05:07:00").cast("timestamp")
    return B.split_by_time(bars(spark, d), cut).select("symbol", "bar_idx", "is_train")


@query("T7_temporal_filter", sql("""SELECT combo_id, count(*) AS n_rows,
  (count(*) FILTER (WHERE trade_date < DATE '2000-01-01')) AS n_kept,
  (count(*) FILTER (WHERE trade_date IS NULL)) AS n_null,
  CASE WHEN count(*) FILTER (WHERE trade_date IS NULL) > 0.001 * count(*) THEN 'NULL_TIME'
       WHEN count(*) FILTER (WHERE trade_date < DATE '2000-01-01') = 0 THEN 'EMPTY' ELSE 'OK' END AS status
  FROM trades GROUP BY 1""", TRADES))
def t7(spark, d):
    cut = F.lit("2000-01-01").cast("date")
    return B.temporal_filter_report(trades(spark, d), ["combo_id"], F.col("trade_date"), cut, 0.001)


@query("T8_time_contract", sql("""SELECT count(*) AS n_rows, year(min(time)) AS first_year, year(max(time)) AS last_year,
  year(min(time)) >= 2005 AS ok FROM raw_bars""", BARS))
def t8(spark, d):
    return B.check_contract(raw_bars(spark, d))


@query("T9_zone_conversion", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS exchange_time
  FROM orders""")
def t9(spark, d):
    o = table(spark, d, "orders")
    moved = clock.to_exchange_zone(F.col("o_orderdate").cast("timestamp_ntz"))
    return o.select("o_orderkey", F.date_format(moved, "yyyy-MM-dd HH:mm").alias("exchange_time"))


MOD = "(hour(ts) * 60 + minute(ts))"


@query("T10_session_masks", f"""SELECT event_type AS symbol,
  sum(({MOD} >= 570 AND {MOD} < 960)::INT)::BIGINT AS rth, sum(({MOD} >= 1080 OR {MOD} < 570)::INT)::BIGINT AS overnight,
  sum(({MOD} >= 960 AND {MOD} < 1080)::INT)::BIGINT AS post_rth, sum(({MOD} >= 720 AND {MOD} < 840)::INT)::BIGINT AS lunch
  FROM events GROUP BY 1""")
def t10(spark, d):
    e = table(spark, d, "events")
    masks = clock.session_masks(clock.minute_of_day(F.col("ts")))
    return e.groupBy(F.col("event_type").alias("symbol")).agg(*[F.count_if(m).alias(n) for n, m in masks.items()])


@query("T11_session_modes", """SELECT m.mode AS mode, count(*) FILTER (WHERE CASE m.mode WHEN 0 THEN true
  WHEN 1 THEN hour(ts) >= 7 AND hour(ts) < 20 WHEN 2 THEN hour(ts) >= 9 AND hour(ts) < 16
  ELSE hour(ts) >= 20 OR hour(ts) < 7 END) AS n_allowed
  FROM events, (SELECT unnest([0, 1, 2, 3])::INT AS mode) m GROUP BY 1""")
def t11(spark, d):
    hours = table(spark, d, "events").groupBy(F.hour("ts").alias("h")).count()
    modes = hours.withColumn("mode", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    ok = clock.session_ok(F.col("h"), F.col("mode"))
    return modes.groupBy("mode").agg(F.sum(F.when(ok, F.col("count")).otherwise(0)).alias("n_allowed"))


@query("T12_calendar_spine", """SELECT strftime(unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE,
  INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM orders""")
def t12(spark, d):
    spine = C.day_spine(table(spark, d, "orders"), F.col("o_orderdate").cast("date"))
    return spine.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("T13_year_span", sql("""SELECT symbol, round((epoch(max(time)) - epoch(min(time))) / (365.25 * 86400) + 3.7e-13, 9) + 0.0 AS years
  FROM raw_bars GROUP BY 1""", BARS))
def t13(spark, d):
    span = clock.years_between(F.min("time"), F.max("time"))
    return raw_bars(spark, d).groupBy("symbol").agg(tidy(span, 9).alias("years"))


@query("T14_shifted_cutoffs", sql("""SELECT symbol, shift_days, shift_bars, cutoff_bar, raw <> cutoff_bar AS was_clipped,
  round(cutoff_bar / n + 3.7e-13, 9) AS train_frac,
  round((epoch(t_end) - epoch(t_first)) / (365.25 * 86400) + 3.7e-13, 9) AS years_span FROM (
    SELECT g.*, b.time AS t_end FROM (
      SELECT *, greatest(1, least(n, raw)) AS cutoff_bar FROM (
        SELECT *, round_even(shift_days * bars_per_day, 0)::BIGINT AS shift_bars,
               base + round_even(shift_days * bars_per_day, 0)::BIGINT AS raw
        FROM (SELECT symbol, count(*) AS n, min(time) AS t_first, floor(0.8::DOUBLE * count(*))::BIGINT AS base,
                     count(*)::DOUBLE / count(DISTINCT time::DATE) AS bars_per_day FROM bars GROUP BY 1) s,
             (SELECT unnest([-7, -3, 0, 3, 7])::INT AS shift_days) a)) g
    JOIN bars b ON b.symbol = g.symbol AND b.bar_idx = g.cutoff_bar - 1)""", BARS))
def t14(spark, d):
    out = C.shifted_cutoffs(bars(spark, d), 0.8, [-7, -3, 0, 3, 7])
    return out.select("symbol", "shift_days", "shift_bars", "cutoff_bar", "was_clipped",
                      tidy(F.col("train_frac"), 9).alias("train_frac"), tidy(F.col("years_span"), 9).alias("years_span"))


@query("T15_position_to_time", sql("""SELECT s.symbol, s.bar_idx, epoch(b.time)::BIGINT AS entry_s
  FROM bars s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx = s.bar_idx + 1 WHERE s.close > s.open""", BARS))
def t15(spark, d):
    b = bars(spark, d)
    picks = b.filter(F.col("close") > F.col("open")).select("symbol", "bar_idx", (F.col("bar_idx") + 1).alias("entry_bar"))
    out = C.lookup_time(picks, b, "entry_bar", "entry_time")
    return out.select("symbol", "bar_idx", secs("entry_time").alias("entry_s"))


@query("T16_weekday", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday FROM orders")
def t16(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clock.weekday(F.col("o_orderdate")).alias("weekday"))


@query("T17_resample_checks", sql(FOUR_HOURS + """, src AS (SELECT f.symbol, f.start, max(b.high) AS h, min(b.low) AS l, sum(b.volume) AS v
  FROM four f JOIN bars b ON b.symbol = f.symbol AND b.time >= f.start AND b.time < f.start + INTERVAL '4 hours' WHERE n_source = 4 GROUP BY 1, 2)
  SELECT symbol, count(*) AS n_windows, sum(volume) AS kept_volume, sum(v) AS source_volume, sum(volume) = sum(v) AS conserved,
  bool_and(high = h AND low = l) AS extremes_ok FROM four JOIN src USING (symbol, start) GROUP BY 1""", BARS))
def t17(spark, d):
    return B.resample_checks(raw_bars(spark, d), "4 hours", 4)


@query("T18_hour_in_zone", """SELECT hour(ts + INTERVAL 1 HOUR)::INT AS exchange_hour, hour(ts)::INT AS bar_hour, count(*) AS n
  FROM events GROUP BY 1, 2""")
def t18(spark, d):
    ntz = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(
        F.hour(clock.to_exchange_zone(ntz)).alias("exchange_hour"), F.hour(ntz).alias("bar_hour")
    ).agg(F.count(F.lit(1)).alias("n"))
