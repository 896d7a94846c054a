"""The driver tables read as bars, trades and predictions, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.bars import add_session_break, index_bars
from tradeloom.operators.ordered import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- bars from events

BREAK_SECONDS = 7200


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("time"), "event_id", "value")


def raw_bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """(symbol, time) bars of event values; volume is the event count."""
    t = ticks(spark, sf_dir)
    at = F.struct("time", "event_id")
    return t.groupBy("symbol", F.window("time", every).start.alias("bar_time")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ).withColumnRenamed("bar_time", "time")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a dense ``bar_idx`` per symbol."""
    return index_bars(raw_bars(spark, sf_dir))


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with ``session_break`` where the gap to the previous bar exceeds two hours."""
    return add_session_break(bars(spark, sf_dir), BREAK_SECONDS)


BARS = """raw_bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS time,
         arg_min(value, {'t': ts, 'i': event_id}) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, {'t': ts, 'i': event_id}) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2),
bars AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx FROM raw_bars),
session_bars AS MATERIALIZED (
  SELECT *, coalesce(epoch(time) - epoch(lag(time) OVER (PARTITION BY symbol ORDER BY bar_idx)) > 7200, true)
            AS session_break
  FROM bars)"""


# ---------------------------------------------------------------- trades from lineitem

TRADE_ORDER = ["trade_date", "order_no", "line_no", "part_no", "notional"]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as a sweep trade table; one supplier is one combo."""
    li = table(spark, sf_dir, "lineitem")
    r = (F.col("l_discount") - F.col("l_tax")) * 25.0
    gross = r * F.col("l_quantity") * 2.0
    day = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("combo_id"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_quantity").alias("stop_pts"),
        r.alias("r_multiple"),
        gross.alias("gross_pnl"),
        (gross - 5.0).alias("net_pnl"),
        (r > 0).cast("int").alias("win"),
        (F.col("l_discount") * 100.0).alias("mfe_pts"),
        (F.lit(0.0) - F.col("l_tax") * 100.0).alias("mae_pts"),
        F.col("l_linenumber").cast("bigint").alias("hold_bars"),
        (day * 24).alias("entry_bar"),
        (day * 24 + F.col("l_linenumber")).alias("exit_bar"),
        ((F.col("l_discount") - 0.05) * 40.0).alias("zscore_entry"),
        ((F.col("l_tax") - 0.04) * 50.0).alias("volume_zscore"),
        F.least(F.col("l_discount") * 10.0, F.lit(1.0)).alias("pwin"),
        (F.col("l_returnflag") == "R").cast("int").alias("outcome"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
        F.col("l_returnflag").alias("flag"),
    )


def trade_block():
    """Blocks that rise with TRADE_ORDER: days, then ranges of order numbers inside a day."""
    return [F.col("trade_date"), F.floor(F.col("order_no") / 1_000_000)]


def ordered_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with ``seq`` (from 0, in entry order) and ``n_combo`` per combo."""
    return with_position(trades(spark, sf_dir), ["combo_id"], TRADE_ORDER, trade_block(), "seq", "n_combo")


def seq_block(size: int = 4096):
    return [F.floor(F.col("seq") / size)]


TRADES = """trades AS MATERIALIZED (
  SELECT l_suppkey AS combo_id, l_shipdate::DATE AS trade_date, l_orderkey AS order_no, l_linenumber AS line_no,
         l_partkey AS part_no, l_extendedprice AS notional, l_quantity AS stop_pts,
         (l_discount - l_tax) * 25.0::DOUBLE AS r_multiple,
         (l_discount - l_tax) * 25.0::DOUBLE * l_quantity * 2.0::DOUBLE AS gross_pnl,
         (l_discount - l_tax) * 25.0::DOUBLE * l_quantity * 2.0::DOUBLE - 5.0::DOUBLE AS net_pnl,
         (l_discount > l_tax)::INT AS win,
         l_discount * 100.0::DOUBLE AS mfe_pts, 0.0::DOUBLE - l_tax * 100.0::DOUBLE AS mae_pts,
         l_linenumber::BIGINT AS hold_bars,
         datediff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT * 24 AS entry_bar,
         datediff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT * 24 + l_linenumber AS exit_bar,
         (l_discount - 0.05::DOUBLE) * 40.0::DOUBLE AS zscore_entry,
         (l_tax - 0.04::DOUBLE) * 50.0::DOUBLE AS volume_zscore,
         least(l_discount * 10.0::DOUBLE, 1.0::DOUBLE) AS pwin, (l_returnflag = 'R')::INT AS outcome,
         CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side, l_returnflag AS flag
  FROM lineitem),
ordered_trades AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY combo_id
              ORDER BY trade_date, order_no, line_no, part_no, notional) - 1 AS seq,
         count(*) OVER (PARTITION BY combo_id) AS n_combo
  FROM trades)"""


def sql(body: str, *ctes: str) -> str:
    """A SQL text that starts with the given CTE blocks; the body may add its own with a leading comma."""
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    body = body.strip()
    return head + (body if body.startswith(",") else "\n" + body)
