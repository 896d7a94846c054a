"""Sources and sinks, and the streaming forms of the bar jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.maths import tidy
from tradeloom.operators import ranking as K
from tradeloom.operators.ledger import daily_ledger
from tradeloom.plans import sqltext as S
from tradeloom.plans.bar_queries import OHLCV, secs
from tradeloom.plans.inputs import BARS, TRADES, raw_bars, sql, table, trades
from tradeloom.plans.registry import query
from tradeloom.plans.stat_queries import PER, per_combo, picks
from tradeloom.session import scratch_path
from tradeloom.sources import bars_csv as V
from tradeloom.sources import reports as R
from tradeloom.sources import keyed as KT
from tradeloom.sources import tables as Q
from tradeloom.streaming import bars as ST
from tradeloom.streaming import event_mean as EV

col, r6 = F.col, S.r6


@query("IO1_vendor_csv", sql(f"SELECT symbol, epoch(time)::BIGINT AS start_s, {OHLCV} FROM raw_bars WHERE volume >= 2", BARS))
def io1(spark, d):
    path = scratch_path(spark, "vendor")
    R.write_csv(V.vendor_rows(raw_bars(spark, d), col("volume") < 2), path)
    return V.read_bars(spark, path).select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("IO2_projected_scan", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def io2(spark, d):
    return Q.scan(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_returnflag"]).groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("IO3_append_sink", sql(f"SELECT combo_id, flag, count(*) AS n, {r6('sum(net_pnl)')} AS net_pnl FROM trades GROUP BY 1, 2", TRADES))
def io3(spark, d):
    path, t = scratch_path(spark, "sweep"), trades(spark, d)
    Q.append(t.filter(col("side") == "long"), path, "flag")
    Q.append(t.filter(col("side") == "short"), path, "flag")
    back = spark.read.schema(t.schema).parquet(path)
    return back.groupBy("combo_id", "flag").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("net_pnl")).alias("net_pnl"))


@query("IO4_json_manifest", sql(PER + f"SELECT combo_id, n_trades, {r6('sharpe_ratio')} AS sharpe_ratio, 'completed' AS status FROM per", TRADES))
def io4(spark, d):
    path = scratch_path(spark, "manifest")
    R.write_manifest(per_combo(spark, d).select("combo_id", "n_trades", "sharpe_ratio", F.lit("completed").alias("status")), path)
    back = R.read_manifest(spark, path, "combo_id bigint, n_trades bigint, sharpe_ratio double, status string")
    return picks(back, ["combo_id", "n_trades", "status"], "sharpe_ratio")


@query("IO5_csv_reports", sql(f"""SELECT side, strftime(trade_date, '%Y-%m-%d') AS day, count(*) AS n_trades, {r6('sum(net_pnl)')} AS pnl_day FROM trades GROUP BY 1, 2""", TRADES))
def io5(spark, d):
    path = scratch_path(spark, "ledger")
    R.write_csv(daily_ledger(trades(spark, d), ["side"], "trade_date", "net_pnl", 50000.0), path)
    back = R.read_csv(spark, path, "side string, day string, n_trades bigint, pnl_day double, equity_eod double").filter("n_trades > 0")
    return picks(back, ["side", "day", "n_trades"], "pnl_day")


@query("IO6_json_summary", sql(PER + """SELECT combo_id, '{"combo_id":' || combo_id || ',"parameters":{"n_trades":' || n_trades || '},"realised":{"wins":' || round(win_rate * n_trades)::BIGINT || '}}' AS entry
  FROM (SELECT * FROM per ORDER BY round(sharpe_ratio, 9) DESC, combo_id LIMIT 10)""", TRADES))
def io6(spark, d):
    p = per_combo(spark, d).withColumns({"s": F.round("sharpe_ratio", 9), "wins": F.round(col("win_rate") * col("n_trades")).cast("bigint")})
    return K.top_k(p, "s", 10, "combo_id").select("combo_id", R.summary_json(["n_trades"], ["wins"], "combo_id").alias("entry"))


@query("IO7_incremental_append", sql(f"SELECT symbol, epoch(time)::BIGINT AS start_s, {OHLCV} FROM raw_bars", BARS))
def io7(spark, d):
    b = raw_bars(spark, d)
    stored = b.filter(col("time") < F.lit("2024-01-20").cast("timestamp_ntz"))
    fresh = b.filter(col("time") >= F.lit("2024-01-18").cast("timestamp_ntz"))
    return stored.unionByName(V.only_newer(stored, fresh, ["symbol"])).select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("IO8_footer_removal", sql(f"SELECT symbol, epoch(time)::BIGINT AS start_s, {OHLCV} FROM raw_bars", BARS))
def io8(spark, d):
    path = scratch_path(spark, "footer")
    rows = V.vendor_rows(raw_bars(spark, d), F.lit(False))
    broken = rows.groupBy("Symbol").agg(*[F.first(c).alias(c) for c in rows.columns if c != "Symbol"]).withColumn("Time", F.lit("not a time"))
    R.write_csv(rows.unionByName(broken).unionByName(V.footer_row(rows)), path)
    return V.read_bars(spark, path).select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("IO9_pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def io9(spark, d):
    work = table(spark, d, "orders").select("o_orderkey")
    return Q.pending(work, table(spark, d, "lineitem").select(col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("IO10_upsert", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS version FROM orders""")
def io10(spark, d):
    o = table(spark, d, "orders")
    stored = o.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    changes = o.filter(col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    path = scratch_path(spark, "keyed")
    KT.create_keyed(stored, path, ["o_orderkey"], "version", 16)
    KT.upsert_keyed(changes, path)
    return KT.read_keyed(spark, path)


@query("IO11_schema_normalisation", """SELECT c_custkey AS id, c_acctbal AS score, CAST(NULL AS VARCHAR) AS note, 0 AS cooldown, 'customer' AS source FROM customer
  UNION ALL SELECT s_suppkey, s_acctbal, NULL, 0, 'supplier' FROM supplier""")
def io11(spark, d):
    columns = {"id": "bigint", "score": "double", "note": "string", "cooldown": "int"}
    parts = []
    for name, p in (("customer", "c"), ("supplier", "s")):
        renames = {("c_custkey" if p == "c" else "s_suppkey"): "id", f"{p}_acctbal": "score"}
        parts.append(Q.normalise(table(spark, d, name), renames, columns, {"cooldown": F.lit(0)}).withColumn("source", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("IO12_version_keys", "SELECT 'v' || year(o_orderdate) || '_' || o_orderkey AS key, year(o_orderdate)::INT AS version, o_orderkey AS number FROM orders")
def io12(spark, d):
    o = table(spark, d, "orders").select(Q.build_key(F.year("o_orderdate"), col("o_orderkey")).alias("key"))
    version, number = Q.parse_key(col("key"))
    return o.select("key", version.alias("version"), number.alias("number"))


@query("IO12b_version_from_file", sql("SELECT CASE flag WHEN 'A' THEN 10 WHEN 'R' THEN 11 ELSE 12 END AS sweep_version, count(*) AS n FROM trades GROUP BY 1", TRADES))
def io12b(spark, d):
    base, t, paths = scratch_path(spark, "versions"), trades(spark, d), []
    for flag, v in (("A", 10), ("R", 11), ("N", 12)):
        paths.append(f"{base}/sweep_v{v}")
        t.filter(col("flag") == flag).write.parquet(paths[-1])
    df = Q.read_versions(spark, paths)
    return df.groupBy("sweep_version").agg(F.count(F.lit(1)).alias("n"))


@query("IO13_run_metadata", sql(f"SELECT 'run-1' AS run_id, count(*) AS n_trades, {r6('sum(net_pnl)')} AS net_pnl, 'cost=5.0,risk=500.0,start=50000.0' AS settings FROM trades", TRADES))
def io13(spark, d):
    facts = trades(spark, d).agg(F.count(F.lit(1)).alias("n_trades"), tidy(F.sum("net_pnl")).alias("net_pnl"))
    out = R.run_metadata(facts, "run-1", {"start": 50000.0, "risk": 500.0, "cost": 5.0})
    pairs = F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("run_id", "n_trades", "net_pnl", F.array_join(pairs, ",").alias("settings"))


# ---------------------------------------------------------------- streaming

TICK_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(spark, d):
    raw = ST.read_ticks(spark, d, TICK_SCHEMA, "events.parquet")
    return raw.select(col("event_type").alias("symbol"), col("ts").cast("timestamp").alias("time"), col("event_id").alias("tick_id"), "value")


CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("R1_streaming_bars", sql(f"SELECT symbol, epoch(time)::BIGINT AS start_s, open, high, low, close, volume::BIGINT AS volume FROM raw_bars WHERE volume >= 2 AND time + INTERVAL 1 HOUR <= {CLOSED}", BARS))
def r1(spark, d):
    out = ST.run_available(ST.streaming_bars(tick_stream(spark, d), "1 hour", "2 hours", least_ticks=2), "bars")
    return out.select("symbol", secs("time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("R2_streaming_append", "SELECT event_id AS tick_id, event_type AS symbol, value FROM events")
def r2(spark, d):
    twice = tick_stream(spark, d).unionByName(tick_stream(spark, d))
    return ST.run_available(ST.deduplicated(twice, ["tick_id"], "2 hours"), "ticks").select("tick_id", "symbol", "value")


@query("R3_session_windows", f"""WITH g AS (SELECT event_type AS symbol, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS b FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM g)
  SELECT symbol, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n_ticks, {r6('sum(value)')} AS total FROM s GROUP BY symbol, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def r3(spark, d):
    out = ST.run_available(ST.sessions(tick_stream(spark, d), "30 minutes", "2 hours"), "sessions")
    return out.select("symbol", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_ticks", tidy(col("total")).alias("total"))


EMA_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT event_type AS symbol, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
  e AS (SELECT symbol, event_id, ts, i, value AS y FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.event_id, t.ts, t.i, {2 / 22!r}::DOUBLE * value + {1 - 2 / 22!r}::DOUBLE * y FROM e JOIN t ON t.symbol = e.symbol AND t.i = e.i + 1)
  SELECT symbol, event_id AS tick_id, {r6('y')} AS ema FROM e"""


@query("R4_streaming_ema", EMA_SQL + f" WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}")
def r4(spark, d):
    """In event time: a tick counts once the watermark is past its hour."""
    out = ST.run_available(EV.event_time_ema(tick_stream(spark, d), 21, "2 hours", stretch=3600), "ema", rocksdb=True)
    return out.select("symbol", "tick_id", tidy(col("ema")).alias("ema"))


@query("R4b_arrival_ema", EMA_SQL)
def r4b(spark, d):
    """In order of arrival, which is event order where files come in order."""
    out = ST.run_available(ST.streaming_ema(tick_stream(spark, d), 21), "ema", rocksdb=True)
    return out.select("symbol", "tick_id", tidy(col("ema")).alias("ema"))
