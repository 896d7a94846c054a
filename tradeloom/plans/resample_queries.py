"""Bootstrap and permutation statistics on the fixed-hold trades and the trade table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.maths import tidy
from tradeloom.operators import resample as B
from tradeloom.operators.ordered import with_position
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, TRADES, ordered_trades, sql
from tradeloom.plans.registry import query
from tradeloom.plans.stat_queries import BY, SHARPE, picks, rounded
from tradeloom.plans.trade_queries import FLAT, fixed_hold_trades
from tradeloom.session import materialise

col, r6 = F.col, S.r6
SIMS, ECE_SIMS, SEED, START, YEARS = 10_000, 1000, 42, 1500.0, 0.08
KEY = ["symbol"]


def stream(spark, d):
    """Fixed-hold trades per symbol with their position, dollars and R multiples."""
    t = fixed_hold_trades(spark, d).select("symbol", "bar_idx", (col("pts") * 2.0).alias("pnl"), (col("pts") / 50.0).alias("r"), (col("pts") > 0).cast("int").alias("win"))
    return materialise(with_position(t, KEY, ["bar_idx"], [F.floor(col("bar_idx") / 4096)], "seq", "n"), "stream")


def paths(spark, d):
    return B.simulated_paths(stream(spark, d), KEY, "pnl", "r", SIMS, SEED, START, 0.05, YEARS)


STREAM = FLAT + """, st AS MATERIALIZED (SELECT symbol, pts * 2 AS pnl, pts / 50 AS r, (pts > 0)::INT AS win, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS seq,
  count(*) OVER (PARTITION BY symbol) AS n FROM held)"""
BOOT = STREAM + f""", ask AS (SELECT symbol, sim, seq AS slot, ('0x' || substr(md5('{SEED}|' || sim || '|' || seq), 1, 8))::BIGINT % n AS seq FROM st, (SELECT unnest(range({SIMS})) AS sim)),
  bs AS MATERIALIZED (SELECT symbol, sim, slot AS seq, pnl, r FROM ask JOIN st USING (symbol, seq)),
  eq AS (SELECT *, {START} + sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY seq) AS e FROM bs),
  pk AS (SELECT *, greatest({START}, max(e) OVER (PARTITION BY symbol, sim ORDER BY seq)) AS p FROM eq),
  pa AS MATERIALIZED (SELECT symbol, sim, count(*) AS n, sum(pnl) AS total, avg((pnl > 0)::INT) AS win_rate, {SHARPE.format(x='pnl')} * sqrt(count(*) / {YEARS}) AS sharpe,
    max(p - e) AS dd_dollars, max((p - e) / nullif(p, 0)) * 100 AS dd_pct FROM pk GROUP BY 1, 2)"""
LOG_GROWTH = "ln(1 + greatest(r * 0.05, -0.999999))"


@query("B1_bootstrap_paths", sql(BOOT + f", lg AS (SELECT symbol, sim, {START} * exp(sum({LOG_GROWTH})) AS fe FROM bs GROUP BY 1, 2) SELECT symbol, sim, n, {rounded(total='total', final_compounded='fe')} FROM pa JOIN lg USING (symbol, sim)", BARS))
def b1(spark, d):
    return paths(spark, d).select("symbol", "sim", "n", tidy(col("total")).alias("total"), tidy(col("final_equity")).alias("final_compounded"))


QS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "worst": 1.0}


@query("B2_drawdown_quantiles", sql(BOOT + "SELECT symbol, " + rounded(**{f"pct_{k}": f"quantile_cont(dd_pct, {v})" for k, v in QS.items()}, **{f"usd_{k}": f"quantile_cont(dd_dollars, {v})" for k, v in QS.items()}) + " FROM pa GROUP BY 1", BARS))
def b2(spark, d):
    p = materialise(paths(spark, d), "paths")
    out = B.across_sims(p, KEY, "dd_pct", {f"pct_{k}": v for k, v in QS.items()}).join(B.across_sims(p, KEY, "dd_dollars", {f"usd_{k}": v for k, v in QS.items()}), KEY)
    return picks(out, KEY, *[f"{t}_{k}" for t in ("pct", "usd") for k in QS])


def tail_sql(src):
    return f"SELECT symbol, v AS var, avg(CASE WHEN round(pnl, 9) <= round(v, 9) THEN pnl END) AS cvar FROM {src} JOIN (SELECT symbol, quantile_cont(round(pnl, 9), 0.05) AS v FROM {src} GROUP BY 1) USING (symbol) GROUP BY 1, 2"


@query("B3_tail_risk", sql(BOOT + f", o AS ({tail_sql('st')}), b AS ({tail_sql('bs')}) SELECT symbol, {rounded(var_observed='o.var', cvar_observed='o.cvar', var_bootstrap='b.var', cvar_bootstrap='b.cvar')} FROM o JOIN b USING (symbol)", BARS))
def b3(spark, d):
    s = stream(spark, d).withColumn("pnl", F.round("pnl", 9))
    seen = B.tail_risk(s, KEY, "pnl").withColumnsRenamed({"var": "var_observed", "cvar": "cvar_observed"})
    times = s.join(B.draw_counts(s, KEY, SIMS, SEED), [*KEY, "seq"])
    drawn = B.tail_risk(times, KEY, "pnl", weight="times").withColumnsRenamed({"var": "var_bootstrap", "cvar": "cvar_bootstrap"})
    return picks(seen.join(drawn, KEY), KEY, "var_observed", "cvar_observed", "var_bootstrap", "cvar_bootstrap")


@query("B4_risk_of_ruin", sql(BOOT + f"SELECT symbol, {rounded(from_peak='avg((round(coalesce(dd_pct, 0), 9) >= 50)::INT)', from_start=f'avg((round(dd_dollars, 9) >= {START / 2})::INT)')} FROM pa GROUP BY 1", BARS))
def b4(spark, d):
    p = materialise(paths(spark, d), "paths").withColumns({"dd_pct": F.round("dd_pct", 9), "dd_dollars": F.round("dd_dollars", 9)})
    peak, start = B.ruin_share(p, KEY, 0.5, START), B.ruin_share(p, KEY, 0.5, START, from_start=True)
    return picks(peak.withColumnRenamed("ruin_prob", "from_peak").join(start.withColumnRenamed("ruin_prob", "from_start"), KEY), KEY, "from_peak", "from_start")


@query("B5_bootstrap_sharpe", sql(BOOT + f""", lg AS (SELECT symbol, sim, {SHARPE.format(x=LOG_GROWTH)} * sqrt(count(*) / {YEARS}) AS ls FROM bs GROUP BY 1, 2)
  SELECT symbol, {rounded(p50='median(sharpe)', low='quantile_cont(sharpe, 0.025)', high='quantile_cont(sharpe, 0.975)', positive='avg((sharpe > 0)::INT)', log_p50='median(ls)')} FROM pa JOIN lg USING (symbol, sim) GROUP BY 1""", BARS))
def b5(spark, d):
    p = materialise(paths(spark, d), "paths")
    out = B.across_sims(p, KEY, "sharpe", {"p50": 0.5, "low": 0.025, "high": 0.975})
    out = out.join(p.groupBy(*KEY).agg(F.avg((col("sharpe") > 0).cast("int")).alias("positive")), KEY)
    out = out.join(B.across_sims(p, KEY, "log_sharpe", {"log_p50": 0.5}), KEY)
    return picks(out, KEY, "p50", "low", "high", "positive", "log_p50")


@query("B6_win_rate_interval", sql(BOOT + f"SELECT symbol, {rounded(mean='avg(win_rate)', low='quantile_cont(win_rate, 0.025)', high='quantile_cont(win_rate, 0.975)')} FROM pa GROUP BY 1", BARS))
def b6(spark, d):
    p = materialise(paths(spark, d), "paths")
    out = B.across_sims(p, KEY, "win_rate", {"low": 0.025, "high": 0.975}).join(p.groupBy(*KEY).agg(F.avg("win_rate").alias("mean")), KEY)
    return picks(out, KEY, "mean", "low", "high")


@query("B7_win_rate_test", sql(STREAM + f""", f AS (SELECT symbol, count(*) AS n_trades, sum(win)::BIGINT AS observed_wins, 1 / (1 + avg(1.2::DOUBLE)) AS be FROM st GROUP BY 1),
  sm AS (SELECT symbol, sim, sum((('0x' || substr(md5('43|' || sim || '|' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE < be)::INT) AS w FROM st JOIN f USING (symbol), (SELECT unnest(range({SIMS})) AS sim) GROUP BY 1, 2)
  SELECT symbol, n_trades, observed_wins, {rounded(break_even='any_value(be)', null_mean='avg(w / n_trades)', p_value='avg((w >= observed_wins)::INT)')}, avg((w >= observed_wins)::INT) < 0.05 AS significant_05
  FROM sm JOIN f USING (symbol) GROUP BY 1, 2, 3""", BARS))
def b7(spark, d):
    out = B.win_rate_test(stream(spark, d), KEY, F.lit(1.2), SIMS, SEED + 1)
    return picks(out, ["symbol", "n_trades", "observed_wins", "significant_05"], "break_even", "null_mean", "p_value")


@query("B8_block_permutation", sql(f""", b AS (SELECT *, seq // 17 AS blk FROM ordered_trades),
  d AS (SELECT *, row_number() OVER (PARTITION BY combo_id, blk ORDER BY ('0x' || substr(md5('1337|' || combo_id || '|' || blk || '|' || seq), 1, 8))::BIGINT, seq) AS a, row_number() OVER (PARTITION BY combo_id, blk ORDER BY seq) AS c FROM b),
  p AS (SELECT x.seq % 17 AS place, x.r_multiple AS r, y.r_multiple AS rp FROM d x JOIN d y ON y.combo_id = x.combo_id AND y.blk = x.blk AND y.a = x.c)
  SELECT place, count(*) AS n, {rounded(mean_r='avg(r)', mean_permuted='avg(rp)')} FROM p GROUP BY 1""", TRADES))
def b8(spark, d):
    out = B.permute_positions(ordered_trades(spark, d), BY, 17, "r_multiple", 1337)
    return out.groupBy((col("seq") % 17).alias("place")).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("r_multiple")).alias("mean_r"), tidy(F.avg("r_multiple_permuted")).alias("mean_permuted"))


@query("B9_target_shuffle", """WITH h AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY ('0x' || substr(md5('5|' || o_orderkey), 1, 8))::BIGINT, o_orderkey) AS a,
  row_number() OVER (ORDER BY ('0x' || substr(md5('6|' || o_orderkey), 1, 8))::BIGINT, o_orderkey) AS b FROM orders)
  SELECT x.o_orderkey, y.o_totalprice AS shuffled FROM h x JOIN h y ON y.a = x.b""")
def b9(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return B.shuffle_column(o, ["o_orderkey"], "o_totalprice", 5).select("o_orderkey", col("o_totalprice_shuffled").alias("shuffled"))


@query("B10_bootstrap_ece", sql(f""", ask AS (SELECT combo_id, sim, ('0x' || substr(md5('7|' || sim || '|' || seq), 1, 8))::BIGINT % n_combo AS seq FROM ordered_trades, (SELECT unnest(range({ECE_SIMS})) AS sim)),
  g AS (SELECT combo_id, sim, least(floor(pwin * 20), 19) AS bin, count(*) AS n, avg(pwin) AS p, avg(outcome) AS y FROM ask JOIN ordered_trades USING (combo_id, seq) GROUP BY 1, 2, 3),
  e AS (SELECT combo_id, sim, round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM g GROUP BY 1, 2)
  SELECT combo_id, {rounded(low='quantile_cont(ece, 0.025)', p50='median(ece)', high='quantile_cont(ece, 0.975)', below_gate='avg((ece < 0.27)::INT)')} FROM e GROUP BY 1""", TRADES))
def b10(spark, d):
    t = materialise(ordered_trades(spark, d).select(*BY, "seq", "n_combo", "pwin", "outcome"), "ordered")
    sims = B.bootstrap_ece(t, BY, "pwin", "outcome", ECE_SIMS, 7, count="n_combo")
    e = materialise(sims.withColumn("ece", F.round("ece", 9)), "errors")
    out = B.across_sims(e, BY, "ece", {"low": 0.025, "p50": 0.5, "high": 0.975}).join(e.groupBy(*BY).agg(F.avg((col("ece") < 0.27).cast("int")).alias("below_gate")), BY)
    return picks(out, BY, "low", "p50", "high", "below_gate")
