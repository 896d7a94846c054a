"""Performance statistics over the trade table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions import clock
from tradeloom.functions.maths import safe_div, tidy
from tradeloom.operators import ledger as L
from tradeloom.operators import metrics as M
from tradeloom.operators import sweep as W
from tradeloom.operators import trades as X
from tradeloom.operators.ordered import equity_curve, many_quantiles, quantiles, running
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, TRADES, ordered_trades, seq_block, sql, table, ticks, trade_block, trades
from tradeloom.plans.registry import query
from tradeloom.plans.trade_queries import FLAT, fixed_hold_trades

col, r6 = F.col, S.r6
BY = ["combo_id"]
YEARS = 6.84


def picks(df, keys, *names, digits=6):
    return df.select(*keys, *[tidy(col(n), digits).alias(n) for n in names])


def rounded(**cols):
    return ", ".join(f"{r6(e)} AS {n}" for n, e in cols.items())


SHARPE = "coalesce(avg({x}) / nullif(stddev_samp({x}), 0), 0)"
NET_SHARPE = SHARPE.format(x="net_pnl")
PF = """CASE WHEN abs(sum(CASE WHEN {x} < 0 THEN {x} ELSE 0 END)) = 0 THEN 100 ELSE least(100,
  sum(CASE WHEN {x} > 0 THEN {x} ELSE 0 END) / abs(sum(CASE WHEN {x} < 0 THEN {x} ELSE 0 END))) END"""
CURVE = """, curve AS MATERIALIZED (SELECT *, greatest(50000, max(equity) OVER (PARTITION BY combo_id ORDER BY seq)) AS peak
  FROM (SELECT *, 50000 + sum(net_pnl) OVER (PARTITION BY combo_id ORDER BY seq) AS equity FROM ordered_trades)),
dd AS MATERIALIZED (SELECT combo_id, max((peak - equity) / peak) * 100 AS max_drawdown_pct, max(peak - equity) AS max_drawdown_dollars FROM curve GROUP BY 1)"""


@query("A1_combo_metrics", sql("SELECT combo_id, count(*) AS n_trades, " + rounded(
    win_rate="avg(win)", total_return_pct="sum(net_pnl) / 50000 * 100", total_return_dollars="sum(net_pnl)", final_equity="50000 + sum(net_pnl)",
    avg_r_multiple="avg(r_multiple)", median_r_multiple="median(r_multiple)", avg_trade_pnl="avg(net_pnl)", std_trade_pnl="stddev_samp(net_pnl)",
) + " FROM trades GROUP BY 1", TRADES))
def a1(spark, d):
    t = trades(spark, d)
    out = M.trade_metrics(t, BY).join(many_quantiles(t, BY, {"median_r_multiple": (col("r_multiple"), 0.5)}), BY)
    return picks(out, ["combo_id", "n_trades"], "win_rate", "total_return_pct", "total_return_dollars", "final_equity",
                 "avg_r_multiple", "median_r_multiple", "avg_trade_pnl", "std_trade_pnl")


@query("A2_trade_sharpe", sql(f"SELECT combo_id, side, {r6(NET_SHARPE)} AS sharpe FROM trades GROUP BY 1, 2", TRADES))
def a2(spark, d):
    return trades(spark, d).groupBy("combo_id", "side").agg(tidy(M.sharpe(col("net_pnl"))).alias("sharpe"))


@query("A3_annual_sharpe", sql("SELECT combo_id, " + rounded(
    annual_sharpe=f"{NET_SHARPE} * sqrt(count(*) / y)", dollars_per_year="sum(net_pnl) / y") + """
  FROM (SELECT *, (epoch(max(trade_date) OVER ()) - epoch(min(trade_date) OVER ())) / (365.25 * 86400) AS y FROM trades) GROUP BY combo_id, y""", TRADES))
def a3(spark, d):
    t = trades(spark, d)
    years = t.agg(clock.years_between(F.min("trade_date"), F.max("trade_date"))).scalar()
    out = t.groupBy(*BY).agg(M.sharpe(col("net_pnl")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("p")).withColumn("y", years)
    return out.select("combo_id", tidy(col("s") * F.sqrt(col("n") / col("y"))).alias("annual_sharpe"), tidy(col("p") / col("y")).alias("dollars_per_year"))


@query("A4_max_drawdown", sql(CURVE + "SELECT combo_id, " + rounded(max_drawdown_pct="max_drawdown_pct", max_drawdown_dollars="max_drawdown_dollars") + " FROM dd", TRADES))
def a4(spark, d):
    out = M.max_drawdown(trades(spark, d), BY, ["trade_date", "order_no", "line_no", "part_no", "notional"], trade_block(), "net_pnl", X.START_EQUITY)
    return picks(out, BY, "max_drawdown_pct", "max_drawdown_dollars")


@query("A5_drawdown_in_r", sql(f""", c AS (SELECT *, sum(r_multiple) OVER (PARTITION BY combo_id ORDER BY seq) AS e FROM ordered_trades)
  SELECT combo_id, {r6('max(greatest(0, p) - e)')} AS max_drawdown_r FROM (SELECT *, max(e) OVER (PARTITION BY combo_id ORDER BY seq) AS p FROM c) GROUP BY 1""", TRADES))
def a5(spark, d):
    curve = equity_curve(trades(spark, d), BY, ["trade_date", "order_no", "line_no", "part_no", "notional"], trade_block(), col("r_multiple"), 0.0)
    return curve.groupBy(*BY).agg(tidy(F.max(col("peak") - col("equity"))).alias("max_drawdown_r"))


@query("A6_profit_factor", sql(f"SELECT combo_id, flag, {r6(PF.format(x='net_pnl'))} AS profit_factor FROM trades GROUP BY 1, 2", TRADES))
def a6(spark, d):
    return trades(spark, d).groupBy("combo_id", "flag").agg(tidy(M.profit_factor(col("net_pnl"))).alias("profit_factor"))


STREAK = """, st AS MATERIALIZED (SELECT combo_id, max(len)::BIGINT AS max_consecutive_losses FROM (
  SELECT combo_id, g, sum(1 - win) AS len FROM (SELECT *, sum(win) OVER (PARTITION BY combo_id ORDER BY seq) AS g FROM ordered_trades)
  GROUP BY 1, 2) GROUP BY 1)"""


@query("A7_losing_streak", sql(STREAK + "SELECT * FROM st", TRADES))
def a7(spark, d):
    return M.losing_streak(trades(spark, d), BY, ["trade_date", "order_no", "line_no", "part_no", "notional"], trade_block())


@query("A8_calmar", sql(CURVE + STREAK + f"""SELECT combo_id, max_consecutive_losses, {r6('sum(net_pnl) / 50000 * 100 / greatest(any_value(max_drawdown_pct), 0.01)')} AS calmar_ratio
  FROM trades JOIN dd USING (combo_id) JOIN st USING (combo_id) GROUP BY 1, 2""", TRADES))
def a8(spark, d):
    out = M.full_metrics(trades(spark, d), BY, ["trade_date", "order_no", "line_no", "part_no", "notional"], trade_block())
    return picks(out, ["combo_id", "max_consecutive_losses"], "calmar_ratio")


@query("A9_merged_moments", sql("SELECT combo_id, count(*) AS n, " + rounded(mean="avg(r_multiple)", std="stddev_samp(r_multiple)") + " FROM trades GROUP BY 1", TRADES))
def a9(spark, d):
    parts = M.partial_moments(trades(spark, d), BY, [F.year("trade_date").alias("y")], "r_multiple")
    return picks(M.merge_moments(parts, BY), ["combo_id", "n"], "mean", "std")


@query("A10_moments_from_sums", sql("SELECT combo_id, count(*) AS n, " + rounded(mean="avg(net_pnl)", std="stddev_samp(net_pnl)") + " FROM trades GROUP BY 1", TRADES))
def a10(spark, d):
    return picks(M.moments_from_sums(trades(spark, d), BY, "net_pnl"), ["combo_id", "n"], "mean", "std")


def wf_sql(least):
    return f""", wf AS (SELECT combo_id, w, count(*) AS n, avg(gross_pnl - 5) / nullif(stddev_samp(gross_pnl - 5), 0) * sqrt(count(*) * 5 / 5.8056) AS s
    FROM (SELECT *, (SELECT count(*) FROM range(1, 5) e(i) WHERE seq >= floor(n_combo * i / 5.0::DOUBLE)) AS w FROM ordered_trades WHERE n_combo >= {least}) GROUP BY 1, 2),
  wr AS MATERIALIZED (SELECT combo_id, count(*) AS n_valid_windows, median(s) AS med, coalesce(stddev_samp(s), 0) AS sd FROM wf WHERE n >= 30 AND s IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 4)"""


WF_OUT = "SELECT combo_id, n_valid_windows, " + rounded(median_wf_sharpe="med", std_wf_sharpe="sd", robust_sharpe="med - 0.5 * sd") + " FROM wr"


@query("A11_walk_forward", sql(wf_sql(500) + WF_OUT, TRADES))
def a11(spark, d):
    out = M.walk_forward(ordered_trades(spark, d), BY, col("gross_pnl") - 5.0)
    return picks(out, ["combo_id", "n_valid_windows"], "median_wf_sharpe", "std_wf_sharpe", "robust_sharpe")


@query("A11b_walk_forward_gate", sql(wf_sql(600) + WF_OUT, TRADES))
def a11b(spark, d):
    out = M.walk_forward(ordered_trades(spark, d), BY, col("gross_pnl") - 5.0, min_trades=600)
    return picks(out, ["combo_id", "n_valid_windows"], "median_wf_sharpe", "std_wf_sharpe", "robust_sharpe")


AUDIT = {
    "audit_full_net_sharpe": SHARPE.format(x="gross_pnl - 5") + " * sqrt(count(*) / 5.8056)",
    "audit_full_gross_sharpe": SHARPE.format(x="gross_pnl") + " * sqrt(count(*) / 5.8056)",
    "audit_gross_net_gap": "(" + SHARPE.format(x="gross_pnl") + " - " + SHARPE.format(x="gross_pnl - 5") + ") * sqrt(count(*) / 5.8056)",
    "audit_gross_win_rate": "avg(win)",
    "audit_cost_as_pct_of_edge": "CASE WHEN avg(gross_pnl) > 0 THEN 5 / greatest(avg(gross_pnl), 1e-6) END",
    "audit_median_stop_pts": "median(stop_pts)",
    "audit_median_hold_bars": "median(hold_bars)",
    "audit_p90_hold_bars": "quantile_cont(hold_bars::DOUBLE, 0.9)",
    "audit_median_mfe_pts": "median(mfe_pts)",
    "audit_median_mae_pts": "median(mae_pts)",
    "audit_median_mfe_mae_ratio": "median(coalesce(mfe_pts / nullif(abs(mae_pts), 0), 0))",
    "audit_zscore_entry_median_abs": "median(abs(zscore_entry))",
}


@query("A12_audit_columns", sql("SELECT combo_id, count(*) AS audit_n_trades, " + rounded(**AUDIT) + " FROM trades GROUP BY 1", TRADES))
def a12(spark, d):
    return picks(M.audit_columns(trades(spark, d), BY), ["combo_id", "audit_n_trades"], *AUDIT)


def half(p, cond):
    x = f"CASE WHEN {cond} THEN 500 * r_multiple END"
    won, lost = f"sum(CASE WHEN {cond} AND r_multiple > 0 THEN 500 * r_multiple ELSE 0 END)", f"sum(CASE WHEN {cond} AND r_multiple < 0 THEN -500 * r_multiple ELSE 0 END)"
    r = f"CASE WHEN {cond} THEN r_multiple END"
    return {
        f"{p}_wr": f"avg(CASE WHEN {cond} THEN win END)", f"{p}_avg_r": f"avg({r})", f"{p}_sharpe": SHARPE.format(x=r),
        f"{p}_pf": f"{won} / nullif({lost}, 0)", f"{p}_total_pnl": f"sum({x})", f"{p}_max_dd": f"max(CASE WHEN {cond} THEN pk - eq END)",
    }


EARLY, LATE = "seq < floor(0.8::DOUBLE * n_combo)", "seq >= floor(0.8::DOUBLE * n_combo)"
HALVES = {**half("early", EARLY), **half("late", LATE)}
SPLIT = f""", eq AS (SELECT *, {EARLY} AS early, sum(500 * r_multiple) OVER (PARTITION BY combo_id, {EARLY} ORDER BY seq) AS eq FROM ordered_trades),
pk AS (SELECT *, max(eq) OVER (PARTITION BY combo_id, early ORDER BY seq) AS pk FROM eq),
halves AS MATERIALIZED (SELECT combo_id, (count(*) FILTER (WHERE {EARLY})) AS early_n, (count(*) FILTER (WHERE {LATE})) AS late_n,
  """ + ", ".join(f"{e} AS {n}" for n, e in HALVES.items()) + " FROM pk GROUP BY 1)"


def halves(spark, d):
    return M.early_late(ordered_trades(spark, d), BY, seq_block())


@query("A13_early_late", sql(SPLIT + "SELECT combo_id, early_n, late_n, " + rounded(**{n: n for n in HALVES}) + " FROM halves", TRADES))
def a13(spark, d):
    return picks(halves(spark, d), ["combo_id", "early_n", "late_n"], *HALVES)


SCORES = {
    "C1_sharpe_log_n": "early_sharpe * ln(1 + early_n)", "C2_avg_r_root_n": "early_avg_r * sqrt(early_n)", "C3_avg_r_n": "early_avg_r * early_n",
    "C4_pf_log_n": "CASE WHEN early_pf IS NOT NULL THEN least(greatest(early_pf, 0), 10) END * ln(1 + early_n)",
    "C5_sharpe": "early_sharpe", "C6_avg_r": "early_avg_r", "C7_wr_edge_root_n": "(early_wr - 0.5) * sqrt(early_n)",
    "C8_pnl_minus_dd": "early_total_pnl - early_max_dd", "C9_return_per_dd": "early_avg_r / nullif(sqrt(early_max_dd), 0)",
}
SCORED = SPLIT + ", sc AS MATERIALIZED (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in SCORES.items()) + " FROM halves)"


@query("A14_composites", sql(SCORED + "SELECT combo_id, " + rounded(**{n: n for n in SCORES}) + " FROM sc", TRADES))
def a14(spark, d):
    return picks(M.composites(halves(spark, d)), BY, *SCORES)


@query("A15_daily_ledger", sql(f""", sp AS (SELECT side, unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY))::DATE AS day FROM trades GROUP BY 1),
  dy AS (SELECT side, trade_date AS day, count(*) AS n, sum(net_pnl) AS p FROM trades GROUP BY 1, 2)
  SELECT side, strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n_trades, {r6('coalesce(p, 0)')} AS pnl_day,
    {r6('50000 + sum(coalesce(p, 0)) OVER (PARTITION BY side ORDER BY day)')} AS equity_eod FROM sp LEFT JOIN dy USING (side, day)""", TRADES))
def a15(spark, d):
    out = L.daily_ledger(trades(spark, d), ["side"], "trade_date", "net_pnl", X.START_EQUITY)
    return picks(out, ["side", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_trades"], "pnl_day", "equity_eod")


@query("A16_trader_log", sql(f"""SELECT combo_id, seq, side, {r6('net_pnl')} AS net_pnl,
  {r6('sum(net_pnl) OVER (PARTITION BY combo_id ORDER BY seq)')} AS cumulative_pnl FROM ordered_trades""", TRADES))
def a16(spark, d):
    out = running(ordered_trades(spark, d), BY, ["seq"], seq_block(), sums={"cumulative_pnl": col("net_pnl")})
    return picks(out, ["combo_id", "seq", "side"], "net_pnl", "cumulative_pnl")


@query("A17_daily_sharpe", sql(CURVE + """, ld AS (SELECT combo_id, trade_date, arg_max(equity, seq) AS e FROM curve GROUP BY 1, 2),
  rt AS (SELECT *, e / nullif(lag(e) OVER (PARTITION BY combo_id ORDER BY trade_date), 0) - 1 AS ret FROM ld)
  SELECT combo_id, """ + rounded(daily_sharpe="coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0)", total_return="max_by(e, trade_date) / 50000 - 1") + " FROM rt GROUP BY 1", TRADES))
def a17(spark, d):
    curve = equity_curve(ordered_trades(spark, d), BY, ["seq"], seq_block(), col("net_pnl"), X.START_EQUITY)
    days = L.daily_returns(curve, BY, "trade_date", "seq")
    return days.groupBy(*BY).agg(tidy(M.sharpe(col("ret")) * F.sqrt(F.lit(252.0))).alias("daily_sharpe"),
                                 tidy(F.max_by("equity", "day") / X.START_EQUITY - 1.0).alias("total_return"))


@query("A18_exit_counts", sql("""SELECT combo_id, (count(*) FILTER (WHERE flag = 'A')) AS A, (count(*) FILTER (WHERE flag = 'N')) AS N, (count(*) FILTER (WHERE flag = 'R')) AS R FROM trades GROUP BY 1""", TRADES))
def a18(spark, d):
    return trades(spark, d).groupBy(*BY).pivot("flag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)


def quartile(df, x):
    """0..3 by right-closed quartile edges over the whole table."""
    edges = quantiles(df, [], x, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return df.withColumn("_q", edges.select(F.array("q1", "q2", "q3")).scalar()).withColumn(
        f"{x}_q", sum(((col(x) > col("_q")[i]).cast("int") for i in range(3)), F.lit(0))).drop("_q")


def sql_quart(x):
    return f"(({x} > q[1])::INT + ({x} > q[2])::INT + ({x} > q[3])::INT)"


@query("A19_win_by_quartile", sql(f""", e AS (SELECT quantile_cont(notional, [0.25, 0.5, 0.75]) AS q FROM trades)
  SELECT {sql_quart('notional')} AS quartile, count(*) AS n, {r6('avg(win)')} AS win_rate FROM trades, e GROUP BY 1""", TRADES))
def a19(spark, d):
    t = quartile(trades(spark, d), "notional")
    return t.groupBy(col("notional_q").alias("quartile")).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("win")).alias("win_rate"))


@query("A20_quartile_pivot", sql(f""", e AS (SELECT quantile_cont(notional, [0.25, 0.5, 0.75]) AS q FROM trades), f AS (SELECT quantile_cont(part_no::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM trades),
  g AS (SELECT win, {sql_quart('notional')} AS a, b FROM (SELECT win, notional, ((part_no > f.q[1])::INT + (part_no > f.q[2])::INT + (part_no > f.q[3])::INT) AS b FROM trades, f), e)
  SELECT b AS row_q, """ + ", ".join(f"(count(*) FILTER (WHERE a = {i})) AS n_{i}, {r6(f'avg(CASE WHEN a = {i} THEN win END) * 100')} AS win_{i}" for i in range(4)) + " FROM g GROUP BY 1", TRADES))
def a20(spark, d):
    t = quartile(quartile(trades(spark, d).withColumn("part_no", col("part_no").cast("double")), "notional"), "part_no")
    cells = t.groupBy(col("part_no_q").alias("row_q")).pivot("notional_q", [0, 1, 2, 3]).agg(F.count(F.lit(1)).alias("n"), (F.avg("win") * 100.0).alias("win"))
    return cells.select("row_q", *[F.coalesce(col(f"{i}_n"), F.lit(0)).alias(f"n_{i}") for i in range(4)], *[tidy(col(f"{i}_win")).alias(f"win_{i}") for i in range(4)])


@query("A21_ratio_summary", sql(f"""SELECT label, count(x) AS n, {rounded(mean='avg(x)', median='median(x)', p75='quantile_cont(x, 0.75)', max='max(x)')}
  FROM (SELECT unnest(['all', CASE WHEN win = 1 THEN 'win' ELSE 'loss' END]) AS label, CASE WHEN abs(mae_pts) >= 0.25 THEN mfe_pts / abs(mae_pts) END AS x FROM trades) GROUP BY 1""", TRADES))
def a21(spark, d):
    label = F.explode(F.array(F.lit("all"), F.when(col("win") == 1, "win").otherwise("loss")))
    t = trades(spark, d).select(label.alias("label"), X.path_ratio(col("mfe_pts"), col("mae_pts")).alias("x"))
    out = t.groupBy("label").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("max"))
    return picks(out.join(quantiles(t, ["label"], "x", {"median": 0.5, "p75": 0.75}), "label"), ["label", "n"], "mean", "median", "p75", "max")


PER = f", per AS MATERIALIZED (SELECT combo_id, count(*) AS n_trades, {NET_SHARPE} AS sharpe_ratio, avg(r_multiple) AS avg_r, sum(net_pnl) AS pnl, avg(win) AS win_rate, {PF.format(x='net_pnl')} AS pf FROM trades GROUP BY 1)"


def per_combo(spark, d):
    return M.trade_metrics(trades(spark, d), BY)


@query("A22_thresholds_quantiles", sql(PER + "SELECT count(*) AS n, " + ", ".join(f"(count(*) FILTER (WHERE sharpe_ratio >= {t})) AS ge_{i}" for i, t in enumerate((-0.1, 0.0, 0.1))) + ", "
                                       + rounded(p50="median(sharpe_ratio)", p90="quantile_cont(sharpe_ratio, 0.9)", p99="quantile_cont(sharpe_ratio, 0.99)", top="max(sharpe_ratio)") + " FROM per", TRADES))
def a22(spark, d):
    p = per_combo(spark, d)
    marks = quantiles(p, [], "sharpe_ratio", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    counts = p.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col("sharpe_ratio") >= t).alias(f"ge_{i}") for i, t in enumerate((-0.1, 0.0, 0.1))], F.max("sharpe_ratio").alias("top"))
    out = counts.withColumns({c: marks.select(c).scalar() for c in ("p50", "p90", "p99")})
    return picks(out, ["n", "ge_0", "ge_1", "ge_2"], "p50", "p90", "p99", "top")


EDGES = [0, 10, 20, 25, 30, 35, 40, 50, 100, 200, 400, 800]


@query("A23_log_histogram", sql(f""", p AS (SELECT part_no, count(*) AS n FROM trades GROUP BY 1)
  SELECT {' + '.join(f'(n >= {e})::INT' for e in EDGES)} - 1 AS bucket, count(*) AS n_parts, {r6('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM p GROUP BY 1""", TRADES))
def a23(spark, d):
    p = trades(spark, d).groupBy("part_no").agg(F.count(F.lit(1)).alias("n"))
    b = p.groupBy(sum(((col("n") >= e).cast("int") for e in EDGES), F.lit(-1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_parts"))
    return b.select("bucket", "n_parts", tidy(col("n_parts") * 100.0 / b.agg(F.sum("n_parts")).scalar()).alias("pct"))


@query("A24_best_per_band", sql(PER + f"""SELECT band, n_in_band, combo_id, {r6('sharpe_ratio')} AS best FROM (
  SELECT *, n_trades // 25 AS band, count(*) OVER (PARTITION BY n_trades // 25) AS n_in_band,
    row_number() OVER (PARTITION BY n_trades // 25 ORDER BY round(sharpe_ratio, 9) DESC, combo_id) AS rn FROM per) WHERE rn = 1""", TRADES))
def a24(spark, d):
    p = per_combo(spark, d).withColumns({"band": F.floor(col("n_trades") / 25), "s": F.round("sharpe_ratio", 9)})
    best = F.max_by(F.struct("combo_id", "sharpe_ratio"), F.struct(col("s"), -col("combo_id")))
    out = p.groupBy("band").agg(F.count(F.lit(1)).alias("n_in_band"), best.alias("b"))
    return out.select("band", "n_in_band", "b.combo_id", tidy(col("b.sharpe_ratio")).alias("best"))


STATUS = "CASE WHEN sharpe_ratio >= 0.01 AND n_trades >= 600 THEN 'pass' WHEN sharpe_ratio >= -0.01 THEN 'near_miss' ELSE 'fail' END"


def statuses(spark, d):
    p = per_combo(spark, d).withColumn("mode", F.when(col("n_trades") >= 600, "high").otherwise("low"))
    s, n = F.round("sharpe_ratio", 9), col("n_trades")
    return p.withColumn("status", F.when((s >= 0.01) & (n >= 600), "pass").when(s >= -0.01, "near_miss").otherwise("fail"))


@query("A25_stratified_counts", sql(PER + f"""SELECT coalesce(mode, 'overall') AS mode, coalesce(status, 'any') AS status, count(*) AS n, min(combo_id) AS first_id, max(combo_id) AS last_id
  FROM (SELECT *, CASE WHEN n_trades >= 600 THEN 'high' ELSE 'low' END AS mode, {STATUS.replace('sharpe_ratio', 'round(sharpe_ratio, 9)')} AS status FROM per) GROUP BY ROLLUP (mode, status)""", TRADES))
def a25(spark, d):
    out = statuses(spark, d).rollup("mode", "status").agg(F.count(F.lit(1)).alias("n"), F.min("combo_id").alias("first_id"), F.max("combo_id").alias("last_id"))
    return out.withColumns({"mode": F.coalesce("mode", F.lit("overall")), "status": F.coalesce("status", F.lit("any"))})


@query("A25b_stratified_ids", sql(PER + f"""SELECT CASE WHEN n_trades >= 600 THEN 'high' ELSE 'low' END AS mode, {STATUS.replace('sharpe_ratio', 'round(sharpe_ratio, 9)')} AS status, combo_id FROM per""", TRADES))
def a25b(spark, d):
    return statuses(spark, d).select("mode", "status", "combo_id")


@query("A26_cell_coverage", sql(f""", c AS (SELECT line_no, stop_pts, hold_bars % 3 AS h, count(DISTINCT combo_id) AS n FROM trades GROUP BY 1, 2, 3)
  SELECT line_no, count(*) AS n_cells, min(n) AS least, {r6('median(n)')} AS median, max(n) AS most FROM c GROUP BY 1""", TRADES))
def a26(spark, d):
    cells = trades(spark, d).groupBy("line_no", "stop_pts", col("hold_bars") % 3).agg(F.count_distinct("combo_id").alias("n"))
    facts = cells.groupBy("line_no").agg(F.count(F.lit(1)).alias("n_cells"), F.min("n").alias("least"), F.max("n").alias("most"))
    return picks(facts.join(quantiles(cells, ["line_no"], "n", {"median": 0.5}), "line_no"), ["line_no", "n_cells", "least", "most"], "median")


@query("A27_data_quality", sql("""SELECT combo_id, n, bad_mfe, bad_mae, bad_stop, n_null, CASE WHEN n_null > 0 OR bad_stop > 0 THEN 'CRITICAL' WHEN bad_mfe + bad_mae > 0 THEN 'WARN' ELSE 'OK' END AS status
  FROM (SELECT combo_id, count(*) AS n, (count(*) FILTER (WHERE mfe_pts <= 0)) AS bad_mfe, (count(*) FILTER (WHERE mae_pts > 0)) AS bad_mae,
    (count(*) FILTER (WHERE stop_pts <= 0)) AS bad_stop, (count(*) FILTER (WHERE mfe_pts IS NULL OR mae_pts IS NULL OR stop_pts IS NULL)) AS n_null FROM trades GROUP BY 1)""", TRADES))
def a27(spark, d):
    missing = col("mfe_pts").isNull() | col("mae_pts").isNull() | col("stop_pts").isNull()
    out = trades(spark, d).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(col("mfe_pts") <= 0).alias("bad_mfe"), F.count_if(col("mae_pts") > 0).alias("bad_mae"),
        F.count_if(col("stop_pts") <= 0).alias("bad_stop"), F.count_if(missing).alias("n_null"))
    bad = (col("n_null") > 0) | (col("bad_stop") > 0)
    return out.withColumn("status", F.when(bad, "CRITICAL").when(col("bad_mfe") + col("bad_mae") > 0, "WARN").otherwise("OK"))


@query("A28_sweep_status", """SELECT message, n, n_completed FROM (SELECT substr(o_orderpriority, 1, 6) AS message, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_completed FROM orders GROUP BY 1) ORDER BY n DESC, message LIMIT 3""")
def a28(spark, d):
    o = table(spark, d, "orders")
    done = o.filter(col("o_orderstatus") == "F").agg(F.count(F.lit(1))).scalar()
    errors = o.groupBy(F.substring("o_orderpriority", 1, 6).alias("message")).agg(F.count_if(col("o_orderstatus") != "F").alias("n"))
    return errors.orderBy(F.desc("n"), "message").limit(3).withColumn("n_completed", done)


def sql_rank(x, part=""):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0::DOUBLE)"


@query("A29_correlations", sql(PER + f"""SELECT {r6('corr(n_trades, sharpe_ratio)')} AS pearson, {r6('corr(a, b)')} AS spearman
  FROM (SELECT *, {sql_rank('n_trades')} AS a, {sql_rank('sharpe_ratio')} AS b FROM per)""", TRADES))
def a29(spark, d):
    p = per_combo(spark, d)
    rho = M.spearman(p, [], ["combo_id"], "n_trades", "sharpe_ratio").select("rho").scalar()
    return p.agg(tidy(F.corr("n_trades", "sharpe_ratio")).alias("pearson")).withColumn("spearman", tidy(rho))


TRUTHS = ["late_total_pnl", "late_sharpe", "late_avg_r", "late_pf", "late_wr"]
SP_LONG = SCORED + ", lg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS score, '{t}' AS truth, {c}::DOUBLE AS x, {t}::DOUBLE AS y FROM sc" for c in SCORES for t in TRUTHS) + ")"
SP_TABLE = SP_LONG + f""", rk AS (SELECT score, truth, {sql_rank('x', 'score, truth')} AS rx, {sql_rank('y', 'score, truth')} AS ry
  FROM (SELECT score, truth, round(x, 9) AS x, round(y, 9) AS y FROM lg WHERE x IS NOT NULL AND y IS NOT NULL))"""


@query("A30_spearman_table", sql(SP_TABLE + f"SELECT score, truth, count(*) AS n_pairs, {r6('corr(rx, ry)')} AS rho FROM rk GROUP BY 1, 2", TRADES))
def a30(spark, d):
    t = M.composites(halves(spark, d))
    t = t.withColumns({c: F.round(c, 9) for c in [*M.COMPOSITES, *TRUTHS]})
    return picks(M.spearman_table(t, "combo_id", M.COMPOSITES, TRUTHS), ["score", "truth", "n_pairs"], "rho")


@query("A31_daily_correlation", sql(f""", g AS (SELECT side || flag AS member, trade_date, sum(net_pnl) AS p FROM trades GROUP BY 1, 2),
  m AS (SELECT DISTINCT member FROM g), dd AS (SELECT DISTINCT trade_date FROM g),
  f AS (SELECT m.member, dd.trade_date, coalesce(p, 0) AS p FROM m CROSS JOIN dd LEFT JOIN g USING (member, trade_date))
  SELECT a.member AS member_a, b.member AS member_b, count(*) AS n_days, {r6('corr(a.p, b.p)')} AS corr FROM f a JOIN f b USING (trade_date) GROUP BY 1, 2""", TRADES))
def a31(spark, d):
    t = trades(spark, d).withColumn("member", F.concat("side", "flag"))
    return picks(L.correlation_matrix(t, "member", "trade_date", "net_pnl"), ["member_a", "member_b", "n_days"], "corr")


ZCOLS = ["C1_sharpe_log_n", "C4_pf_log_n", "C8_pnl_minus_dd"]


@query("A32_meta_target", sql(SCORED + "SELECT combo_id, " + rounded(meta="(" + " + ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())" for c in ZCOLS) + ") / 3") + " FROM sc", TRADES))
def a32(spark, d):
    z = M.standardised(M.composites(halves(spark, d)), ZCOLS)
    return z.select("combo_id", tidy(sum((col(f"z_{c}") for c in ZCOLS), F.lit(0.0)) / 3.0).alias("meta"))


@query("A33_welch_t", sql(f""", a AS (SELECT combo_id, (count(*) FILTER (WHERE flag = 'R')) AS n_a, (count(*) FILTER (WHERE flag = 'A')) AS n_b, avg(CASE WHEN flag = 'R' THEN net_pnl END) AS ma,
    avg(CASE WHEN flag = 'A' THEN net_pnl END) AS mb, var_samp(CASE WHEN flag = 'R' THEN net_pnl END) AS va, var_samp(CASE WHEN flag = 'A' THEN net_pnl END) AS vb FROM trades GROUP BY 1),
  t AS (SELECT *, n_a < 200 OR n_b < 200 AS short, CASE WHEN n_a >= 200 AND n_b >= 200 THEN (ma - mb) / nullif(sqrt(va / n_a + vb / n_b), 0) END AS t FROM a)
  SELECT combo_id, n_a, n_b, short AS insufficient_n, {r6('t')} AS welch_t, coalesce(t >= 2, false) AS gate_pass FROM t""", TRADES))
def a33(spark, d):
    out = M.welch(trades(spark, d), BY, "flag", "R", "A", "net_pnl", least=200)
    return picks(out, ["combo_id", "n_a", "n_b", "insufficient_n", "gate_pass"], "welch_t")


MOD = "(hour(ts) * 60 + minute(ts))"
SESS = f"CASE WHEN {MOD} >= 570 AND {MOD} < 960 THEN 'rth' WHEN {MOD} >= 960 AND {MOD} < 1080 THEN 'post' ELSE 'overnight' END"


@query("A34_session_share", f"""WITH s AS (SELECT event_type AS symbol, {SESS} AS session, value - 50 AS pnl FROM events),
  g AS (SELECT symbol, session, count(*) AS n, sum(pnl) AS p FROM s GROUP BY 1, 2)
  SELECT symbol, session, n, {r6('p / sum(p) OVER w')} AS dollar_share, {r6('n / sum(n) OVER w')} AS count_share,
    CASE WHEN abs(p) / sum(abs(p)) OVER w >= 0.6 THEN 'dominant' WHEN n / sum(n) OVER w >= 0.6 THEN 'busy' ELSE 'mixed' END AS label FROM g WINDOW w AS (PARTITION BY symbol)""")
def a34(spark, d):
    minute = clock.minute_of_day(col("time"))
    masks = clock.session_masks(minute)
    session = F.when(masks["rth"], "rth").when(masks["post_rth"], "post").otherwise("overnight")
    g = ticks(spark, d).groupBy("symbol", session.alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum(col("value") - 50.0).alias("p"))
    totals = g.groupBy("symbol").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.sum(F.abs("p")).alias("ta"))
    g = g.join(totals, "symbol")
    label = F.when(F.abs("p") / col("ta") >= 0.6, "dominant").when(col("n") / col("tn") >= 0.6, "busy").otherwise("mixed")
    return g.select("symbol", "session", "n", tidy(col("p") / col("tp")).alias("dollar_share"), tidy(col("n") / col("tn")).alias("count_share"), label.alias("label"))


GATED = PER + f", gt AS MATERIALIZED (SELECT *, round(sharpe_ratio * sqrt(n_trades / {YEARS}), 9) >= -0.2 AS ok_sharpe, n_trades >= 590 AS ok_n, round(pnl / {YEARS}, 6) >= -300 AS ok_dollars FROM per)"


def gated(spark, d):
    p = per_combo(spark, d)
    g = M.gates(F.round(col("sharpe_ratio") * F.sqrt(col("n_trades") / YEARS), 9), col("n_trades"), F.round(col("total_return_dollars") / YEARS, 6), -0.2, 590, -300.0)
    return p.withColumns(g)


@query("A35_three_part_gate", sql(GATED + "SELECT combo_id, ok_sharpe, ok_n, ok_dollars, ok_sharpe AND ok_n AND ok_dollars AS gate_pass FROM gt", TRADES))
def a35(spark, d):
    return gated(spark, d).select("combo_id", "ok_sharpe", "ok_n", "ok_dollars", "gate_pass")


@query("A36_regime_halves", sql(f"""SELECT combo_id, half, n, share, {r6('s * sqrt(n / (y * share))')} AS annual_sharpe FROM (
  SELECT combo_id, CASE WHEN trade_date < DATE '1998-06-01' THEN 'first' ELSE 'second' END AS half, count(*) AS n, {SHARPE.format(x='net_pnl')} AS s, {YEARS} AS y FROM trades GROUP BY 1, 2)
  JOIN (SELECT CASE WHEN trade_date < DATE '1998-06-01' THEN 'first' ELSE 'second' END AS half, round(count(DISTINCT trade_date) / (SELECT count(DISTINCT trade_date) FROM trades), 9) AS share FROM trades GROUP BY 1) USING (half)""", TRADES))
def a36(spark, d):
    half = F.when(col("trade_date") < F.lit("1998-06-01").cast("date"), "first").otherwise("second")
    t = trades(spark, d).withColumn("half", half)
    days = t.select("half", "trade_date").distinct()
    total = days.select("trade_date").distinct().agg(F.count(F.lit(1))).scalar()
    share = days.groupBy("half").agg(F.count(F.lit(1)).alias("k")).select("half", F.round(col("k") / total, 9).alias("share"))
    out = t.groupBy("combo_id", "half").agg(F.count(F.lit(1)).alias("n"), M.sharpe(col("net_pnl")).alias("s")).join(F.broadcast(share), "half")
    return out.select("combo_id", "half", "n", "share", tidy(col("s") * F.sqrt(col("n") / (col("share") * YEARS))).alias("annual_sharpe"))


@query("A37_variant_session_grid", sql(FLAT + f""", v AS (SELECT symbol, bar_idx, unnest([4, 8, 12, 24]) AS hold FROM sigs WHERE signal <> 0),
  tr AS (SELECT v.symbol, v.hold, (x.close - f.entry_price) * s.signal - 1 AS pnl, hour(b.time) * 60 + minute(b.time) AS m
    FROM v JOIN sigs s USING (symbol, bar_idx) JOIN fixed f USING (symbol, bar_idx) JOIN bars b USING (symbol, bar_idx) JOIN bars x ON x.symbol = v.symbol AND x.bar_idx = v.bar_idx + v.hold),
  se AS (SELECT *, CASE WHEN m >= 720 AND m < 840 THEN 'lunch' WHEN m >= 570 AND m < 960 THEN 'rth' WHEN m >= 960 AND m < 1080 THEN 'post' ELSE 'overnight' END AS session FROM tr),
  gr AS (SELECT h.hold, q.session FROM (SELECT unnest([4, 8, 12, 24]) AS hold) h, (SELECT unnest(['lunch', 'rth', 'post', 'overnight']) AS session) q),
  ce AS (SELECT gr.hold, gr.session, count(pnl) AS n, {SHARPE.format(x='pnl')} AS s FROM gr LEFT JOIN se USING (hold, session) GROUP BY 1, 2)
  SELECT hold, session, n, {r6('s')} AS sharpe, n >= 10 AND s >= 0 AS cell_pass, (count(*) FILTER (WHERE n >= 10 AND s >= 0) OVER ()) >= 8 AS grid_pass FROM ce""", BARS))
def a37(spark, d):
    holds, sessions = [4, 8, 12, 24], ["lunch", "rth", "post", "overnight"]
    frames = [fixed_hold_trades(spark, d, h).withColumn("hold", F.lit(h)) for h in holds]
    t = frames[0]
    for f in frames[1:]:
        t = t.unionByName(f)
    masks = clock.session_masks(clock.minute_of_day(col("time")))
    session = F.when(masks["lunch"], "lunch").when(masks["rth"], "rth").when(masks["post_rth"], "post").otherwise("overnight")
    cells = t.groupBy("hold", session.alias("session")).agg(F.count(F.lit(1)).alias("n"), M.sharpe(col("pts") - 1.0).alias("s"))
    grid = W.product(spark.range(1), hold=holds, session=sessions).drop("id")
    out = grid.join(cells, ["hold", "session"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})
    out = out.withColumn("cell_pass", (col("n") >= 10) & (col("s") >= 0))
    passed = out.agg(F.count_if("cell_pass") >= 8).scalar()
    return out.select("hold", "session", "n", tidy(col("s")).alias("sharpe"), "cell_pass", passed.alias("grid_pass"))


@query("A38_branch_routing", sql(GATED + """SELECT combo_id, CASE WHEN NOT ok_n THEN 'thin' WHEN ok_sharpe AND ok_dollars THEN 'promote' WHEN ok_sharpe THEN 'watch_dollars'
  WHEN ok_dollars THEN 'watch_sharpe' ELSE 'reject' END AS branch FROM gt""", TRADES))
def a38(spark, d):
    g = gated(spark, d)
    branch = (F.when(~col("ok_n"), "thin").when(col("ok_sharpe") & col("ok_dollars"), "promote").when(col("ok_sharpe"), "watch_dollars")
              .when(col("ok_dollars"), "watch_sharpe").otherwise("reject"))
    return g.select("combo_id", branch.alias("branch"))


@query("A39_variance_split", sql(f""", g AS (SELECT combo_id, count(*) AS n, avg(r_multiple) AS m, var_pop(r_multiple) AS v FROM trades GROUP BY 1 HAVING count(*) >= 50),
  s AS (SELECT count(*) AS n_groups, stddev_pop(m) AS b, sqrt(sum(v * n) / sum(n)) AS w FROM g)
  SELECT n_groups, {rounded(between_std='b', within_std='w', ratio='w / b')}, CASE WHEN w / b >= 1 THEN 'dynamic' WHEN w / b >= 0.3 THEN 'partial' ELSE 'identity_proxy' END AS verdict FROM s""", TRADES))
def a39(spark, d):
    return picks(M.variance_split(trades(spark, d), "combo_id", "r_multiple"), ["n_groups", "verdict"], "between_std", "within_std", "ratio")


@query("A40_share_better", sql(SPLIT + f"SELECT count(*) AS n, {r6('avg((round(late_sharpe, 9) > round(early_sharpe, 9))::INT)')} AS share_better FROM halves", TRADES))
def a40(spark, d):
    better = (F.round("late_sharpe", 9) > F.round("early_sharpe", 9)).cast("int")
    return halves(spark, d).agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(better)).alias("share_better"))


@query("A41_equity_curves", sql(CURVE + "SELECT combo_id, seq, exit_bar, " + rounded(equity="equity", drawdown="peak - equity") + " FROM curve", TRADES))
def a41(spark, d):
    c = equity_curve(ordered_trades(spark, d), BY, ["seq"], seq_block(), col("net_pnl"), X.START_EQUITY)
    return picks(c.withColumn("drawdown", col("peak") - col("equity")), ["combo_id", "seq", "exit_bar"], "equity", "drawdown")


POLICIES = {"fixed_500": 500.0, "share_5": 2500.0, "one_lot": None}
POL = """, po AS (SELECT *, CASE policy WHEN 'fixed_500' THEN floor(500.0::DOUBLE / (stop_pts * 2)) WHEN 'share_5' THEN floor(2500.0::DOUBLE / (stop_pts * 2)) ELSE 1 END AS k
  FROM ordered_trades, (SELECT unnest(['fixed_500', 'share_5', 'one_lot']) AS policy)), pn AS (SELECT *, (gross_pnl - 5) * k AS p FROM po),
pe AS (SELECT *, 50000 + sum(p) OVER (PARTITION BY policy, combo_id ORDER BY seq) AS e FROM pn),
pk AS (SELECT *, greatest(50000, max(e) OVER (PARTITION BY policy, combo_id ORDER BY seq)) AS k2 FROM pe)"""


@query("A42_sizing_policies", sql(POL + "SELECT combo_id, policy, count(*) AS n_trades, " + rounded(total="sum(p)", sharpe=SHARPE.format(x="p"), max_drawdown_dollars="max(k2 - e)") + " FROM pk GROUP BY 1, 2", TRADES))
def a42(spark, d):
    t = W.product(ordered_trades(spark, d), policy=list(POLICIES))
    lots = F.when(col("policy") == "one_lot", 1)
    for name, risk in POLICIES.items():
        if risk:
            lots = lots.when(col("policy") == name, X.contracts(F.lit(risk), col("stop_pts")))
    t = t.withColumn("p", (col("gross_pnl") - 5.0) * lots)
    keys = ["combo_id", "policy"]
    out = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.sum("p").alias("total"), M.sharpe(col("p")).alias("sharpe"))
    out = out.join(M.max_drawdown(t, keys, ["seq"], seq_block(), "p", X.START_EQUITY), keys)
    return picks(out, [*keys, "n_trades"], "total", "sharpe", "max_drawdown_dollars")


@query("A43_net_gross_variants", sql(f"""SELECT combo_id, variant, count(*) AS n, {rounded(dollars_per_year=f'sum(p) / {YEARS}', annual_sharpe=SHARPE.format(x='p') + f' * sqrt(count(*) / {YEARS})')}
  FROM (SELECT combo_id, unnest(['gross', 'net']) AS variant, unnest([gross_pnl, net_pnl]) AS p FROM trades) GROUP BY 1, 2""", TRADES))
def a43(spark, d):
    pairs = F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), col(f"{v}_pnl").alias("p")) for v in ("gross", "net")]))
    t = trades(spark, d).select("combo_id", pairs)
    return t.groupBy("combo_id", "variant").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("p") / YEARS).alias("dollars_per_year"), tidy(M.annual_sharpe(col("p"), YEARS)).alias("annual_sharpe"))


@query("A44_sharpe_error", sql(PER + f""", a AS (SELECT combo_id, n_trades, n_trades / {YEARS} AS q, sharpe_ratio * sqrt(n_trades / {YEARS}) AS s FROM per), e AS (SELECT *, sqrt(q / n_trades * (1 + s * s / (2 * q))) AS se FROM a)
  SELECT combo_id, {rounded(annual_sharpe='s', std_error='se', low='s - 1.96 * se', high='s + 1.96 * se', z_to_half='(s - 0.5) / se')} FROM e""", TRADES))
def a44(spark, d):
    p = per_combo(spark, d).withColumn("annual_sharpe", col("sharpe_ratio") * F.sqrt(col("n_trades") / YEARS))
    error, low, high = M.sharpe_interval(col("annual_sharpe"), F.lit(YEARS), col("n_trades") / YEARS)
    p = p.withColumns({"std_error": error, "low": low, "high": high, "z_to_half": safe_div(col("annual_sharpe") - 0.5, error)})
    return picks(p, BY, "annual_sharpe", "std_error", "low", "high", "z_to_half")
