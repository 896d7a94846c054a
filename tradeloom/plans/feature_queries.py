"""Trade features, expansion over target ratios, filters and portfolio sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.maths import tidy
from tradeloom.operators import features as FE
from tradeloom.operators.ordered import many_quantiles
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import TRADES, ordered_trades, sql, trades
from tradeloom.plans.registry import query
from tradeloom.plans.stat_queries import BY, SHARPE, picks, rounded

col, r6 = F.col, S.r6
PAST = "OVER (PARTITION BY combo_id ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
EV = "(pwin * 1.5::DOUBLE - (1.0::DOUBLE - pwin))"
RR = "(SELECT unnest([" + ", ".join(str(x) for x in FE.RR_LEVELS) + "])::DOUBLE AS candidate_rr)"


def ev():
    return FE.expected_r(col("pwin"), F.lit(1.5))


def prior(x, n, least, default):
    p = PAST.format(n=n)
    return f"coalesce(CASE WHEN count({x}) {p} >= {least} THEN avg({x}) {p} END, {default})"


@query("F1_lagged_outcomes", sql("SELECT combo_id, seq, " + rounded(prior_wr_10=prior("win", 10, 3, 0.5), prior_wr_50=prior("win", 50, 10, 0.5), prior_r_ma10=prior("r_multiple", 10, 3, 0.0)) + " FROM ordered_trades", TRADES))
def f1(spark, d):
    return picks(FE.lagged_outcomes(ordered_trades(spark, d), BY), ["combo_id", "seq"], "prior_wr_10", "prior_wr_50", "prior_r_ma10")


@query("F2_has_history", sql("SELECT combo_id, seq, (seq >= 25)::TINYINT AS has_history_50 FROM ordered_trades", TRADES))
def f2(spark, d):
    return FE.lagged_outcomes(ordered_trades(spark, d), BY).select("combo_id", "seq", "has_history_50")


@query("F3_recency", sql(f""", g AS (SELECT combo_id, seq, coalesce(entry_bar - lag(entry_bar) OVER (PARTITION BY combo_id ORDER BY seq), -1) AS b FROM ordered_trades)
  SELECT combo_id, seq, b AS bars_since_last, {r6('CASE WHEN b < 0 THEN -1 ELSE ln(1 + b) END')} AS log_bars_since_last FROM g""", TRADES))
def f3(spark, d):
    return picks(FE.recency(ordered_trades(spark, d), BY), ["combo_id", "seq", "bars_since_last"], "log_bars_since_last")


@query("F4_sortedness", sql("""SELECT combo_id, count(*) AS n_rows, coalesce(sum((exit_bar < p)::INT), 0)::BIGINT AS n_unsorted
  FROM (SELECT *, lag(exit_bar) OVER (PARTITION BY combo_id ORDER BY seq) AS p FROM ordered_trades) GROUP BY 1""", TRADES))
def f4(spark, d):
    return FE.unsorted_rows(ordered_trades(spark, d), BY, "seq", "exit_bar")


LONG = f", lf AS (SELECT *, (mfe_pts >= candidate_rr * stop_pts)::INT AS ww FROM trades, {RR})"


@query("F5_expanded_levels", sql(LONG + f"SELECT combo_id, candidate_rr, count(*) AS n, sum(ww)::BIGINT AS n_would_win, {r6('sum(candidate_rr * abs(zscore_entry))')} AS rr_x_z FROM lf GROUP BY 1, 2", TRADES))
def f5(spark, d):
    out = FE.expand_levels(trades(spark, d))
    return out.groupBy("combo_id", "candidate_rr").agg(F.count(F.lit(1)).alias("n"), F.sum("would_win").alias("n_would_win"),
                                                       tidy(F.sum(col("candidate_rr") * F.abs("zscore_entry"))).alias("rr_x_z"))


P_AT = "least(1.0::DOUBLE, pwin * exp(-(0.2::DOUBLE + stop_pts / 100.0::DOUBLE) * ({rr} - 1.0::DOUBLE)))"


def p_at(rr):
    return F.least(F.lit(1.0), col("pwin") * F.exp(-(col("stop_pts") / 100.0 + 0.2) * (rr - 1.0)))


@query("F6_win_rate_by_level", sql(LONG + f"""SELECT candidate_rr, count(*) AS n, {rounded(win_rate='avg(ww)', mean_p='avg(p)', mean_ev='avg(p * candidate_rr - (1 - p))')}
  FROM (SELECT *, {P_AT.format(rr='candidate_rr')} AS p FROM lf) GROUP BY 1""", TRADES))
def f6(spark, d):
    out = FE.expand_levels(trades(spark, d)).withColumn("p", p_at(col("candidate_rr")))
    return out.groupBy("candidate_rr").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("would_win")).alias("win_rate"), tidy(F.avg("p")).alias("mean_p"),
                                           tidy(F.avg(FE.expected_r(col("p"), col("candidate_rr")))).alias("mean_ev"))


def best_sql(where):
    return sql(LONG + f""", e AS (SELECT combo_id, order_no, line_no, part_no, notional, candidate_rr AS rr, round(p * candidate_rr - (1 - p), 9) AS ev
      FROM (SELECT *, {P_AT.format(rr='candidate_rr')} AS p FROM lf {where})),
    b AS (SELECT combo_id, arg_max(rr, {{'e': ev, 'm': -rr}}) AS rr, max(ev) AS ev FROM e GROUP BY combo_id, order_no, line_no, part_no, notional)
    SELECT combo_id, rr, count(*) AS n, {r6('sum(ev)')} AS sum_ev FROM b GROUP BY 1, 2""", TRADES)


def best_counts(spark, d, levels=None):
    t = trades(spark, d).withColumn("b", FE.best_level(p_at, levels))
    return t.groupBy("combo_id", col("b.rr").alias("rr")).agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("b.ev")).alias("sum_ev"))


@query("F7_best_level", best_sql(""))
def f7(spark, d):
    return best_counts(spark, d)


@query("F8_best_level_in_band", best_sql("WHERE candidate_rr BETWEEN 1.5 AND 3.0"))
def f8(spark, d):
    return best_counts(spark, d, [x for x in FE.RR_LEVELS if 1.5 <= x <= 3.0])


GRID = f""", th AS (SELECT unnest([{', '.join(str(x) for x in FE.EV_THRESHOLDS)}])::DOUBLE AS threshold),
  sw AS MATERIALIZED (SELECT combo_id, threshold, count(*) AS n_trades, avg(win) AS win_rate, sum(net_pnl) AS total_pnl, {SHARPE.format(x='net_pnl')} AS sharpe,
    1 - count(*) / any_value(n_combo) AS skip_rate FROM ordered_trades, th WHERE {EV} >= threshold GROUP BY 1, 2)"""


@query("F9_threshold_sweep", sql(GRID + "SELECT combo_id, threshold, n_trades, " + rounded(win_rate="win_rate", total_pnl="total_pnl", sharpe="sharpe", skip_rate="skip_rate") + " FROM sw", TRADES))
def f9(spark, d):
    out = FE.threshold_sweep(trades(spark, d), BY, ev(), "net_pnl")
    return picks(out, ["combo_id", "threshold", "n_trades"], "win_rate", "total_pnl", "sharpe", "skip_rate")


@query("F9b_best_threshold", sql(GRID + f"""SELECT combo_id, threshold, n_trades, {r6('sharpe')} AS sharpe FROM (SELECT *, row_number() OVER (PARTITION BY combo_id ORDER BY round(sharpe, 9) DESC, threshold) AS rn FROM sw WHERE n_trades >= 20) WHERE rn = 1""", TRADES))
def f9b(spark, d):
    sweep = FE.threshold_sweep(trades(spark, d), BY, ev(), "net_pnl")
    return picks(FE.best_threshold(sweep, BY), ["combo_id", "threshold", "n_trades"], "sharpe")


@query("F10_guarded_threshold", sql(GRID + """, p AS (SELECT combo_id, threshold FROM (SELECT *, row_number() OVER (PARTITION BY combo_id ORDER BY round(sharpe, 9) DESC, threshold) AS rn FROM sw WHERE n_trades >= 550 AND sharpe < 5) WHERE rn = 1)
  SELECT DISTINCT t.combo_id, p.threshold IS NOT NULL AS found, coalesce(p.threshold, 0) AS threshold FROM trades t LEFT JOIN p USING (combo_id)""", TRADES))
def f10(spark, d):
    sweep = FE.threshold_sweep(trades(spark, d), BY, ev(), "net_pnl")
    return FE.threshold_or_zero(sweep, BY, 550)


@query("F11_percentile_filter", sql(f""", e AS (SELECT *, {EV} + notional / 1e7::DOUBLE AS ev FROM trades), q AS (SELECT combo_id, unnest([25, 50, 75, 90]) AS top_pct, unnest(quantile_cont(ev, [0.75, 0.5, 0.25, 0.1])) AS cutoff FROM e GROUP BY 1)
  SELECT combo_id, top_pct, count(*) AS n_trades, {rounded(cutoff='any_value(cutoff)', win_rate='avg(win)', total_pnl='sum(net_pnl)', sharpe=SHARPE.format(x='net_pnl'))} FROM e JOIN q USING (combo_id) WHERE round(ev, 12) >= round(cutoff, 12) GROUP BY 1, 2""", TRADES))
def f11(spark, d):
    t = trades(spark, d).withColumn("ev", F.round(ev() + col("notional") / 1e7, 12))
    return picks(FE.percentile_filter(t, BY, "ev", "net_pnl", [25, 50, 75, 90]), ["combo_id", "top_pct", "n_trades"], "cutoff", "win_rate", "total_pnl", "sharpe")


@query("F12_net_ev_mask", sql(f"SELECT combo_id, (count(*) FILTER (WHERE round({EV} - 5 / (stop_pts * 2), 12) > 0)) AS n_kept, count(*) AS n FROM trades GROUP BY 1", TRADES))
def f12(spark, d):
    keep = F.round(FE.net_expected_r(col("pwin"), 1.5, col("stop_pts"), 5.0), 12) > 0
    return trades(spark, d).groupBy(*BY).agg(F.count_if(keep).alias("n_kept"), F.count(F.lit(1)).alias("n"))


@query("F13_kelly", sql(""", k AS (SELECT *, greatest(0, least(pwin - (1.0::DOUBLE - pwin) / 1.5::DOUBLE, 0.05::DOUBLE)) AS f FROM trades), c AS (SELECT *, floor(f * 50000 / (stop_pts * 2)) AS lots FROM k)
  SELECT combo_id, """ + rounded(skip_rate="avg((lots <= 0)::INT)", mean_f="avg(f)", p95_f="quantile_cont(f, 0.95)", total_pnl="sum((gross_pnl - 5) * lots)") + " FROM c GROUP BY 1", TRADES))
def f13(spark, d):
    k = FE.kelly_sized(trades(spark, d), col("pwin"), 1.5)
    out = k.groupBy(*BY).agg(F.avg("skipped").alias("skip_rate"), F.avg("kelly").alias("mean_f"), F.sum((col("gross_pnl") - 5.0) * col("lots")).alias("total_pnl"))
    return picks(out.join(many_quantiles(k, BY, {"p95_f": (col("kelly"), 0.95)}), BY), BY, "skip_rate", "mean_f", "p95_f", "total_pnl")


PORT = f""", pf AS (SELECT combo_id, seq, entry_bar, exit_bar, (gross_pnl - 5) * floor(500.0::DOUBLE / (stop_pts * 2)) AS pnl FROM ordered_trades WHERE round({EV} - 5 / (stop_pts * 2), 12) > 0 AND stop_pts <= 250)"""


def portfolio(spark, d):
    from tradeloom.operators.trades import FIXED_RISK, contracts

    t = ordered_trades(spark, d).filter(F.round(FE.net_expected_r(col("pwin"), 1.5, col("stop_pts"), 5.0), 12) > 0)
    lots = contracts(F.lit(FIXED_RISK), col("stop_pts"))
    return t.filter(lots > 0).withColumn("pnl", (col("gross_pnl") - 5.0) * lots)


@query("F14_portfolio_equity", sql(PORT + f"SELECT combo_id, seq, exit_bar, {r6('pnl')} AS pnl, {r6('50000 + sum(pnl) OVER (ORDER BY exit_bar, combo_id, seq)', 4)} AS equity_after FROM pf", TRADES))
def f14(spark, d):
    out = FE.portfolio_equity(portfolio(spark, d), ["combo_id", "seq"], block=[F.floor(col("combo_id") / 10_000)])
    return out.select("combo_id", "seq", "exit_bar", tidy(col("pnl")).alias("pnl"), tidy(col("equity_after"), 4).alias("equity_after"))


@query("F14b_portfolio_without_same_bar", sql(PORT + f"SELECT count(*) AS n_realised, {r6('50000 + sum(pnl)', 4)} AS final_equity FROM pf WHERE exit_bar > entry_bar", TRADES))
def f14b(spark, d):
    out = FE.portfolio_equity(portfolio(spark, d), ["combo_id", "seq"], same_bar_trades=False)
    return out.agg(F.count(F.lit(1)).alias("n_realised"), tidy(F.sum("pnl") + 50000.0, 4).alias("final_equity"))


@query("F15_taken_available", sql(f"""SELECT combo_id, (count(*) FILTER (WHERE k)) AS n_taken, count(*) AS n_available, {rounded(sum_pnl='coalesce(sum(CASE WHEN k THEN net_pnl END), 0)', win_rate='coalesce((count(*) FILTER (WHERE k AND net_pnl > 0)) / nullif(count(*) FILTER (WHERE k), 0), 0)')}
  FROM (SELECT *, round({EV} - 5 / (stop_pts * 2), 12) > 0 AS k FROM trades) GROUP BY 1""", TRADES))
def f15(spark, d):
    keep = F.round(FE.net_expected_r(col("pwin"), 1.5, col("stop_pts"), 5.0), 12) > 0
    return picks(FE.taken_and_available(trades(spark, d), BY, keep, col("net_pnl")), ["combo_id", "n_taken", "n_available"], "sum_pnl", "win_rate")


@query("F15b_trades_per_combo", sql(f", c AS (SELECT combo_id, count(*) AS n FROM trades GROUP BY 1) SELECT count(*) AS n_combos, {rounded(p10='quantile_cont(n, 0.1)', p50='quantile_cont(n, 0.5)', p90='quantile_cont(n, 0.9)')} FROM c", TRADES))
def f15b(spark, d):
    c = trades(spark, d).groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    marks = many_quantiles(c, [], {p: (col("n"), q) for p, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))})
    return picks(marks.withColumn("n_combos", c.agg(F.count(F.lit(1))).scalar()), ["n_combos"], "p10", "p50", "p90")


@query("F16_open_positions", sql(""", e AS (SELECT side, entry_bar AS bar, 1 AS c FROM trades UNION ALL SELECT side, exit_bar, -1 FROM trades), n AS (SELECT side, bar, sum(c) AS c FROM e GROUP BY 1, 2)
  SELECT side, bar, (sum(c) OVER (PARTITION BY side ORDER BY bar))::BIGINT AS n_open FROM n""", TRADES))
def f16(spark, d):
    return FE.open_positions(trades(spark, d), ["side"])


@query("F17_filter_lift", sql(f"""SELECT combo_id, {rounded(sharpe_lift=SHARPE.format(x='CASE WHEN k THEN net_pnl END') + ' - ' + SHARPE.format(x='net_pnl'), mean_lift='avg(CASE WHEN k THEN net_pnl END) - avg(net_pnl)')}
  FROM (SELECT *, round({EV} - 5 / (stop_pts * 2), 12) > 0 AS k FROM trades) GROUP BY 1""", TRADES))
def f17(spark, d):
    from tradeloom.operators.metrics import sharpe

    keep = F.round(FE.net_expected_r(col("pwin"), 1.5, col("stop_pts"), 5.0), 12) > 0
    kept = F.when(keep, col("net_pnl"))
    return trades(spark, d).groupBy(*BY).agg(tidy(sharpe(kept) - sharpe(col("net_pnl"))).alias("sharpe_lift"), tidy(F.avg(kept) - F.avg("net_pnl")).alias("mean_lift"))


@query("F18_encoded_features", sql(f"""SELECT combo_id, order_no, line_no, part_no, notional, (flag = 'A')::TINYINT AS flag_A, (flag = 'R')::TINYINT AS flag_R,
  CASE flag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE -1 END AS flag_index, {r6('2.5 / greatest(stop_pts, 1e-6)')} AS friction_pct, (stop_pts < 5)::TINYINT AS tight_stop FROM trades""", TRADES))
def f18(spark, d):
    t = FE.friction_features(FE.encoded(trades(spark, d), "flag", ["A", "R"]))
    return picks(t, ["combo_id", "order_no", "line_no", "part_no", "notional", "flag_A", "flag_R", "flag_index", "tight_stop"], "friction_pct")
