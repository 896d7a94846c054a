"""Joins between result tables, ranking, baskets, pools and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeloom.functions.maths import hash_draw, safe_div, tidy
from tradeloom.operators import indicators as N
from tradeloom.operators import ledger as L
from tradeloom.operators import metrics as M
from tradeloom.operators import neighbours as NN
from tradeloom.operators import ranking as K
from tradeloom.operators import sweep as W
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, TRADES, bars, ordered_trades, sql, table, trade_block, trades
from tradeloom.plans.registry import query
from tradeloom.plans.stat_queries import BY, CURVE, PER, SHARPE, per_combo, picks, rounded, sql_rank
from tradeloom.plans.trade_queries import FLAT, fixed_hold_trades

col, r6 = F.col, S.r6
ORDER = ["trade_date", "order_no", "line_no", "part_no", "notional"]


@query("J4_metrics_with_params", sql(PER + f"SELECT combo_id, s_nationkey AS region_param, n_trades, {r6('sharpe_ratio')} AS sharpe_ratio FROM per JOIN supplier ON s_suppkey = combo_id", TRADES))
def j4(spark, d):
    params = table(spark, d, "supplier").select(col("s_suppkey").alias("combo_id"), col("s_nationkey").alias("region_param"))
    return picks(per_combo(spark, d).join(params, "combo_id"), ["combo_id", "region_param", "n_trades"], "sharpe_ratio")


@query("J5_spine_join", """WITH s AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders)
  SELECT strftime(day, '%Y-%m-%d') AS day, count(o_orderkey) AS n_trades, round(coalesce(sum(o_totalprice), 0) + 3.7e-7, 3) + 0.0 AS pnl_day
  FROM s LEFT JOIN orders ON o_orderdate::DATE = day GROUP BY day""")
def j5(spark, d):
    o = table(spark, d, "orders").withColumn("d", col("o_orderdate").cast("date"))
    out = L.daily_ledger(o, [], "d", "o_totalprice", 0.0)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_trades", tidy(col("pnl_day"), 3).alias("pnl_day"))


OVERLAP = """, base AS (SELECT CASE WHEN combo_id % 2 = 0 THEN 'v10_' ELSE 'v11_' END || combo_id AS gid, combo_id, count(*) AS n FROM trades GROUP BY 2),
  cnt AS (SELECT combo_id, count(*) AS k FROM trades WHERE trade_date < DATE '1999-01-01' GROUP BY 1)"""


@query("J6_overlap_labels", sql(OVERLAP + f"""SELECT gid AS combo_id, b.combo_id AS combo_id_int, CASE WHEN gid LIKE 'v11%' THEN coalesce(k, 0) ELSE 0 END AS trades_in_training,
  CASE WHEN gid LIKE 'v11%' THEN coalesce(k, 0) ELSE 0 END > 0 AS trades_in_training_bool,
  {r6("least(greatest(CASE WHEN gid LIKE 'v11%' THEN coalesce(k, 0) ELSE 0 END / greatest(n, 1), 0), 1)")} AS overlap_pct FROM base b LEFT JOIN cnt USING (combo_id)""", TRADES))
def j6(spark, d):
    t = trades(spark, d)
    version = F.when(col("combo_id") % 2 == 0, "v10").otherwise("v11")
    base = t.groupBy("combo_id").agg(F.count(F.lit(1)).alias("n")).withColumn("global_combo_id", F.concat_ws("_", version, col("combo_id").cast("string")))
    counts = t.filter(col("trade_date") < F.lit("1999-01-01").cast("date")).groupBy("combo_id").agg(F.count(F.lit(1)).alias("k"))
    joined = base.join(counts, "combo_id", "left")
    prefix = F.element_at(F.split("global_combo_id", "_"), 1)
    k = F.when(prefix == "v11", F.coalesce("k", F.lit(0))).otherwise(0)
    share = F.least(F.greatest(safe_div(k.cast("double"), F.greatest("n", F.lit(1)).cast("double")), F.lit(0.0)), F.lit(1.0))
    return joined.select(col("global_combo_id").alias("combo_id"), col("combo_id").alias("combo_id_int"), k.alias("trades_in_training"),
                         (k > 0).alias("trades_in_training_bool"), tidy(share).alias("overlap_pct"))


@query("J7_eligible_semi_join", sql("SELECT flag, count(*) AS n FROM trades WHERE combo_id IN (SELECT combo_id FROM trades GROUP BY 1 HAVING count(*) >= 600) GROUP BY 1", TRADES))
def j7(spark, d):
    return K.with_least_rows(trades(spark, d), ["combo_id"], 600).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("J8_basket_difference", sql("""SELECT coalesce(a.part_no, b.part_no) AS part_no, CASE WHEN b.part_no IS NULL THEN 'a' ELSE 'b' END AS only_in
  FROM (SELECT part_no FROM trades WHERE month(trade_date) <= 6 GROUP BY 1 HAVING count(*) >= 15) a FULL JOIN (SELECT part_no FROM trades WHERE month(trade_date) > 6 GROUP BY 1 HAVING count(*) >= 15) b USING (part_no)
  WHERE a.part_no IS NULL OR b.part_no IS NULL""", TRADES))
def j8(spark, d):
    month = F.month("trade_date")
    return K.basket_difference(trades(spark, d), "part_no", month <= 6, month > 6, 15)


@query("J9_signal_bar_features", sql(FLAT + S.EMA_PAIR + f""", fz AS (SELECT symbol, bar_idx, z, coalesce(lag(z) OVER (PARTITION BY symbol ORDER BY bar_idx), CASE WHEN bar_idx = 0 THEN z END) AS zp FROM scored0),
  fb AS (SELECT symbol, bar_idx, high - low AS span, abs(close - open) AS body, ema_fast - ema_slow AS spread, abs(close - ema_fast) AS gap, {S.zscore('volume', 20)} AS vz, {S.mean('tr', 14)} AS atr, {S.RANGE_LOG} AS rl, {S.RANGE_POINTS} AS rp FROM pair)
  SELECT h.symbol, h.bar_idx, {rounded(zscore_entry='z', zscore_prev='zp', zscore_delta='z - zp', bar_range='span', bar_body='body', volume_zscore='vz', ema_spread='spread', distance_to_ema='gap', atr='atr', range_pct='rl', range_vs_atr='CASE WHEN atr > 0 THEN rp / atr END')}
  FROM held h JOIN fz USING (symbol, bar_idx) JOIN fb USING (symbol, bar_idx)""", BARS))
def j9(spark, d):
    """Facts of the signal bar and the bar before it, for every trade."""
    b = N.emas(bars(spark, d), "close", {"ema_fast": 8, "ema_slow": 21})
    b = N.with_rolling(b, 21, z=lambda w: N.zscore(col("close"), w, 20), zscore_prev=lambda w: F.coalesce(F.lag("z").over(w), F.when(col("bar_idx") == 0, col("z"))),
                       volume_zscore=lambda w: N.zscore(col("volume"), w, 20), tr=N.true_range, atr=lambda w: N.rolling_mean(col("tr"), w, 14))
    facts = b.select("symbol", "bar_idx", col("z").alias("zscore_entry"), "zscore_prev", (col("z") - col("zscore_prev")).alias("zscore_delta"),
                     (col("high") - col("low")).alias("bar_range"), F.abs(col("close") - col("open")).alias("bar_body"), "volume_zscore",
                     (col("ema_fast") - col("ema_slow")).alias("ema_spread"), F.abs(col("close") - col("ema_fast")).alias("distance_to_ema"), "atr",
                     N.range_log().alias("range_pct"), F.when(col("atr") > 0, N.range_points() / col("atr")).alias("range_vs_atr"))
    t = fixed_hold_trades(spark, d).select("symbol", "bar_idx")
    return picks(t.join(facts, ["symbol", "bar_idx"]), ["symbol", "bar_idx"], *facts.columns[2:])


@query("J10_equity_by_bar", sql(FLAT + f""", ex AS (SELECT symbol, bar_idx + 12 AS bar_idx, sum(pts) AS p FROM held GROUP BY 1, 2)
  SELECT symbol, bar_idx, {r6('50000 + coalesce(sum(p) OVER (PARTITION BY symbol ORDER BY bar_idx), 0)')} AS equity FROM bars LEFT JOIN ex USING (symbol, bar_idx)""", BARS))
def j10(spark, d):
    t = fixed_hold_trades(spark, d).select("symbol", (col("bar_idx") + 12).alias("exit_bar"), col("pts").alias("pnl"))
    return picks(L.equity_by_bar(bars(spark, d), t, ["symbol"], 50000.0), ["symbol", "bar_idx"], "equity")


@query("J11_count_mismatch", sql("""SELECT count(*) AS n_joined, (count(*) FILTER (WHERE a.n <> b.n)) AS n_mismatch FROM (SELECT combo_id, count(*) AS n FROM trades GROUP BY 1) a
  JOIN (SELECT combo_id, count(*) AS n FROM trades WHERE hold_bars > 1 OR combo_id >= 50 GROUP BY 1) b USING (combo_id)""", TRADES))
def j11(spark, d):
    t = trades(spark, d)
    a = M.moments_from_sums(t, BY, "r_multiple").select("combo_id", "n")
    b = t.filter((col("hold_bars") > 1) | (col("combo_id") >= 50)).groupBy("combo_id").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, "combo_id").agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(col("n") != col("m")).alias("n_mismatch"))


@query("J12_benchmark", """WITH q AS (SELECT l_shipdate::DATE AS day, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1),
  d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), j AS (SELECT d.day, q.close FROM d ASOF LEFT JOIN q ON d.day >= q.day)
  SELECT strftime(day, '%Y-%m-%d') AS day, round(close / (SELECT arg_min(close, day) FROM j WHERE close IS NOT NULL) * 50000 + 3.7e-8, 4) + 0.0 AS scaled FROM j""")
def j12(spark, d):
    days = table(spark, d, "orders").select(col("o_orderdate").cast("date").alias("day")).distinct()
    li = table(spark, d, "lineitem")
    quotes = li.groupBy(col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_extendedprice").alias("close"))
    out = L.align_benchmark(days, quotes, 50000.0)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), tidy(col("scaled"), 4).alias("scaled"))


Z3 = ["n_trades", "win_rate", "avg_r"]


@query("J13_nearest_parameters", sql(PER + ", z AS MATERIALIZED (SELECT combo_id, sharpe_ratio, [" + ", ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::DOUBLE" for c in Z3) + f"""] AS v FROM per),
  p AS (SELECT a.combo_id AS id, b.sharpe_ratio AS t, row_number() OVER (PARTITION BY a.combo_id ORDER BY round(list_distance(a.v, b.v), 12), b.combo_id) AS rk FROM z a JOIN z b ON a.combo_id <> b.combo_id)
  SELECT id, count(*) AS n_neighbours, {rounded(knn_mean='avg(t)', knn_std='stddev_samp(t)')} FROM p WHERE rk <= 10 GROUP BY 1""", TRADES))
def j13(spark, d):
    p = per_combo(spark, d).withColumnRenamed("avg_r_multiple", "avg_r")
    pairs = NN.nearest(NN.parameter_vectors(p, "combo_id", Z3), 10)
    return picks(NN.neighbour_features(pairs, p, "combo_id", "sharpe_ratio"), ["id", "n_neighbours"], "knn_mean", "knn_std")


@query("J14_fold_neighbours", f"""WITH v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v, ('0x' || substr(md5('fold|' || vec_id), 1, 8))::BIGINT % 5 AS fold FROM embeddings),
  p AS (SELECT a.vec_id AS id, f.fold AS skip, b.label AS t, row_number() OVER (PARTITION BY a.vec_id, f.fold ORDER BY round(list_distance(a.v, b.v), 12), b.vec_id) AS rk
    FROM v a, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS fold) f, v b WHERE a.vec_id <> b.vec_id AND b.fold <> f.fold)
  SELECT id, skip AS held_out, count(*) AS n_neighbours, {rounded(knn_mean='avg(t)', knn_std='stddev_samp(t)')} FROM p WHERE rk <= 10 GROUP BY 1, 2""")
def j14(spark, d):
    e = table(spark, d, "embeddings")
    vectors = e.select(col("vec_id").alias("id"), col("embedding").cast("array<double>").alias("vec"), (hash_draw("fold", col("vec_id")) % 5).alias("grp"))
    pairs = NN.nearest(vectors, 10, held_out=[0, 1, 2, 3, 4])
    out = NN.neighbour_features(pairs, e, "vec_id", "label").withColumnRenamed("skip", "held_out")
    return picks(out, ["id", "held_out", "n_neighbours"], "knn_mean", "knn_std")


SCORE_SQL = CURVE + PER + f""", f AS (SELECT per.combo_id, n_trades, round(sharpe_ratio, 9) AS s, round(pnl, 6) AS p, round(pf, 9) AS f, round(max_drawdown_pct, 9) AS m FROM per JOIN dd USING (combo_id)),
  cs AS MATERIALIZED (SELECT *, 0.4 * {sql_rank('s')} / count(*) OVER () + 0.3 * {sql_rank('p')} / count(*) OVER () + 0.15 * {sql_rank('f')} / count(*) OVER ()
    + 0.15 * (1 - {sql_rank('m')} / count(*) OVER ()) AS score FROM f)"""


def scored_combos(spark, d):
    t = trades(spark, d)
    p = per_combo(spark, d).join(M.max_drawdown(t, BY, ORDER, trade_block(), "net_pnl", 50000.0), BY)
    p = p.select("combo_id", "n_trades", F.round("sharpe_ratio", 9).alias("sharpe_ratio"), F.round("total_return_dollars", 6).alias("total_return_pct"),
                 F.round("profit_factor", 9).alias("profit_factor"), F.round("max_drawdown_pct", 9).alias("max_drawdown_pct"))
    return K.composite_score(p, "combo_id")


@query("K1_composite_rank", sql(SCORE_SQL + f"SELECT combo_id, {r6('score')} AS composite_score FROM cs", TRADES))
def k1(spark, d):
    return picks(scored_combos(spark, d), BY, "composite_score")


@query("K2_top_k", sql(PER + f"SELECT combo_id, n_trades, {r6('sharpe_ratio')} AS sharpe_ratio FROM per WHERE n_trades >= 580 ORDER BY round(sharpe_ratio, 9) DESC, combo_id LIMIT 20", TRADES))
def k2(spark, d):
    p = per_combo(spark, d).withColumn("s", F.round("sharpe_ratio", 9))
    return picks(K.top_k(p, "s", 20, "combo_id", least_trades=580), ["combo_id", "n_trades"], "sharpe_ratio")


@query("K3_upper_bound_top", sql(f""", q AS (SELECT combo_id, quantile_cont(net_pnl, [0.1, 0.5, 0.9]) AS q FROM trades GROUP BY 1)
  SELECT combo_id, {r6('q[2] + (q[3] - q[1]) / 2')} AS ucb FROM q ORDER BY round(q[2] + (q[3] - q[1]) / 2, 9) DESC, combo_id LIMIT 25""", TRADES))
def k3(spark, d):
    from tradeloom.operators.ordered import quantiles

    q = quantiles(trades(spark, d), BY, "net_pnl", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    q = q.withColumn("ucb", K.upper_bound_score(col("p10"), col("p50"), col("p90"))).withColumn("s", F.round("ucb", 9))
    return picks(K.top_k(q, "s", 25, "combo_id"), BY, "ucb")


@query("K4_rank_of_id", sql(PER + f"""SELECT combo_id, row_number() OVER (ORDER BY round(sharpe_ratio, 9) DESC, combo_id) AS rank,
  {r6('1 - (row_number() OVER (ORDER BY round(sharpe_ratio, 9) DESC, combo_id) - 1) / count(*) OVER ()')} AS percentile FROM per""", TRADES))
def k4(spark, d):
    p = per_combo(spark, d).select("combo_id", F.round("sharpe_ratio", 9).alias("s"))
    return picks(K.rank_of(p, "combo_id", "s"), ["combo_id", "rank"], "percentile")


TOPS = ["sharpe_ratio", "avg_r", "win_rate", "pnl"]
BASKETS = PER + ", bk AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS ranker, combo_id FROM (SELECT combo_id, row_number() OVER (ORDER BY round({c}, 9) DESC, combo_id) AS rn FROM per) WHERE rn <= 30" for c in TOPS) + ")"


@query("K5_jaccard_matrix", sql(BASKETS + f""", sh AS (SELECT a.ranker AS basket_a, b.ranker AS basket_b, count(*) AS n_shared FROM bk a JOIN bk b USING (combo_id) GROUP BY 1, 2),
  al AS (SELECT a.ranker AS basket_a, b.ranker AS basket_b FROM (SELECT DISTINCT ranker FROM bk) a, (SELECT DISTINCT ranker FROM bk) b), sz AS (SELECT ranker, count(*) AS n FROM bk GROUP BY 1)
  SELECT basket_a, basket_b, coalesce(n_shared, 0) AS n_shared, {r6('coalesce(n_shared, 0) / (x.n + y.n - coalesce(n_shared, 0))')} AS jaccard
  FROM al LEFT JOIN sh USING (basket_a, basket_b) JOIN sz x ON x.ranker = basket_a JOIN sz y ON y.ranker = basket_b""", TRADES))
def k5(spark, d):
    p = per_combo(spark, d).withColumnsRenamed({"avg_r_multiple": "avg_r", "total_return_dollars": "pnl"})
    long = M.melt(p, ["combo_id"], TOPS, "ranker", "value").withColumn("value", F.round("value", 9))
    top = K.top_per_group(long, ["ranker"], "value", 30, "combo_id")
    return picks(K.jaccard_matrix(top, "ranker", "combo_id"), ["basket_a", "basket_b", "n_shared"], "jaccard")


@query("K6_rank_stability", sql(f""", a AS (SELECT arm, combo_id, count(*) AS n, round({SHARPE.format(x='gross_pnl - 5')} * sqrt(count(*) / (arm * 5.8056)), 9) AS s, stddev_samp(gross_pnl - 5) AS sd
    FROM ordered_trades, (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DOUBLE AS arm) WHERE seq < round_even(n_combo * arm, 0) AND round_even(n_combo * arm, 0) >= 300 GROUP BY 1, 2),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY s DESC, combo_id) AS rn FROM a WHERE sd > 0) WHERE rn <= 50), b AS (SELECT combo_id FROM t WHERE arm = 0.8)
  SELECT arm, (count(*) FILTER (WHERE combo_id IN (FROM b))) AS n_shared, {r6('(count(*) FILTER (WHERE combo_id IN (FROM b))) / (count(*) + (SELECT count(*) FROM b) - (count(*) FILTER (WHERE combo_id IN (FROM b))))')} AS jaccard FROM t GROUP BY 1""", TRADES))
def k6(spark, d):
    top = K.stability_arms(ordered_trades(spark, d), BY, "gross_pnl", [0.6, 0.7, 0.8, 0.9], 50, 300)
    return picks(K.against_baseline(top, "arm", 0.8, "combo_id"), ["arm", "n_shared"], "jaccard")


DRAW = "('0x' || substr(md5('{seed}|' || {k}), 1, 8))::BIGINT"


@query("K7_pool_union", sql(PER + f""", a AS (SELECT combo_id FROM per ORDER BY round(sharpe_ratio, 9) DESC, combo_id LIMIT 30), b AS (SELECT combo_id FROM per ORDER BY {DRAW.format(seed=7, k='combo_id')}, combo_id LIMIT 30)
  SELECT combo_id FROM a UNION SELECT combo_id FROM b""", TRADES))
def k7(spark, d):
    p = per_combo(spark, d).withColumn("s", F.round("sharpe_ratio", 9))
    return K.union_pool(K.top_k(p, "s", 30, "combo_id").select("combo_id"), K.random_pool(p, "combo_id", 30, 7).select("combo_id"))


@query("K8_seeded_subsample", f"SELECT o_orderkey FROM orders ORDER BY {DRAW.format(seed=42, k='o_orderkey')}, o_orderkey LIMIT 500")
def k8(spark, d):
    return K.random_pool(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 42)


KEYS4 = ["order_no", "line_no", "part_no", "notional"]


@query("K9_stratified_sample", f"""WITH s AS (SELECT o_orderpriority AS p, count(*) AS size FROM orders GROUP BY 1), c AS (SELECT *, least(round_even(size * 2000.0::DOUBLE / sum(size) OVER (), 0), 380)::BIGINT AS take FROM s),
  b AS (SELECT p, take + CASE WHEN take < 380 AND (SELECT 2000 - sum(take) FROM c) > 0 THEN floor((SELECT 2000 - sum(take) FROM c) / greatest((SELECT count(*) FROM c WHERE take < 380), 1)) ELSE 0 END AS budget FROM c),
  r AS (SELECT o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {DRAW.format(seed=42, k='o_orderkey')}, o_orderkey) AS rn FROM orders)
  SELECT r.p AS stratum, o_orderkey FROM r JOIN b USING (p) WHERE rn <= budget""")
def k9(spark, d):
    o = table(spark, d, "orders").select(col("o_orderpriority").alias("stratum"), "o_orderkey")
    return K.stratified_sample(o, "stratum", ["o_orderkey"], 2000, 42, cap_share=0.19)


@query("K10_bernoulli_sample", f"SELECT o_orderkey FROM orders WHERE {DRAW.format(seed=11, k='o_orderkey')} / 4294967296.0::DOUBLE < 3000.0::DOUBLE / (SELECT count(*) FROM orders)")
def k10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return K.bernoulli_sample(o, ["o_orderkey"], F.lit(3000.0) / o.agg(F.count(F.lit(1))).scalar(), 11)


@query("K11_min_count_filter", sql("SELECT part_no, count(*) AS n FROM trades GROUP BY 1 HAVING count(*) >= 35", TRADES))
def k11(spark, d):
    return K.with_least_rows(trades(spark, d), ["part_no"], 35).groupBy("part_no").agg(F.count(F.lit(1)).alias("n"))


UNI = "('0x' || substr(md5('5|' || s_suppkey || '|{c}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("K12_uniform_search", sql(", e AS (SELECT min(stop_pts) AS a, max(stop_pts) AS b, min(mfe_pts) AS c, max(mfe_pts) AS f FROM trades) SELECT s_suppkey AS draw, "
  + rounded(stop_pts=f"a + {UNI.format(c='stop_pts')} * (b - a)", mfe_pts=f"c + {UNI.format(c='mfe_pts')} * (f - c)") + " FROM supplier, e", TRADES))
def k12(spark, d):
    draws = table(spark, d, "supplier").select(col("s_suppkey").alias("draw"))
    return picks(W.uniform_search(draws, trades(spark, d), ["stop_pts", "mfe_pts"], "draw", 5), ["draw"], "stop_pts", "mfe_pts")


RANGES = [
    ("wide", "ema_fast", "int", 3.0, 30.0, None), ("wide", "ema_slow", "int", 10.0, 100.0, None), ("wide", "z_window", "int", 10.0, 60.0, None),
    ("wide", "z_band_k", "float", 1.0, 3.5, None), ("wide", "z_input", "choice", None, None, ["close", "returns", "typical_price"]),
    ("wide", "z_anchor", "choice", None, None, ["rolling_mean", "vwap_session", "ema_fast", "ema_slow"]),
    ("wide", "z_denom", "choice", None, None, ["rolling_std", "atr", "parkinson"]), ("wide", "z_type", "choice", None, None, ["parametric", "quantile_rank"]),
    ("wide", "stop_method", "choice", None, None, ["fixed", "atr", "swing"]),
    ("narrow", "ema_fast", "int", 5.0, 12.0, None), ("narrow", "ema_slow", "int", 15.0, 40.0, None), ("narrow", "z_window", "int", 20.0, 40.0, None),
    ("narrow", "z_band_k", "float", 1.5, 2.5, None), ("narrow", "z_input", "choice", None, None, ["close"]),
    ("narrow", "z_anchor", "choice", None, None, ["rolling_mean"]), ("narrow", "z_denom", "choice", None, None, ["rolling_std", "atr"]),
    ("narrow", "z_type", "choice", None, None, ["parametric"]), ("narrow", "stop_method", "choice", None, None, ["fixed"]),
]


def drawn(p):
    """SQL value of one parameter for both modes."""
    u = f"(('0x' || substr(md5('9|' || draw || '|{p}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    out = "CASE mode"
    for mode, name, kind, lo, hi, choices in RANGES:
        if name == p:
            if kind == "choice":
                v = f"{choices!r}[floor({u} * {len(choices)})::INT + 1]"
            elif kind == "int":
                v = f"(floor({u} * {hi - lo}) + {lo})::INT"
            else:
                v = f"round({u} * {hi - lo}::DOUBLE + {lo}, 4)"
            out += f" WHEN '{mode}' THEN {v}"
    return out + " END"


@query("K13_sampled_parameters", "WITH d AS (SELECT s_suppkey AS draw, CASE WHEN s_suppkey % 3 = 0 THEN 'narrow' ELSE 'wide' END AS mode FROM supplier), r AS (SELECT draw, mode, "
  + ", ".join(f"{drawn(p)} AS {p}" for p in dict.fromkeys(r[1] for r in RANGES)) + """ FROM d)
  SELECT draw, mode, ema_fast, greatest(ema_slow, ema_fast + 1) AS ema_slow, z_window, z_band_k, z_input, CASE WHEN z_input = 'returns' THEN 'rolling_mean' ELSE z_anchor END AS z_anchor,
    CASE WHEN z_type = 'quantile_rank' THEN 'n/a' WHEN z_input = 'returns' AND z_denom = 'atr' THEN 'rolling_std' ELSE z_denom END AS z_denom, z_type, stop_method FROM r""")
def k13(spark, d):
    mode = F.when(col("s_suppkey") % 3 == 0, "narrow").otherwise("wide")
    draws = table(spark, d, "supplier").select(col("s_suppkey").alias("draw"), mode.alias("mode"))
    return W.compatible(W.sample_params(draws, W.range_table(spark, RANGES), "draw", 9))


#: two modes of the sweep with all their parameters: ranges, dependent ranges and rules of compatibility
VARIANT, WINRATE = "mode = 'zscore_variants'", None
ONLY_FIXED, ONLY_ATR, ONLY_SWING = "stop_method = 'fixed'", "stop_method = 'atr'", "stop_method = 'swing'"
NOTHING = (None, "is", "CAST(NULL AS DOUBLE)")
MODE_RULES = [
    ("ema_fast", [(VARIANT, "int", "5", "16"), (WINRATE, "int", "5", "9")]),
    ("ema_slow", [(VARIANT, "int", "ema_fast + 5", "36"), (WINRATE, "int", "ema_fast + 5", "least(ema_fast + 20, 26)")]),
    ("stop_method", [(VARIANT, "choice", ["fixed", "atr", "swing"]), (WINRATE, "choice", ["swing", "swing", "atr", "fixed"])]),
    ("z_window", [(VARIANT, "int", "10", "31"), (WINRATE, "int", "20", "31")]),
    ("z_type", [(VARIANT, "choice", ["parametric", "quantile_rank"]), (WINRATE, "is", "'parametric'")]),
    ("z_input", [(VARIANT, "choice", ["close", "returns", "typical_price"]), (WINRATE, "is", "'close'")]),
    ("z_anchor", [("mode <> 'zscore_variants' OR z_input = 'returns'", "is", "'rolling_mean'"), (None, "choice", ["rolling_mean", "vwap_session", "ema_fast", "ema_slow"])]),
    ("z_denom", [("mode <> 'zscore_variants'", "is", "'rolling_std'"), ("z_type = 'quantile_rank'", "is", "'n/a'"), ("z_input = 'returns'", "choice", ["rolling_std", "parkinson"]), (None, "choice", ["rolling_std", "atr", "parkinson"])]),
    ("use_window_2", [(VARIANT, "int", "0", "2"), (WINRATE, "is", "CAST(0 AS BIGINT)")]),
    ("z_window_2", [("use_window_2 = 1 AND z_window + 5 < 51", "int", "z_window + 5", "51"), (None, "is", "CAST(0 AS BIGINT)")]),
    ("z_window_2_weight", [("z_window_2 > 0", "float", "0.2", "0.5"), (None, "is", "CAST(0 AS DOUBLE)")]),
    ("z_band_k", [(VARIANT, "float", "1.5", "3.5"), (WINRATE, "float", "2.5", "3.5")]),
    ("volume_zscore_window", [(None, "int", "10", "31")]),
    ("stop_fixed_pts", [(ONLY_FIXED, "float", "10", "30"), NOTHING]),
    ("atr_multiplier", [(ONLY_ATR, "float", "1", "3"), NOTHING]),
    ("swing_lookback", [(ONLY_SWING, "int", "3", "11"), (None, "is", "CAST(NULL AS BIGINT)")]),
    ("min_rr", [(VARIANT, "float", "2", "5"), (WINRATE, "float", "2", "3")]),
    ("exit_on_opposite_signal", [(VARIANT, "choice", [True, False]), (WINRATE, "choice", [True, True, True, False])]),
    ("use_breakeven_stop", [(None, "choice", [True, False])]),
    ("max_hold_bars", [(None, "choice", [0, 0, 15, 30, 60, 120])]),
    ("zscore_confirmation", [(None, "choice", [True, False])]),
]


def rules_sql(rules, seed):
    """The drawn parameters as SQL; later ones refer to earlier ones by name."""
    picked = []
    for name, cases in rules:
        u = f"(('0x' || substr(md5('{seed}|' || draw || '|{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
        text = "CASE"
        for condition, kind, *args in cases:
            if kind == "int":
                value = f"(({args[0]}) + floor({u} * greatest(({args[1]}) - ({args[0]}), 0)))::BIGINT"
            elif kind == "float":
                value = f"round({args[0]}::DOUBLE + {u} * ({args[1]}::DOUBLE - {args[0]}::DOUBLE), 4)"
            elif kind == "choice":
                value = f"({args[0]!r})[floor({u} * {len(args[0])})::INT + 1]"
            else:
                value = args[0]
            text += f" WHEN {condition or 'true'} THEN {value}"
        picked.append(f"{text} END AS {name}")
    return ", ".join(picked)


@query("K13b_dependent_parameters", "WITH d AS (SELECT s_suppkey AS draw, CASE WHEN s_suppkey % 2 = 0 THEN 'winrate' ELSE 'zscore_variants' END AS mode FROM supplier) SELECT draw, mode, " + rules_sql(MODE_RULES, 21) + " FROM d")
def k13b(spark, d):
    """All parameters of two sampling modes, with ranges that depend on earlier draws."""
    mode = F.when(col("s_suppkey") % 2 == 0, "winrate").otherwise("zscore_variants")
    return W.draw_by_rules(table(spark, d, "supplier").select(col("s_suppkey").alias("draw"), mode.alias("mode")), MODE_RULES, "draw", 21)


@query("K14_neighbourhood", sql(f""", g AS (SELECT combo_id, f1, f2, f3, avg(CASE WHEN mfe_pts >= 0.2::DOUBLE * f1 * stop_pts * f2 THEN 0.3::DOUBLE * f1 ELSE r_multiple * f3 END) AS m
    FROM trades, (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS f1), (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS f2), (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS f3) GROUP BY 1, 2, 3, 4)
  SELECT combo_id, count(*) AS n_cells, (count(*) FILTER (WHERE round(m, 9) > 0.33)) AS n_pass, (count(*) FILTER (WHERE round(m, 9) > 0.33)) >= 14 AS neighbourhood_pass FROM g GROUP BY 1""", TRADES))
def k14(spark, d):
    t = trades(spark, d)
    ids = W.neighbourhood(t.select("combo_id").distinct().withColumns({"rr": F.lit(1.0), "stop": F.lit(1.0), "keep": F.lit(1.0)}), ["rr", "stop", "keep"], [0.8, 1.0, 1.2])
    cells = W.neighbourhood(spark.range(1).select(F.lit(1.0).alias("rr"), F.lit(1.0).alias("stop"), F.lit(1.0).alias("keep")), ["rr", "stop", "keep"], [0.8, 1.0, 1.2])
    grid = cells.agg(F.collect_list(F.struct("rr", "stop", "keep"))).scalar()  # 27 cells
    rows = t.withColumn("grid", grid).select("combo_id", "mfe_pts", "stop_pts", "r_multiple", F.inline("grid"))
    new = F.when(col("mfe_pts") >= col("rr") * 0.2 * col("stop_pts") * col("stop"), col("rr") * 0.3).otherwise(col("r_multiple") * col("keep"))
    per = rows.groupBy("combo_id", "rr", "stop", "keep").agg(F.avg(new).alias("m"))
    per = ids.select("combo_id", "rr", "stop", "keep").join(per, ["combo_id", "rr", "stop", "keep"], "left")
    passed = F.count_if(F.round("m", 9) > 0.33)
    return per.groupBy("combo_id").agg(F.count(F.lit(1)).alias("n_cells"), passed.alias("n_pass"), (passed >= 14).alias("neighbourhood_pass"))


@query("K15_merged_stream", sql(f""", u AS (SELECT 'a' AS src, trade_date, order_no, line_no, part_no, notional, net_pnl FROM trades WHERE flag = 'A' UNION ALL SELECT 'n', trade_date, order_no, line_no, part_no, notional, net_pnl FROM trades WHERE flag = 'N'
    UNION ALL SELECT 'r', trade_date, order_no, line_no, part_no, notional, net_pnl FROM trades WHERE flag = 'R')
  SELECT src, order_no, line_no, part_no, notional, row_number() OVER (ORDER BY trade_date, src, order_no, line_no, part_no, notional) - 1 AS at FROM u""", TRADES))
def k15(spark, d):
    from tradeloom.operators.ordered import union_all, with_position

    t = trades(spark, d).select("trade_date", *KEYS4, "net_pnl", "flag")
    streams = union_all([t.filter(col("flag") == f).withColumn("src", F.lit(f.lower())) for f in ("A", "N", "R")])
    out = with_position(streams, [], ["trade_date", "src", *KEYS4], [col("trade_date"), col("src"), F.floor(col("order_no") / 1_000_000)], "at")
    return out.select("src", *KEYS4, "at")


@query("K16_duplicate_keys", sql("SELECT order_no, line_no, count(*) AS n_rows FROM trades GROUP BY 1, 2 HAVING count(*) > 1", TRADES))
def k16(spark, d):
    return K.duplicates(trades(spark, d), ["order_no", "line_no"])


@query("K17_frequency_pools", sql(f""", p AS (SELECT part_no, count(*) AS n_trades, round(avg(net_pnl), 9) AS pred FROM trades GROUP BY 1), q AS (SELECT floor(median(n_trades)) AS a, floor(quantile_cont(n_trades, 0.95)) AS b FROM p),
  c AS (SELECT *, CASE WHEN n_trades >= greatest(b, 10 * a) THEN 'high' WHEN n_trades <= a THEN 'low' ELSE 'middle' END AS pool FROM p, q)
  SELECT pool, part_no, n_trades, {r6('pred')} AS pred, rn AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY pred DESC, part_no) AS rn FROM c) WHERE rn <= 5""", TRADES))
def k17(spark, d):
    p = trades(spark, d).groupBy("part_no").agg(F.count(F.lit(1)).alias("n_trades"), F.round(F.avg("net_pnl"), 9).alias("pred"))
    out = K.top_per_group(K.frequency_pools(p), ["pool"], "pred", 5, "part_no")
    return picks(out, ["pool", "part_no", "n_trades", "rank_in_group"], "pred")
