"""Sweep fan-out, exits, position selection and trade money columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeloom.functions.clock import hhmm
from tradeloom.functions.maths import tick_round, tidy
from tradeloom.operators import indicators as N
from tradeloom.operators import signals as G
from tradeloom.operators import sweep as W
from tradeloom.operators import trades as X
from tradeloom.operators.ordered import rolling
from tradeloom.plans import sqltext as S
from tradeloom.plans.inputs import BARS, TRADES, bars, ordered_trades, seq_block, sql, trades
from tradeloom.plans.registry import query
from tradeloom.plans.signal_queries import LAG, LONG, SCORED, SHORT, encoded
from tradeloom.session import materialise

col = F.col
r6 = S.r6

RULES = [  # exit_on_opposite, use_breakeven, max_hold_bars, tod_exit_hour, cooldown_bars
    (False, False, 0, 0, 0),
    (True, False, 24, 0, 0),
    (True, True, 0, 16, 5),
]
RULE_FIELDS = ["exit_on_opposite", "use_breakeven", "max_hold_bars", "tod_exit_hour", "cooldown_bars"]


def combos(spark):
    """24 parameter sets: windows x bands x stops x exit rules."""
    rules = [F.struct(*[F.lit(v).alias(n) for n, v in zip(RULE_FIELDS, rule)], F.lit(i).alias("ri")) for i, rule in enumerate(RULES)]
    base = spark.range(1).select(F.lit(1.5).alias("min_rr"), F.explode(F.array(*rules)).alias("r")).select("min_rr", "r.*")
    out = W.product(base, z_window=[12, 24], z_band_k=[1.0, 1.5], stop_pts=[30.0, 80.0])
    number = ((col("z_window") / 12 - 1) * 12 + (col("z_band_k") - 1.0) * 12 + F.when(col("stop_pts") > 50, 3).otherwise(0) + col("ri"))
    return out.withColumn("combo_id", number.cast("int")).drop("ri")


COMBOS = """combos AS MATERIALIZED (
  SELECT ((z_window / 12 - 1) * 12 + (z_band_k - 1) * 12 + CASE WHEN stop_pts > 50 THEN 3 ELSE 0 END + ri)::INT AS combo_id, *
  FROM (SELECT unnest([12, 24]) AS z_window), (SELECT unnest([1.0, 1.5])::DOUBLE AS z_band_k),
       (SELECT unnest([30.0, 80.0])::DOUBLE AS stop_pts), (SELECT 1.5::DOUBLE AS min_rr),
       (VALUES (0, false, false, 0, 0, 0), (1, true, false, 24, 0, 0), (2, true, true, 0, 16, 5))
         AS t(ri, exit_on_opposite, use_breakeven, max_hold_bars, tod_exit_hour, cooldown_bars))"""
SWEEP = S.SERIES + ", zz AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT symbol, bar_idx, {n} AS z_window, {S.zscore('close', n)} AS z FROM s" for n in (12, 24)) + f"""),
zl AS MATERIALIZED (SELECT *, lag(z) OVER (PARTITION BY symbol, z_window ORDER BY bar_idx) AS zp FROM zz),
sig AS MATERIALIZED (
  SELECT c.*, symbol, bar_idx, z AS zscore, zp AS zscore_prev, CASE WHEN zp >= z_band_k THEN -1 ELSE 1 END AS signal
  FROM zl JOIN combos c USING (z_window)
  WHERE (zp <= -z_band_k AND z > -z_band_k) OR (zp >= z_band_k AND z < z_band_k)),
nb AS MATERIALIZED (SELECT *, lead(open) {LAG} AS next_open, max(bar_idx) OVER (PARTITION BY symbol) AS last_bar FROM bars),
cand AS MATERIALIZED (
  SELECT sig.*, bar_idx AS signal_bar, bar_idx + 1 AS entry_bar, signal AS side, n.next_open AS entry_price, n.last_bar,
    n.next_open - stop_pts * signal AS sl_price, n.next_open + stop_pts * min_rr * signal AS tp_price
  FROM sig JOIN nb n USING (symbol, bar_idx) WHERE n.next_open IS NOT NULL)"""
# every candidate with every later bar, read in order
WALK = """, steps AS (
  SELECT c.combo_id, c.symbol, c.signal_bar, c.side, c.entry_bar, c.entry_price, c.sl_price, c.tp_price, c.stop_pts, c.last_bar,
    c.exit_on_opposite, c.use_breakeven, c.max_hold_bars, c.tod_exit_hour, c.cooldown_bars, b.bar_idx AS t, b.high, b.low, b.close, b.next_open, hour(b.time) AS h,
    CASE WHEN side = 1 THEN b.low - entry_price ELSE entry_price - b.high END AS adverse,
    CASE WHEN side = 1 THEN b.high - entry_price ELSE entry_price - b.low END AS favour,
    c.use_breakeven AND bool_or(CASE WHEN side = 1 THEN b.high >= entry_price + c.stop_pts ELSE b.low <= entry_price - c.stop_pts END)
      OVER (PARTITION BY c.combo_id, c.symbol, c.signal_bar ORDER BY b.bar_idx) AS moved,
    o.signal AS osig
  FROM cand c JOIN nb b ON b.symbol = c.symbol AND b.bar_idx >= c.entry_bar
  LEFT JOIN sig o ON o.combo_id = c.combo_id AND o.symbol = c.symbol AND o.bar_idx = b.bar_idx),
hits AS (
  SELECT *, CASE WHEN moved THEN entry_price ELSE sl_price END AS stop_now,
    CASE WHEN side = 1 THEN low <= CASE WHEN moved THEN entry_price ELSE sl_price END
         ELSE high >= CASE WHEN moved THEN entry_price ELSE sl_price END END AS sl_hit,
    CASE WHEN side = 1 THEN high >= tp_price ELSE low <= tp_price END AS tp_hit FROM steps),
leaves AS (
  SELECT *, CASE WHEN tp_hit THEN 2 WHEN sl_hit THEN 1
      WHEN exit_on_opposite AND osig = -side AND t < last_bar THEN 3
      WHEN max_hold_bars > 0 AND t - entry_bar + 1 >= max_hold_bars AND t < last_bar THEN 5
      WHEN tod_exit_hour > 0 AND h = tod_exit_hour AND t < last_bar THEN 5
      WHEN t = last_bar THEN 4 END AS reason FROM hits),
firsts AS MATERIALIZED (SELECT combo_id, symbol, signal_bar, min(t) AS exit_bar FROM leaves WHERE reason IS NOT NULL GROUP BY 1, 2, 3),
resolved AS MATERIALIZED (
  SELECT l.combo_id, l.symbol, l.signal_bar, any_value(side) AS side, any_value(l.entry_bar) AS entry_bar, any_value(entry_price) AS entry_price,
    any_value(stop_pts) AS stop_pts,
    f.exit_bar, max(CASE WHEN t = f.exit_bar THEN reason END) AS exit_reason,
    max(CASE WHEN t = f.exit_bar THEN CASE reason WHEN 2 THEN tp_price WHEN 1 THEN stop_now WHEN 4 THEN close ELSE next_open END END) AS exit_price,
    greatest(0, max(favour)) AS mfe_pts, least(0, min(adverse)) AS mae_pts, f.exit_bar - any_value(l.entry_bar) + 1 AS hold_bars,
    greatest(f.exit_bar + 1, f.exit_bar + any_value(cooldown_bars)) AS free_at
  FROM leaves l JOIN firsts f ON f.combo_id = l.combo_id AND f.symbol = l.symbol AND f.signal_bar = l.signal_bar AND l.t <= f.exit_bar
  GROUP BY l.combo_id, l.symbol, l.signal_bar, f.exit_bar)"""
CHAIN = """, ptr AS MATERIALIZED (
  SELECT a.combo_id, a.symbol, a.signal_bar, min(b.signal_bar) AS nxt FROM resolved a
  LEFT JOIN resolved b ON b.combo_id = a.combo_id AND b.symbol = a.symbol AND b.signal_bar >= a.free_at GROUP BY 1, 2, 3),
chain AS (
  SELECT combo_id, symbol, min(signal_bar) AS signal_bar FROM resolved GROUP BY 1, 2
  UNION ALL
  SELECT p.combo_id, p.symbol, p.nxt FROM chain c JOIN ptr p USING (combo_id, symbol, signal_bar) WHERE p.nxt IS NOT NULL),
taken AS MATERIALIZED (SELECT r.* FROM resolved r JOIN chain USING (combo_id, symbol, signal_bar))"""
SETUP = (BARS, COMBOS)


def sweep_inputs(spark, d):
    b = materialise(bars(spark, d), "bars")
    sig = materialise(W.sweep_signals(b, combos(spark)), "signals")
    return b, sig, X.entries(sig, X.price_bars(b))


def resolved(spark, d):
    b, sig, cands = sweep_inputs(spark, d)
    return X.resolve_exits(cands, sig, b)


def swept(spark, d):
    b, sig, cands = sweep_inputs(spark, d)
    return X.backtest(cands, sig, b)


def wide_sweep(spark, d):
    """1,200 parameter sets over all bars, down to the trades taken; for timing."""
    rules = combos(spark).select("min_rr", *RULE_FIELDS).distinct()
    grid = W.product(rules, z_window=[12, 24], z_band_k=[0.8 + 0.1 * i for i in range(10)], stop_pts=[10.0 + 5.0 * i for i in range(20)])
    number = F.dense_rank().over(Window.orderBy("z_window", "z_band_k", "stop_pts", *RULE_FIELDS))
    many = materialise(grid.withColumn("combo_id", number), "combos")
    b = materialise(bars(spark, d), "bars")
    sig = materialise(W.sweep_signals(b, many), "signals")
    return X.backtest(X.entries(sig, X.price_bars(b)), sig, b)


@query("J1_combos_by_bars", sql(SWEEP + f"SELECT combo_id, symbol, bar_idx, signal, {r6('zscore')} AS zscore FROM sig", *SETUP))
def j1(spark, d):
    out = W.sweep_signals(bars(spark, d), combos(spark))
    return out.select("combo_id", "symbol", "bar_idx", col("signal").cast("int").alias("signal"), tidy(col("zscore")).alias("zscore"))


FIRST = "SELECT combo_id, symbol, signal_bar, exit_bar, exit_reason"


@query("J2_first_barrier", sql(SWEEP + WALK + f"{FIRST}, {r6('exit_price')} AS exit_price FROM resolved", *SETUP))
def j2(spark, d):
    return resolved(spark, d).select("combo_id", "symbol", "signal_bar", "exit_bar", "exit_reason", tidy(col("exit_price")).alias("exit_price"))


@query("J3_non_overlapping", sql(SWEEP + WALK + CHAIN + "SELECT combo_id, symbol, signal_bar, exit_bar FROM taken", *SETUP))
def j3(spark, d):
    return swept(spark, d).select("combo_id", "symbol", "signal_bar", "exit_bar")


@query("X1_entry_levels", sql(SWEEP + f"""SELECT combo_id, symbol, signal_bar, entry_bar, {r6('entry_price')} AS entry_price,
  {r6('sl_price')} AS sl_price, {r6('tp_price')} AS tp_price FROM cand""", *SETUP))
def x1(spark, d):
    out = sweep_inputs(spark, d)[2]
    return out.select("combo_id", "symbol", "signal_bar", "entry_bar", *[tidy(col(c)).alias(c) for c in ("entry_price", "sl_price", "tp_price")])


@query("X2_exit_reasons", sql(SWEEP + WALK + """SELECT combo_id, CASE exit_reason WHEN 1 THEN 'stop' WHEN 2 THEN 'take_profit'
  WHEN 3 THEN 'opposite' WHEN 4 THEN 'end_of_data' ELSE 'time' END AS reason, count(*) AS n FROM resolved GROUP BY 1, 2""", *SETUP))
def x2(spark, d):
    names = F.create_map(*[F.lit(v) for kv in X.EXIT_REASONS.items() for v in kv])
    return resolved(spark, d).groupBy("combo_id", names[col("exit_reason")].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("X3_stop_first_policy", sql(SWEEP + WALK.replace("WHEN tp_hit THEN 2 WHEN sl_hit THEN 1", "WHEN sl_hit THEN 1 WHEN tp_hit THEN 2")
                                   + f"{FIRST} FROM resolved", *SETUP))
def x3(spark, d):
    b, sig, cands = sweep_inputs(spark, d)
    return X.resolve_exits(cands, sig, b, tp_first=False).select("combo_id", "symbol", "signal_bar", "exit_bar", "exit_reason")


@query("X4_break_even", sql(SWEEP + WALK + f"{FIRST}, {r6('exit_price')} AS exit_price FROM resolved JOIN combos USING (combo_id) WHERE use_breakeven", *SETUP))
def x4(spark, d):
    out = resolved(spark, d).filter("use_breakeven")
    return out.select("combo_id", "symbol", "signal_bar", "exit_bar", "exit_reason", tidy(col("exit_price")).alias("exit_price"))


@query("X5_next_open_fills", sql(SWEEP + WALK + f"""SELECT combo_id, symbol, signal_bar, exit_bar, {r6('exit_price')} AS exit_price
  FROM resolved WHERE exit_reason IN (3, 5)""", *SETUP))
def x5(spark, d):
    out = resolved(spark, d).filter(col("exit_reason").isin(3, 5))
    return out.select("combo_id", "symbol", "signal_bar", "exit_bar", tidy(col("exit_price")).alias("exit_price"))


@query("X6_path_extremes", sql(SWEEP + WALK + f"SELECT combo_id, symbol, signal_bar, {r6('mae_pts')} AS mae_pts, {r6('mfe_pts')} AS mfe_pts FROM resolved", *SETUP))
def x6(spark, d):
    return resolved(spark, d).select("combo_id", "symbol", "signal_bar", tidy(col("mae_pts")).alias("mae_pts"), tidy(col("mfe_pts")).alias("mfe_pts"))


@query("X7_hold_bars", sql(SWEEP + WALK + CHAIN + "SELECT combo_id, symbol, signal_bar, hold_bars FROM taken", *SETUP))
def x7(spark, d):
    return swept(spark, d).select("combo_id", "symbol", "signal_bar", "hold_bars")


@query("X8_tick_rounding", sql(f"""SELECT symbol, bar_idx, round_even(close / 0.25::DOUBLE, 0) * 0.25 AS price,
  round_even(close / 5.0::DOUBLE, 0) * 5.0 AS coarse FROM bars""", BARS))
def x8(spark, d):
    return bars(spark, d).select("symbol", "bar_idx", tick_round(col("close"), 0.25).alias("price"), tick_round(col("close"), 5.0).alias("coarse"))


def tick(x):
    return f"(round_even(({x}) / 0.25::DOUBLE, 0) * 0.25::DOUBLE)"


X9_STOPS = f""", r AS (SELECT s.*, {S.mean('tr', 14)} AS atr, min(low) OVER {S.w(12)} AS lo, max(high) OVER {S.w(12)} AS hi,
  CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM s),
st AS (SELECT *, {tick('close - side * greatest(' + tick('20.0::DOUBLE') + ', 0.25)')} AS stop_fixed,
  {tick('close - side * greatest(' + tick('atr * 1.5::DOUBLE') + ', 0.25)')} AS stop_atr,
  CASE WHEN side = 1 THEN {tick('lo - 2 * 0.25::DOUBLE')} ELSE {tick('hi + 2 * 0.25::DOUBLE')} END AS raw FROM r WHERE atr IS NOT NULL),
sw AS (SELECT *, CASE WHEN (side = 1 AND raw >= close) OR (side = -1 AND raw <= close)
  THEN {tick('close - side * 0.25::DOUBLE')} ELSE raw END AS stop_swing FROM st)"""


@query("X9_price_levels", sql(S.SERIES + X9_STOPS + f"""SELECT symbol, bar_idx, stop_fixed, stop_atr, stop_swing,
  {tick('close + side * greatest(abs(close - stop_swing) * 2.0::DOUBLE, 0.25)')} AS target,
  floor(2500.0::DOUBLE / (abs(close - stop_swing) * 2.0::DOUBLE))::BIGINT AS contracts FROM sw WHERE abs(close - stop_swing) > 0""", BARS))
def x9(spark, d):
    df = N.with_rolling(N.add_atr(bars(spark, d), 14), 12, lo=lambda w: F.min("low").over(N.over_last(w, 12)),
                        hi=lambda w: F.max("high").over(N.over_last(w, 12))).filter("atr is not null")
    side = F.when(col("close") > col("open"), 1).otherwise(-1)
    df = df.withColumns({
        "side": side,
        "stop_fixed": X.stop_from_distance(side, col("close"), F.lit(20.0)),
        "stop_atr": X.stop_from_distance(side, col("close"), col("atr") * 1.5),
        "stop_swing": X.stop_from_swing(side, col("close"), col("lo"), col("hi"), 2),
    }).filter(F.abs(col("close") - col("stop_swing")) > 0)
    return df.select("symbol", "bar_idx", "stop_fixed", "stop_atr", "stop_swing",
                     X.target_from_stop(col("side"), col("close"), col("stop_swing"), 2.0).alias("target"),
                     X.contracts(F.lit(X.START_EQUITY * X.RISK_SHARE), F.abs(col("close") - col("stop_swing"))).alias("contracts"))


METHODS = [("fixed", 25.0, None, None), ("atr", None, 1.5, None), ("atr", None, 3.0, None), ("swing", None, None, 6), ("swing", None, None, 12)]


@query("X10_resolved_stops", sql(S.SERIES + f""", sp AS (SELECT symbol, {S.mean('tr', 14)} AS atr,
    {S.full('high', f"max(high) OVER {S.w(6)} - min(low) OVER {S.w(6)}", 6)} AS s6,
    {S.full('high', f"max(high) OVER {S.w(12)} - min(low) OVER {S.w(12)}", 12)} AS s12 FROM s),
  m AS (SELECT symbol, median(atr) AS atr, median(s6) AS s6, median(s12) AS s12 FROM sp GROUP BY 1)
  SELECT symbol, combo_id, {r6('''CASE combo_id WHEN 0 THEN 25.0 WHEN 1 THEN atr * 1.5 WHEN 2 THEN atr * 3.0
    WHEN 3 THEN s6 * 0.5 + 0.25 ELSE s12 * 0.5 + 0.25 END''')} AS stop_pts
  FROM m, (SELECT unnest([0, 1, 2, 3, 4])::INT AS combo_id)""", BARS))
def x10(spark, d):
    rows = [(i, *m) for i, m in enumerate(METHODS)]
    ways = spark.createDataFrame(rows, "combo_id int, stop_method string, stop_fixed_pts double, atr_multiplier double, swing_lookback int")
    return W.resolve_stops(ways, bars(spark, d)).select("symbol", "combo_id", tidy(col("stop_pts")).alias("stop_pts"))


@query("X11_contracts", sql("""SELECT combo_id, order_no, line_no, part_no, notional,
  floor(2500.0::DOUBLE / (stop_pts * 2))::BIGINT AS by_share, floor(500.0::DOUBLE / (stop_pts * 2))::BIGINT AS by_dollars FROM trades""", TRADES))
def x11(spark, d):
    return trades(spark, d).select(
        "combo_id", "order_no", "line_no", "part_no", "notional",
        X.contracts(F.lit(X.START_EQUITY * X.RISK_SHARE), col("stop_pts")).alias("by_share"),
        X.contracts(F.lit(X.FIXED_RISK), col("stop_pts")).alias("by_dollars"),
    )


@query("X12_money", sql(SWEEP + WALK + CHAIN + f""", k AS (SELECT *, floor(500.0::DOUBLE / (stop_pts * 2)) AS n, (exit_price - entry_price) * side AS pts FROM taken)
  SELECT combo_id, symbol, signal_bar, {r6('pts * n * 2')} AS gross_pnl, {r6('n * 5')} AS friction, {r6('pts * n * 2 - n * 5')} AS net_pnl,
  {r6('(pts * n * 2 - n * 5) / (stop_pts * n * 2)')} AS r_multiple, (pts * n * 2 - n * 5 > 0)::INT AS win FROM k""", *SETUP))
def x12(spark, d):
    t = swept(spark, d)
    n = X.contracts(F.lit(X.FIXED_RISK), col("stop_pts"))
    out = X.money(t, X.points(col("side"), col("entry_price"), col("exit_price")), n, F.lit(X.ROUND_TRIP_COST))
    return out.select("combo_id", "symbol", "signal_bar", *[tidy(col(c)).alias(c) for c in ("gross_pnl", "friction", "net_pnl", "r_multiple")], "win")


@query("X13_slippage_cost", sql("""SELECT combo_id, line_no, count(*) AS n, round(sum(line_no * 1.0::DOUBLE + 5.0::DOUBLE), 6) AS cost FROM trades GROUP BY 1, 2""", TRADES))
def x13(spark, d):
    cost = X.round_trip_cost(col("line_no"))
    return trades(spark, d).groupBy("combo_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@query("X14_quality_flags", sql(f"""SELECT combo_id, order_no, line_no, part_no, notional,
  (r_multiple < 0.5 - 1e-9)::INT AS breaks_min_rr, {r6('CASE WHEN abs(mae_pts) >= 0.25 THEN mfe_pts / abs(mae_pts) END')} AS path_ratio FROM trades""", TRADES))
def x14(spark, d):
    return trades(spark, d).select("combo_id", "order_no", "line_no", "part_no", "notional",
                                   X.breaks_min_rr(col("r_multiple"), F.lit(0.5)).alias("breaks_min_rr"),
                                   tidy(X.path_ratio(col("mfe_pts"), col("mae_pts"))).alias("path_ratio"))


def unit(x):
    return f"least(greatest({x}, 0), 1)"


@query("X15_entry_score", sql(SCORED + S.EMA_PAIR + f""", p AS (
  SELECT scored.symbol, scored.bar_idx, CASE WHEN z IS NOT NULL THEN {unit('abs(z) / 2.0')} END AS c1,
    CASE WHEN vz IS NOT NULL THEN {unit('(vz + 2) / 4')} END AS c2, {unit('abs(ema_fast - ema_slow) / 5.0')} AS c3,
    CASE WHEN scored.high - scored.low >= 0.25 THEN {unit('abs(scored.close - scored.open) / (scored.high - scored.low)')} END AS c4,
    CASE WHEN hm >= 830 AND hm < 1515 THEN 1.0 WHEN (hm >= 600 AND hm < 830) OR (hm >= 1515 AND hm < 1700) THEN 0.6 ELSE 0.3 END AS c5
  FROM (SELECT *, hour(time) * 100 + minute(time) AS hm FROM scored) scored JOIN (SELECT symbol, bar_idx, ema_fast, ema_slow FROM pair) pair USING (symbol, bar_idx))
  SELECT symbol, bar_idx, {r6('''(coalesce(0.25 * c1, 0) + coalesce(0.2 * c2, 0) + 0.2 * c3 + coalesce(0.2 * c4, 0) + 0.15 * c5)
    / ((CASE WHEN c1 IS NULL THEN 0 ELSE 0.25 END) + (CASE WHEN c2 IS NULL THEN 0 ELSE 0.2 END) + 0.2 + (CASE WHEN c4 IS NULL THEN 0 ELSE 0.2 END) + 0.15)''')} AS entry_score
  FROM p""", BARS))
def x15(spark, d):
    df = N.add_ema_pair(bars(spark, d), 8, 21)
    df = N.bar_shape(N.with_rolling(df, 20, z=lambda w: N.zscore(col("close"), w, 20), vz=lambda w: N.zscore(col("volume"), w, 20)))
    score = X.entry_score(col("z"), col("vz"), col("ema_spread"), col("bar_body"), col("bar_range"), hhmm(col("time")), 2.0, 5.0)
    return df.select("symbol", "bar_idx", tidy(score).alias("entry_score"))


@query("X16_reprice", sql(f"""SELECT combo_id, rr, count(*) AS n, {r6('avg(CASE WHEN mfe_pts >= rr * s - 1e-9 THEN rr WHEN mae_pts <= -s + 1e-9 THEN -1 ELSE r_multiple END)')} AS mean_r
  FROM (SELECT *, stop_pts / 5.0::DOUBLE AS s FROM trades), (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS rr) GROUP BY 1, 2""", TRADES))
def x16(spark, d):
    t = W.product(trades(spark, d), rr=[1.0, 2.0, 3.0])
    new = X.reprice(col("rr"), col("mfe_pts"), col("mae_pts"), col("stop_pts") / 5.0, col("r_multiple"))
    return t.groupBy("combo_id", "rr").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg(new)).alias("mean_r"))


GROWTH = """, g AS (SELECT *, sum(ln(1 + 0.002::DOUBLE * r_multiple)) OVER (PARTITION BY combo_id ORDER BY seq) AS lg,
  ln(1 + 0.002::DOUBLE * r_multiple) AS own FROM ordered_trades)"""


def compounded(spark, d):
    t = ordered_trades(spark, d)
    return X.compounded_equity(t, ["combo_id"], ["seq"], seq_block(), col("r_multiple"), 0.002, X.START_EQUITY)


@query("X17_compounded_equity", sql(GROWTH + f"SELECT combo_id, seq, {r6('50000 * exp(lg)', 4)} AS equity FROM g", TRADES))
def x17(spark, d):
    return compounded(spark, d).select("combo_id", "seq", tidy(col("equity"), 4).alias("equity"))


@query("X18_compounded_pnl", sql(GROWTH + f"SELECT combo_id, seq, {r6('50000 * exp(lg) - 50000 * exp(lg - own)', 4)} AS trade_pnl FROM g", TRADES))
def x18(spark, d):
    return compounded(spark, d).select("combo_id", "seq", tidy(col("trade_pnl"), 4).alias("trade_pnl"))


# the flagship walk: reversal signals, entry at the next open, exit 12 bars after the signal
FLAT = SCORED + f""", sigs AS (SELECT symbol, bar_idx, {encoded(LONG, SHORT)} AS signal FROM scored),
fixed AS (SELECT symbol, bar_idx, open, lead(open) {LAG} AS entry_price, lead(close, 12) {LAG} AS exit_price FROM bars),
held AS MATERIALIZED (SELECT symbol, bar_idx, signal, (exit_price - entry_price) * signal AS pts FROM sigs JOIN fixed USING (symbol, bar_idx)
  WHERE signal <> 0 AND exit_price IS NOT NULL)"""


def fixed_hold_trades(spark, d, hold=12):
    def build(frame, w):
        return frame.withColumns({
            "z": N.zscore(col("close"), w, 20), "entry_price": F.lead("open").over(w), "exit_price": F.lead("close", hold).over(w)
        }).withColumn("zp", F.lag("z").over(w))

    df = rolling(bars(spark, d), ["symbol"], "bar_idx", build, back=21, ahead=hold)
    df = df.withColumn("signal", G.encode(G.reversal(col("z"), col("zp"), F.lit(1.5))))
    df = df.filter((col("signal") != 0) & col("exit_price").isNotNull())
    return df.withColumn("pts", X.points(col("signal"), col("entry_price"), col("exit_price")))


@query("S0_bars_to_metrics", sql(FLAT + f"""SELECT symbol, count(*) AS n_trades, {r6('avg((pts > 0)::INT)')} AS win_rate,
  {r6('sum(pts)')} AS total_pts, {r6('avg(pts)')} AS mean_pts, {r6('stddev_samp(pts)')} AS std_pts,
  {r6('coalesce(avg(pts) / nullif(stddev_samp(pts), 0), 0)')} AS sharpe FROM held GROUP BY 1""", BARS))
def s0(spark, d):
    t = fixed_hold_trades(spark, d)
    mean, std = F.avg("pts"), F.stddev_samp("pts")
    return t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), tidy(F.avg((col("pts") > 0).cast("int"))).alias("win_rate"),
        tidy(F.sum("pts")).alias("total_pts"), tidy(mean).alias("mean_pts"), tidy(std).alias("std_pts"),
        tidy(F.coalesce(mean / F.nullif(std, F.lit(0.0)), F.lit(0.0))).alias("sharpe"),
    )
