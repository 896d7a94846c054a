"""Small literal frames for the rules that are easy to get wrong, and brute-force checks."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeloom.functions import clock, maths
from tradeloom.operators import bars as B
from tradeloom.operators import calibrate as C
from tradeloom.operators import features as FE
from tradeloom.operators import indicators as N
from tradeloom.operators import learn as ML
from tradeloom.operators import ledger as L
from tradeloom.operators import metrics as M
from tradeloom.operators import neighbours as NN
from tradeloom.operators import ranking as K
from tradeloom.operators import resample as R
from tradeloom.operators import sweep as W
from tradeloom.operators.ordered import place_in


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def minutes(spark, n, symbol="s"):
    rows = [(symbol, dt.datetime(2024, 1, 2, 9, i), 10.0 + i, 11.0 + i, 9.0, 10.5 + i, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume double")


def test_constant_window_scores(spark):
    df = spark.createDataFrame([("s", i, 5.0, 5.0, 5.0) for i in range(5)], "symbol string, bar_idx bigint, close double, high double, low double")
    plain = N.with_rolling(df, 3, z=lambda w: N.zscore(F.col("close"), w, 3)).orderBy("bar_idx")
    assert one(plain, "z") == [None, None, 0.0, 0.0, 0.0]
    assert one(N.variant_zscore(df, 3, "z"), "z") == [None] * 5


@pytest.mark.parametrize("n,windows", [(15, 1), (14, 0)])
def test_partial_windows_are_dropped(spark, n, windows):
    assert B.resample(minutes(spark, n), "15 minutes", expected=15).count() == windows


def test_resample_keeps_volume(spark):
    checks = B.resample_checks(minutes(spark, 37), "5 minutes", 5).first()
    assert checks.n_windows == 7 and checks.conserved and checks.extremes_ok


def test_zone_edges(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-11-03 01:30:00' AS a, timestamp_ntz'2024-03-10 02:30:00' AS b, timestamp_ntz'2024-03-10 01:30:00' AS c")
    got = df.select(*[clock.to_exchange_zone(F.col(c)).cast("string").alias(c) for c in "abc"]).first()
    assert (got.a, got.b, got.c) == ("2024-11-03 01:30:00", "2024-03-10 04:30:00", "2024-03-10 03:30:00")


def test_session_masks_cover_the_day_once(spark):
    df = spark.range(1440).select(F.col("id").alias("m"))
    masks = clock.session_masks(F.col("m"))
    cover = sum((masks[n].cast("int") for n in ("rth", "post_rth", "overnight")), F.lit(0))
    assert df.select(cover.alias("c")).filter("c <> 1").count() == 0


def test_probit_and_normal_curve(spark):
    xs = [-8.5, -3.0, -1.0, 0.0, 0.5, 2.0, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = one(df, maths.normal_cdf(F.col("x")))
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-14)
    back = one(df.select(maths.normal_cdf(F.col("x")).alias("p")).filter("p between 0.001 and 0.999"), maths.probit(F.col("p")))
    assert np.allclose(back, [-3.0, -1.0, 0.0, 0.5, 2.0], atol=5e-4)


def test_tick_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (10.1,)], "p double")
    assert one(df, maths.tick_round(F.col("p"), 0.25)) == [0.0, 0.5, 10.0]


def test_mid_rank_averages_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0])], "i int, v double")
    w = Window.orderBy("i")
    assert one(df.select(N.mid_rank(F.col("v"), w, 4).alias("r")), "r")[-1] == (3.0 - 0.5) / 4


def test_rank_share_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0), (4, None)], "id int, m double")
    got = {r.id: r.composite_score for r in K.composite_score(df, "id", {"m": 1.0}, ()).collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}


def test_streak_and_profit_factor(spark):
    wins = [1, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([(1, i, w, 1.0 if w else -1.0) for i, w in enumerate(wins)], "k int, seq bigint, win int, pnl double")
    assert M.losing_streak(df, ["k"], ["seq"], [F.col("seq")]).first()[1] == 3
    assert df.agg(M.profit_factor(F.col("pnl"))).first()[0] == 0.4
    assert df.filter("win = 1").agg(M.profit_factor(F.col("pnl"))).first()[0] == 100.0


def test_drawdown_may_pass_one_hundred_percent(spark):
    df = spark.createDataFrame([(1, 0, -150.0)], "k int, seq bigint, pnl double")
    assert M.max_drawdown(df, ["k"], ["seq"], [F.col("seq")], "pnl", 100.0).first().max_drawdown_pct == 150.0


def test_empty_ledger_days_keep_equity(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 1, 4), -2.0)], "d date, p double")
    assert one(L.daily_ledger(df, [], "d", "p", 100.0).orderBy("day"), "equity_eod") == [105.0, 105.0, 105.0, 103.0]


def test_correlation_of_pool(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"d": np.tile(np.arange(40), 3), "m": np.repeat(["a", "b", "flat"], 40), "p": np.concatenate([rng.normal(size=80), np.full(40, 2.0)])})
    got = L.correlation_matrix(spark.createDataFrame(data).repartition(7), "m", "d", "p").toPandas().pivot(index="member_a", columns="member_b", values="corr")
    assert np.isclose(got.loc["a", "b"], np.corrcoef(data.p[:40], data.p[40:80])[0, 1]) and np.isclose(got.loc["a", "a"], 1) and got.loc["a", "flat"] == 0


def test_jaccard_with_itself(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "b string, m int")
    got = {(r.basket_a, r.basket_b): r.jaccard for r in K.jaccard_matrix(df, "b", "m").collect()}
    assert got == {("x", "x"): 1.0, ("y", "y"): 1.0, ("x", "y"): 0.0, ("y", "x"): 0.0}


def test_history_flag_and_defaults(spark):
    df = spark.createDataFrame([(1, i, i % 2, 1.0) for i in range(40)], "k int, seq bigint, win int, r_multiple double")
    got = FE.lagged_outcomes(df, ["k"]).orderBy("seq").collect()
    assert [r.has_history_50 for r in got].index(1) == 25
    assert [r.prior_wr_10 for r in got[:4]] == [0.5, 0.5, 0.5, pytest.approx(1 / 3)] and got[9].prior_wr_50 == 0.5 and got[10].prior_wr_50 == 0.5
    assert got[2].prior_r_ma10 == 0.0 and got[3].prior_r_ma10 == 1.0


def test_best_level_takes_lowest_on_ties(spark):
    df = spark.createDataFrame([(0.0,)], "p double")
    assert df.select(FE.best_level(lambda rr: 1.0 / (1.0 + rr)).alias("b")).first().b.rr == 1.0


def test_same_bar_trades_in_portfolio(spark):
    df = spark.createDataFrame([(1, 0, 5, 5, 10.0), (1, 1, 6, 8, -4.0)], "combo_id int, seq bigint, entry_bar bigint, exit_bar bigint, pnl double")
    both = FE.portfolio_equity(df, ["combo_id", "seq"], start=100.0).orderBy("exit_bar")
    assert one(both, "equity_after") == [110.0, 106.0]
    assert one(FE.portfolio_equity(df, ["combo_id", "seq"], start=100.0, same_bar_trades=False), "equity_after") == [96.0]


def test_probability_one_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(1.0, 1), (0.97, 0)], "p double, y int")
    assert one(df, C.equal_width_bin(F.col("p"))) == [19, 19]
    assert C.ece(df, [], "p", "y").first().n == 2


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("a", 0.3, 1), ("b", 0.2, 0), ("b", 0.7, 1), ("b", 0.2, 1)], "k string, p double, y int")
    got = {r.k: r.auc for r in C.auc(df, ["k"], "p", "y").collect()}
    assert got == {"a": None, "b": 0.75}


def pooled(ps, ys):
    """Row-at-a-time pooling for the tests."""
    blocks = []
    for p in sorted(set(ps)):
        y = [b for a, b in zip(ps, ys) if a == p]
        blocks.append([p, p, len(y), sum(y)])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = [x for b in blocks for x in (b[0], b[1])]
    return xs, [v for b in blocks for v in (b[3] / b[2],) * 2]


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(8)
    p = np.round(rng.random(900), 3)
    return pd.DataFrame({"k": np.where(np.arange(900) < 700, "hot", "b"), "seq": np.concatenate([np.arange(700), np.arange(200)]), "p": p, "y": (rng.random(900) < p**2).astype(int)})


def test_isotonic_matches_plain_pooling(spark, scored):
    fit = C.knots(C.isotonic(spark.createDataFrame(scored).repartition(6), ["k"], "p", "y"), ["k"])
    got = {r.k: (r.x, r.v) for r in fit.collect()}
    for k, g in scored.groupby("k"):
        xs, vs = pooled(list(g.p), list(g.y))
        grid = np.linspace(-0.1, 1.1, 200)
        assert np.allclose(np.interp(grid, *got[k]), np.interp(grid, xs, vs))
        assert all(np.diff(got[k][1]) >= 0)


@pytest.mark.parametrize("dims,chunk,cell_rows", [(2, 2048, 256), (2, 16, 8), (20, 50, 5)])
def test_nearest_matches_brute_force(spark, monkeypatch, dims, chunk, cell_rows):
    monkeypatch.setattr(NN, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(NN, "FLAT", 64 if chunk > 1000 else 3)
    monkeypatch.setattr(NN, "PART_ROWS", chunk)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (120, dims)), np.tile(rng.normal(5, 1, (1, dims)), (40, 1)) + rng.normal(0, 1e-3, (40, dims))])  # a dense clump
    grp = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, list(map(float, v)), int(g)) for i, (v, g) in enumerate(zip(x, grp))], "id bigint, vec array<double>, grp bigint")
    got = NN.nearest(df, 5, held_out=[0, 1, 2], cell_rows=cell_rows).toPandas()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    for skip in range(3):
        d = np.where(grp[None, :] == skip, np.inf, dist)
        for i, g in got[got.skip == skip].groupby("id"):
            assert list(g.sort_values("rank").neighbour) == list(np.argsort(d[i], kind="stable")[:5])
    assert len(got) == 3 * 5 * len(x)


def test_metric_tree_prunes(spark):
    """In few dimensions a row is measured against few others, and no neighbour is lost."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (500, 3)) for c in rng.uniform(-8, 8, (6, 3))])
    df = spark.createDataFrame([(i, list(map(float, v)), -1) for i, v in enumerate(x)], "id bigint, vec array<double>, grp bigint")
    tree = NN.MetricTree(df, 32)
    first = NN._search(tree.rows.select("id", "vec", "cell"), tree.rows.select("id", "vec", "grp", "cell"), tree.cells, 5, [-2])
    assert tree.measured_share(tree.visits(first, 5, [-2])) < 0.2
    got = NN.nearest(df.drop("grp"), 5, cell_rows=32).toPandas()
    for i in range(0, 3000, 50):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 12)
        d[i] = np.inf
        assert list(got[got.id == i].sort_values("rank").neighbour) == list(np.argsort(d, kind="stable")[:5])

def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    got = R.shuffle_column(df, ["id"], "v", 3).toPandas()
    assert sorted(got.v_shuffled) == sorted(got.v) and (got.v_shuffled != got.v).mean() > 0.9


def test_block_permutation_stays_inside(spark):
    df = spark.range(34).select(F.lit(1).alias("k"), F.floor(F.col("id") / 17).alias("b"), F.col("id").alias("seq"), F.col("id").alias("v"))
    got = R.permute_in_blocks(df, ["k"], "b", "seq", "v", 1).toPandas()
    for _, g in got.groupby("b"):
        assert sorted(g.v_permuted) == sorted(g.v)


def test_salted_params_join(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 2).cast("int").alias("z"), F.col("id").alias("x"))
    params = spark.range(10).select((F.col("id") % 2).cast("int").alias("z"), F.col("id").alias("c"))
    want = {(r.x, r.c) for r in W.join_params(rows, params, ["z"]).collect()}
    monkeypatch.setattr(W, "BROADCAST_ROWS", 3)
    got = W.join_params(rows, params, ["z"]).collect()
    assert {(r.x, r.c) for r in got} == want and len(got) == len(want) == 1500


def test_stratified_budgets_share_what_caps_leave(spark):
    df = spark.createDataFrame([("a",)] * 80 + [("b",)] * 10 + [("c",)] * 10, "s string")
    got = {r.s: r.budget for r in K.stratified_budgets(df, "s", 40, 0.5).collect()}
    assert got == {"a": 20, "b": 10, "c": 10}


def test_models_learn_a_step(spark):
    rng = np.random.default_rng(0)
    x = rng.random(600)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (x > 0.5).astype(float), "t": x * 2, "fold": np.arange(600) % 2}))
    scored = ML.out_of_fold_probabilities(df, ["x"], "y", "fold", 2, rounds=3)
    assert scored.count() == 600 and C.auc(scored, [], "pwin_model", "y").first()[0] > 0.95
    fit = C.regression_metrics(ML.out_of_fold_scores(df, ["x"], "t", "fold", 2, rounds=5), [], "pred", "t").first()
    assert fit.r2 > 0.9
    assert ML.ridge_blend(df, ["x"], "t", F.col("fold") == 0, [0.0]).first().r2 > 0.999
    assert one(ML.importances(df, ["x"], "t", rounds=2), "importance") == [1.0]


def test_scores_without_losses_are_null(spark):
    row = dict(early_n=40, early_sharpe=1.0, early_avg_r=0.2, early_pf=None, early_wr=1.0, early_total_pnl=100.0, early_max_dd=10.0)
    schema = ", ".join(f"{k} {'long' if k == 'early_n' else 'double'}" for k in row)
    out = M.composites(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert out["C4_pf_log_n"] is None and out["C5_sharpe"] == 1.0


def test_merged_moments_far_from_zero(spark):
    values = [1e9 + k % 7 for k in range(700)]
    df = spark.createDataFrame([("k", i % 5, v) for i, v in enumerate(values)], "k string, b int, x double")
    out = M.merge_moments(M.partial_moments(df, ["k"], [F.col("b")], "x"), ["k"]).first()
    mean = sum(values) / len(values)
    want = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5
    assert out["n"] == 700 and abs(out["std"] - want) < 1e-6


def test_place_in_halves(spark):
    edges = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 9.0, 10.0)], "v double").withColumn("e", F.array(*[F.lit(x) for x in edges]))
    rows = df.select("v", place_in(F.col("e"), F.col("v"), 100).alias("at")).collect()
    assert {r["v"]: r["at"] for r in rows} == {r["v"]: sum(x < r["v"] for x in edges) for r in rows}


def test_times_with_a_zone_are_refused(spark):
    bars = spark.sql("SELECT TIMESTAMP_NTZ'2020-01-01 00:00:00' AS time")
    assert B.check_contract(bars).first()["ok"]
    with pytest.raises(TypeError):
        B.check_contract(bars.withColumn("time", F.col("time").cast("timestamp_ltz")))
