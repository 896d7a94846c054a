"""Members in exactly one of two baskets, from one count per member."""

from pyspark.sql import functions as F

from tradeloom import plans
from tradeloom.operators import ranking as K


def test_members_of_one_basket_only(spark):
    rows = [("both", h) for h in (1, 1, 2, 2)] + [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 2), ("few", 1), ("few", 2), (None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "member string, half int")
    out = K.basket_difference(df, "member", F.col("half") == 1, F.col("half") == 2, 2)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "a"), ("b", "b")]
    assert K.basket_difference(df.limit(0), "member", F.col("half") == 1, F.col("half") == 2, 2).count() == 0


def test_no_join_of_rows(spark):
    out = plans.QUERIES["J8_basket_difference"](spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
