"""Queries on trades whose order numbers pass several ranges of a million, against their SQL."""

import os

import pytest

import compare
from tradeloom import plans

NAMES = "A4 A5 A7 A8 A11 A13 A14 A16 A17 A32 A41 A42 C20".split()


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("wide"))
    source = f"{compare.ROOT}/sf0.001"
    for t in compare.TABLES:
        if t != "lineitem":
            os.symlink(f"{source}/{t}.parquet", f"{folder}/{t}.parquet")
    con = compare.duck(source)
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey * 7919 % 9000001 AS l_orderkey) FROM lineitem) TO '{folder}/lineitem.parquet'")
    return folder


@pytest.mark.parametrize("short", NAMES)
def test_order_numbers_over_a_million(spark, wide, short):
    name = next(n for n in plans.QUERIES if n.startswith(f"{short}_"))
    diff = compare.compare(spark, compare.duck(wide), name, plans.QUERIES[name], plans.ORACLE[name], wide)
    assert not diff, diff


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Every trade forty times in the same combo, so that a window holds few probabilities."""
    folder = str(tmp_path_factory.mktemp("copied"))
    con = compare.duck(f"{compare.ROOT}/sf0.001")
    con.execute(f"""COPY (SELECT l.* REPLACE (l_orderkey + 10000 * i AS l_orderkey) FROM lineitem l, (SELECT unnest(range(40)) AS i) WHERE l_suppkey < 5 AND l_orderkey % 20 = 0)
      TO '{folder}/lineitem.parquet'""")
    for t in compare.TABLES:
        if t != "lineitem":
            os.symlink(f"{compare.ROOT}/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("short", ["C10", "C11", "C20", "C21"])
def test_probabilities_that_no_learned_row_has(spark, copied, short):
    name = next(n for n in plans.QUERIES if n.startswith(f"{short}_"))
    diff = compare.compare(spark, compare.duck(copied), name, plans.QUERIES[name], plans.ORACLE[name], copied)
    assert not diff, diff
