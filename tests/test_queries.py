"""Every registered query against its SQL on the smallest tables (ORACLE_SF chooses others)."""

import os

import pytest

import __spark_entry__ as entry
import compare
from tradeloom import plans

SF_DIR = f"{compare.ROOT}/{os.environ.get('ORACLE_SF', 'sf0.001')}"
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE
# These need more rows than the smallest tables have; an empty result is right there.
MAY_BE_EMPTY = {"T2_whole_windows", "T17_resample_checks", "A11b_walk_forward_gate"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    diff = compare.compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert not diff or (name in MAY_BE_EMPTY and diff in ("both empty", "no rows")), diff


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_entry_lists_every_query():
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_only_models_lack_sql():
    assert {n.split("_")[0] for n in QUERIES if n not in ORACLE} <= {"C16b", "C17", "C18", "C18b", "C18c", "C19", "K3b", "K12b"}
