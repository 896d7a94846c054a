"""Keyed tables: which files a change rewrites, newest rows, repetition."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradeloom.session import scratch_path
from tradeloom.sources.keyed import create_keyed, read_keyed, upsert_keyed

SCHEMA = "k long, g string, v string, version int"


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


@pytest.fixture()
def path(spark):
    path = scratch_path(spark, "keyed")
    rows = [(k, "ab"[k % 2], f"v{k}", 1) for k in range(500)] + [(None, "a", "none", 1), (3, "b", "newer", 2), (3, "b", "older", 0)]
    create_keyed(spark.createDataFrame(rows, SCHEMA), path, ["k", "g"], "version", 16)
    return path


def test_newest_row_per_key_is_stored(spark, path):
    got = {(r.k, r.g): (r.v, r.version) for r in read_keyed(spark, path).collect()}
    assert len(got) == 501 and got[3, "b"] == ("newer", 2) and got[None, "a"] == ("none", 1)
    assert len(files(path)) == 16


def test_one_key_rewrites_one_bucket(spark, path):
    before = files(path)
    touched = upsert_keyed(spark.createDataFrame([(8, "a", "changed", 2)], SCHEMA), path)
    after = files(path)
    assert len(touched) == 1 and len(before - after) == len(after - before) == 1
    assert next(iter(after - before)).startswith(f"rows/_bucket={touched[0]}/")
    got = {(r.k, r.g): r.v for r in read_keyed(spark, path).collect()}
    assert len(got) == 501 and got[8, "a"] == "changed"
    assert [r.v for r in read_keyed(spark, path, {"k": 8, "g": "a"}).collect()] == ["changed"]
    plan = read_keyed(spark, path, {"k": 8, "g": "a"})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_repetition_versions_and_nulls(spark, path):
    changes = spark.createDataFrame([(1, "b", "stale", 0), (2, "a", "same", 1), (900, "a", "new", 1), (900, "a", "newest", 5), (None, "a", "still none", 2)], SCHEMA)
    upsert_keyed(changes.withColumn("extra", F.lit(1)), path)
    once = sorted(map(tuple, read_keyed(spark, path).collect()), key=str)
    upsert_keyed(changes, path)
    assert sorted(map(tuple, read_keyed(spark, path).collect()), key=str) == once
    got = {(r[0], r[1]): r[2] for r in once}
    assert len(once) == 502 and got[1, "b"] == "v1" and got[2, "a"] == "same" and got[900, "a"] == "newest" and got[None, "a"] == "still none"
    kept = files(path)
    assert upsert_keyed(changes.where(F.lit(False)), path) == [] and files(path) == kept


def test_wrong_use(spark, path):
    df = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    with pytest.raises(ValueError):
        create_keyed(df, scratch_path(spark, "keyed"), ["k"], "version", 0)
    with pytest.raises(ValueError):
        create_keyed(df.withColumn("_bucket", F.lit(1)), scratch_path(spark, "keyed"), ["k"], "version", 4)
