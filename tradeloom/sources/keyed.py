"""A keyed Parquet table in hash buckets: a change rewrites only the buckets its keys fall into.

A bucket is a partition folder. A one-row manifest beside the data says how many buckets there are, by which keys and which
version column; every reader and writer takes them from there. An upsert finds the buckets its changes touch, reads those
alone by partition pruning, keeps the newest row per key and replaces the folders by dynamic overwrite. Repeating an upsert,
after a failure as well, gives the same table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tradeloom.sources.tables import ROWS_PER_FILE, upsert

BUCKET = "_bucket"
MOST_BUCKETS = 1 << 16  # bounds what an upsert lists on the driver


def _paths(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/manifest"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(df: DataFrame, keys: list[str], buckets: int, path: str, mode: str) -> None:
    """Rows go to writers by bucket, so a bucket is one file unless it is too long for one."""
    placed = df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET)
    writer = placed.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET).parquet(path)


def create_keyed(df: DataFrame, path: str, keys: list[str], version: str, buckets: int) -> None:
    """Store ``df``, of which the newest row per key stays, in ``buckets`` buckets; the path must be new."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} names the bucket")
    rows, manifest = _paths(path)
    _write(upsert(df.limit(0), df, keys, version), keys, buckets, rows, "errorifexists")
    facts = df.sparkSession.createDataFrame([(buckets, keys, version, df.schema.json())], "buckets int, keys array<string>, version string, schema string")
    facts.coalesce(1).write.mode("errorifexists").json(manifest)


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BUCKET, IntegerType())])


def _manifest(spark: SparkSession, path: str):
    facts = spark.read.schema("buckets int, keys array<string>, version string, schema string").json(_paths(path)[1]).first()
    if facts is None:
        raise ValueError(f"no keyed table in {path}")
    return facts, StructType.fromJson(json.loads(facts.schema))


def read_keyed(spark: SparkSession, path: str, key: dict | None = None) -> DataFrame:
    """The table, or the rows of one key, read from its bucket alone."""
    facts, schema = _manifest(spark, path)
    stored = spark.read.schema(_stored(schema)).parquet(_paths(path)[0])
    if key is not None:
        types = dict(stored.dtypes)
        at = spark.range(1).select(_bucket_of(facts, {k: F.lit(v).cast(types[k]) for k, v in key.items()})).first()[0]
        stored = stored.filter(F.col(BUCKET) == at)
        for k, v in key.items():
            stored = stored.filter(F.col(k).eqNullSafe(F.lit(v).cast(types[k])))
    return stored.drop(BUCKET)


def _bucket_of(facts, values: dict[str, Column]) -> Column:
    return F.pmod(F.xxhash64(*[values[k] for k in facts["keys"]]), F.lit(facts.buckets)).cast("int")


def upsert_keyed(changes: DataFrame, path: str) -> list[int]:
    """Put ``changes`` into the stored table and return the buckets rewritten.

    The highest version of a key wins, a change over a stored row of the same version. Keys may be NULL and repeated in the
    changes; columns that the table does not have are left out. Without changes nothing is written.
    """
    spark = changes.sparkSession
    facts, schema = _manifest(spark, path)
    keys, rows = list(facts["keys"]), _paths(path)[0]
    fresh = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    touched = sorted(r[0] for r in fresh.select(_bucket(keys, facts.buckets).alias("b")).distinct().collect())  # at most MOST_BUCKETS numbers
    if not touched:
        return []
    stored = spark.read.schema(_stored(schema)).parquet(rows).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    _write(upsert(stored, fresh, keys, facts.version), keys, facts.buckets, rows, "overwrite")
    return touched
