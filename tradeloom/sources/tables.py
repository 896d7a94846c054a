"""Parquet tables: scans, append sinks, keyed upserts, schema normalisation and key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000
VERSION_PATTERN = r".*[/_]v(\d+)"


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the listed columns are read."""
    return spark.read.parquet(path).select(*columns)


def append(df: DataFrame, path: str, partition: str) -> None:
    """Add rows under their partition. Rows go to writers by partition and a salt, so that a large
    partition is written by many tasks and a small one by few."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(tasks))
    spread = df.withColumn("_salt", salt).repartition(tasks, partition, "_salt").drop("_salt")
    spread.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite the partitions present in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the one with the highest version, changes before stored rows on a tie.

    An aggregate of the newest row, combined on the map side, rather than a window per key.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*stored.columns).withColumn("_new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*stored.columns)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not completed yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def normalise(df: DataFrame, renames: dict[str, str], columns: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """The wanted columns in order and type: renamed, missing ones NULL or their default, others dropped."""
    defaults = defaults or {}
    out = df.withColumnsRenamed(renames)
    picks = []
    for name, kind in columns.items():
        value = F.col(name).cast(kind) if name in out.columns else F.lit(None).cast(kind)
        if name in defaults:
            value = F.coalesce(value, defaults[name].cast(kind))
        picks.append(value.alias(name))
    return out.select(*picks)


def build_key(version: Column, number: Column) -> Column:
    """v<version>_<number>"""
    return F.concat(F.lit("v"), version.cast("string"), F.lit("_"), number.cast("string"))


def parse_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "_")
    return F.substring(F.get(parts, F.lit(0)), 2, 10).cast("int"), F.get(parts, F.lit(1)).cast("bigint")


def version_of_file(path: Column) -> Column:
    """The last version number in a path, NULL if there is none."""
    return F.nullif(F.regexp_extract(path, VERSION_PATTERN, 1), F.lit("")).cast("int")


def read_versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several sweep tables with the version of each row's path."""
    df = spark.read.parquet(*paths)
    return df.withColumn("sweep_version", version_of_file(F.input_file_name()))
