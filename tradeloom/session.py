"""Session settings and scratch locations."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def tune_session(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, on which results depend; size shuffles only on a local master that has no size set."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.master.startswith("local") and conf.get("spark.sql.shuffle.partitions") == "200":
        conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting falls back to a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one intermediate table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write an intermediate table once and read it back, so later uses do not recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(df, name: str):
    """``materialise``, after which the shuffle files that went into the table leave the disks: the driver collects its garbage."""
    out = materialise(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
