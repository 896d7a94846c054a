"""CSV and JSON artifacts: manifests, trade logs, ledgers, top-k summaries and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON object per combo."""
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON lines, or one array per file if ``array``."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def summary_json(parameters: list[str], realised: list[str], key: str) -> Column:
    """{key, parameters: {...}, realised: {...}} as JSON text."""
    return F.to_json(F.struct(F.col(key), F.struct(*parameters).alias("parameters"), F.struct(*realised).alias("realised")))


def run_metadata(facts: DataFrame, run_id: str, config: dict[str, object]) -> DataFrame:
    """The one-row facts of a run with its id and a snapshot of its settings."""
    pairs = [F.lit(str(v)) for kv in sorted(config.items()) for v in kv]
    return facts.withColumns({"run_id": F.lit(run_id), "config": F.create_map(*pairs)})
