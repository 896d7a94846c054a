"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def map_rows(df: DataFrame, rows: Callable[[list], Iterator[tuple] | list[tuple]], schema: str, chunk: int = 512) -> DataFrame:
    """Apply ``rows`` to lists of input tuples, ``chunk`` at a time, and collect its output tuples into Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = list(rows(list(zip(*(c.to_pylist() for c in part.columns)))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Cut a partition sorted by integer ``keys`` into pieces of whole groups; columns come as numpy arrays.

    Only the last group of a batch is held back, so memory is one batch and one group.
    """
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in now}
        size = len(now[keys[0]])
        same = np.ones(size, dtype=bool)
        for k in keys:
            same &= now[k] == now[k][-1]
        cut = int(size - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield {n: v[:cut] for n, v in now.items()}
        held = {n: v[cut:] for n, v in now.items()}
    if held is not None:
        yield held


_STEPS: list[str] = []  # folders written by this driver, in order


def step(df: DataFrame, name: str) -> DataFrame:
    """Write a finished step and read it back; the shuffle files it no longer needs leave the disks at once.

    Spark drops them when the driver's objects are collected, which a driver with a large heap may never do by itself.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _STEPS.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Remove the files of steps whose last reader has been written; frames that are no step are left alone."""
    for df in frames:
        folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in _STEPS if p.rsplit("/", 1)[-1] in folders]:
            _remove(df.sparkSession, path)
            _STEPS.remove(path)


def finish(result: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write a whole result and read it back; the steps it wrote on the way have no reader left and are removed."""
    before = len(_STEPS)
    out = step(result(), name)
    for path in _STEPS[before:-1]:
        _remove(out.sparkSession, path)
    del _STEPS[before:]
    return out


def text_hash(text: Column) -> Column:
    """Second half of a row's key; rows that share id and text are alike in every result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores put before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def same_row(docs: DataFrame, doc_id: str, text_key: str) -> Column:
    """Join condition: the id, null or not, and the text of ``docs`` are those of a keyed row."""
    return docs["doc_id"].eqNullSafe(F.col(doc_id)) & (text_hash(docs["text"]) == F.col(text_key))


def keep_smallest(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``rooted`` (doc_id, text_key, root): the smallest id, then the smallest text_key.

    A row without an id stays only where no member has one. Rows alike in id and text are kept once. Further columns, of any
    name, stay as they are; an empty table stays empty.
    """
    kept, key, rows = free_names(docs, "_kept", "_key", "_rows")
    each = rooted.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("best"))
    chosen = best.select(F.col("best.doc_id").alias(kept), F.col("best.text_key").alias(key), F.col("best.n").alias(rows))
    joined = docs.join(chosen, same_row(docs, kept, key)).select(*[docs[c] for c in docs.columns], key, rows)
    once = joined.where(F.col(rows) == 1).drop(key, rows)
    return once.unionByName(joined.where(F.col(rows) > 1).dropDuplicates(["doc_id", key]).drop(key, rows))
