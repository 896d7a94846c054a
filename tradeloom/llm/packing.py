"""Packing token ids into sequences by cutting-stock column generation.

Every document is cut into whole sequences of ``LENGTH`` ids and one remainder. Remainders are counted by length class; the
linear program that covers the counts with the fewest sequences is solved by column generation, each new pattern priced by
a knapsack dynamic program, and the patterns' rounded multiplicities are completed by filling sequences from what is left.
The plan is a table of at most a few thousand rows whatever the corpus holds; ranked remainders look up their sequence in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import map_rows, step, table
from tradeloom.llm.tokens import worker_encoder

LENGTH, END = 2048, 1
GRAIN = 16  # lengths are planned in classes of so many ids, 128 of them; a piece wastes 15 ids at most
RANKED = 250  # pieces of a class that one task ranks, about
GAP = 1e-3  # relative distance from the linear program's bound at which pricing ends


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes 1..len(value) that fits: its value and the count of each size."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    for w in range(1, capacity + 1):
        options = best[w - 1 :: -1][: len(value)] + value[: min(w, len(value))]
        k = int(np.argmax(options))
        best[w], take[w] = options[k], k + 1
        if best[w - 1] >= best[w]:
            best[w], take[w] = best[w - 1], 0
    counts, w = np.zeros(len(value), dtype=np.int64), capacity
    while w > 0:
        if take[w]:
            counts[take[w] - 1] += 1
            w -= take[w]
        else:
            w -= 1
    return float(best[capacity]), counts


def relaxed(demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 20000) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional multiplicities that cover ``demand`` of sizes 1..capacity with the fewest stocks."""
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    base = np.zeros((len(sizes), capacity), dtype=np.int64)
    base[np.arange(len(sizes)), sizes - 1] = capacity // sizes
    need = demand[sizes - 1].astype(float) * (1 + 1e-9 * np.arange(len(sizes)))  # apart, so that pivots never stall
    inverse = np.diag(1.0 / base[np.arange(len(sizes)), sizes - 1])
    x = need * inverse.diagonal()
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value = np.zeros(capacity)
        value[sizes - 1] = np.maximum(price, 0)
        best, pattern = knapsack(value, capacity)
        if best <= 1 + 1e-9 or x.sum() / best >= x.sum() * (1 - gap):
            break
        direction = (inverse * pattern[sizes - 1]).sum(axis=1)
        up = direction > 1e-9
        ratio = np.full(len(x), np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        base[out] = pattern
    return [(base[i], float(x[i])) for i in np.argsort(-x) if x[i] > 0]


def fullest(left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest size left and those that fill its stock best, larger first: a bounded subset sum by bit sets."""
    top = int(np.flatnonzero(left)[-1]) + 1
    room = capacity - top
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for size in range(min(top, room), 0, -1):
        have = int(left[size - 1]) - (size == top)
        for _ in range(min(have, room // size)):
            after = (reach | reach << size) & mask
            if after == reach:
                break
            steps.append((size, reach))
            reach = after
        if reach >> room & 1:
            break
    goal, pattern = reach.bit_length() - 1, np.zeros(len(left), dtype=np.int64)
    pattern[top - 1] = 1
    for size, before in reversed(steps):
        if not before >> goal & 1:
            pattern[size - 1] += 1
            goal -= size
    return pattern


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole multiplicities that use up ``demand`` exactly."""
    left, chosen = demand.astype(np.int64).copy(), []
    for pattern, times in relaxed(demand, capacity):
        used = pattern > 0
        whole = min(int(times + 1e-6), int((left[used] // pattern[used]).min()))
        if whole:
            chosen.append((pattern, whole))
            left -= pattern * whole
    while left.any():
        pattern = fullest(left, capacity)
        used = pattern > 0
        whole = int((left[used] // pattern[used]).min())
        chosen.append((pattern, whole))
        left -= pattern * whole
    return chosen


def layout(chosen: list[tuple[np.ndarray, int]], classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first ranks of its runs, pieces of it in a sequence of the run, first sequence of the run."""
    runs: dict[int, list[tuple[int, int, int]]] = {c: [] for c in range(1, classes + 1)}
    filled, sequence = np.zeros(classes, dtype=np.int64), 0
    for pattern, times in chosen:
        for c in np.flatnonzero(pattern).tolist():
            runs[c + 1].append((int(filled[c]), int(pattern[c]), sequence))
            filled[c] += int(pattern[c]) * times
        sequence += times
    return {c: tuple(np.array(v, dtype=np.int64) for v in zip(*r)) for c, r in runs.items() if r}


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Whole sequences and the remainder of each document, with the digest of their ids."""

    def rows(part: list) -> Iterator[tuple]:
        encoder = worker_encoder(vocabulary, lead=True)
        last = np.array([end], dtype="<u4").tobytes()
        for (doc_id, _), ids in zip(part, encoder.encode([t or "" for _, t in part])):
            ids += last
            n = len(ids) // 4
            for at in range(0, n, length):
                yield doc_id, at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", chunk=256)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Very long texts fill whole sequences and leave one remainder. Repeated rows
    are packed each for itself; a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, length).withColumn("size", F.ceil(F.col("length") / GRAIN).cast("int"))
    cut = step(cut, "pieces")
    counts = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # one row per class, LENGTH / GRAIN at most
    demand = np.zeros(length // GRAIN, dtype=np.int64)
    for size, n in counts.items():
        demand[size - 1] = n
    runs = spark.sparkContext.broadcast(layout(plan(demand, length // GRAIN), length // GRAIN))

    # rank within a class: pieces of a class are dealt to lots of about RANKED, lots are counted, and ranks run on
    lots = max(1, int(demand.max()) // RANKED) if len(demand) else 1
    dealt = cut.withColumn("lot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(lots)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("size", "lot").agg(F.count("*").alias("n")).select("size", "lot", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "lot").orderBy(F.desc("length"), "doc_id", "start"))
    ranked = dealt.withColumn("inside", inside).join(totals, ["size", "lot"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("inside") - 1).alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = runs.value
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(size), dtype=np.int64)
            for c in np.unique(size).tolist():
                at = size == c
                first, each, start = table_[c]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = start[run] + (rank[at] - first[run]) // each[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)], names=[*names, "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    seated = ranked.mapInArrow(seat, ", ".join(f"{n} long" for n in [*names, "sequence_id"]))
    seated = step(seated, "seats")  # ranks of equal rows are settled once
    place = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long"))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
