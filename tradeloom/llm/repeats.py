"""Substring deduplication: windows of words that occur anywhere else, found through super-k-mers.

1. Every document lists the minimisers of its windows (the smallest hash of ``M`` consecutive words) with the places they
   stand at. A window can only repeat if its minimiser stands at two places, so minimisers are counted over the corpus
   first, pre-aggregated by document, and the rest of the text travels no further.
2. Documents with such a minimiser are cut into super-k-mers: runs of consecutive windows with one minimiser travel as one
   packed string of words to the minimiser's bucket. Equal strings are one row with a count before they leave their task.
3. In a bucket the windows of its strings are sorted by their words and counted exactly. A minimiser of more than
   ``BUCKET`` places (the edges of a passage found everywhere) is not gathered: its windows are rows of an ordinary
   aggregation with partial sums.
4. The repeated windows of each string go back to the documents that hold it, and covered words are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import finish, free_names, map_rows, same_row, sorted_groups, step, table, text_hash

WINDOW = 35  # consecutive words judged together
M = 6  # words hashed to one minimiser candidate
BUCKET = 2048  # places of a minimiser, and so distinct strings, that one task sorts
SALTS = 32  # parts that the strings of a common window are dealt to

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    letters = np.concatenate(([False], ~_SPACE[np.frombuffer(text, dtype=np.uint8)], [False]))
    edge = np.flatnonzero(letters[1:] != letters[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash per word; equal words have equal hashes. It only chooses minimisers, equality is judged on the words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    size = end - start
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    powers = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
    value = (raw[np.repeat(start, size) + inside].astype(np.uint64) + np.uint64(1)) * powers[inside]
    hashed = np.add.reduceat(value, np.cumsum(size) - size)
    hashed ^= hashed >> np.uint64(31)
    return hashed * _MIX[0]


def minimisers(hashes: np.ndarray, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """For each window, its minimiser's hash and the place of its first occurrence in the window."""
    n = len(hashes) - m + 1
    value = np.zeros(n, dtype=np.uint64)
    for k in range(m):
        value = value * _MIX[0] + hashes[k : k + n]
    value ^= value >> np.uint64(29)
    value *= _MIX[1]
    value ^= value >> np.uint64(32)
    place, reach, width = np.arange(n), 1, window - m + 1
    while reach < width:
        by = min(reach, width - reach)  # two stretches of ``reach`` candidates, overlapping at the last step
        later = value[by:] < value[:-by]
        value = np.where(later, value[by:], value[:-by])
        place = np.where(later, place[by:], place[:-by])
        reach += by
    return value, place


def _scan(rows: list) -> Iterator[tuple]:
    for doc_id, key, text in rows:
        words = (text or b"").split()
        found: list[tuple[int, int]] = []
        if len(words) >= WINDOW:
            start, end = spans(text)
            value, place = minimisers(word_hashes(text, start, end))
            first = np.concatenate(([True], place[1:] != place[:-1]))
            kinds, times = np.unique(value[first], return_counts=True)
            found = list(zip(kinds.view(np.int64).tolist(), times.tolist()))
        yield doc_id, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), found


def _cut_strings(rows: list) -> Iterator[tuple]:
    """Super-k-mers of the minimisers in ``wanted``: (row key, first window, minimiser, wide, packed words and their mark).

    The mark, a 128-bit digest, names the string on the way back to its documents; windows are compared by their words.
    """
    for doc_id, key, text, wanted in rows:
        start, end = spans(text)
        value, _ = minimisers(word_hashes(text, start, end))
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        last = np.append(first[1:], len(value)) - 1
        wide = {w["minimiser"]: w["wide"] for w in wanted}
        use = np.isin(value[first].view(np.int64), np.array(list(wide), dtype=np.int64))
        words = text.split()
        for a, b, v in zip(first[use].tolist(), last[use].tolist(), value[first[use]].view(np.int64).tolist()):
            packed = b" ".join(words[a : b + WINDOW])
            yield doc_id, key, a, v, wide[v], packed, xxhash.xxh3_128_digest(packed)


def repeated_windows(strings: list[bytes], times: list[int], window: int = WINDOW) -> list[list[int]]:
    """For each distinct packed string, which of its windows occur twice or more, a string counting ``times`` over."""
    found: list[list[int]] = [[] for _ in strings]
    cuts: list[tuple[bytes, int, int]] = []
    for k, packed in enumerate(strings):
        ends = [m for m, b in enumerate(packed) if b == 0x20]
        ends.append(len(packed))
        n = len(ends) - window + 1
        if times[k] > 1:
            found[k] = list(range(n))
        if len(strings) > 1 or n > 1:
            start = 0
            for i in range(n):
                cuts.append((packed[start : ends[i + window - 1]], k, i))
                start = ends[i] + 1
    cuts.sort()
    marked: set[tuple[int, int]] = set()
    for (a, k, i), (b, other, j) in zip(cuts, cuts[1:]):
        if a == b:
            marked.add((k, i))
            marked.add((other, j))
    for k, i in sorted(marked):
        if times[k] == 1:
            found[k].append(i)
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sorted_groups(batches, ["minimiser"]):
        cut = np.flatnonzero(np.concatenate(([True], part["minimiser"][1:] != part["minimiser"][:-1], [True])))
        key, mark, at = [], [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for k, found in enumerate(repeated_windows(part["packed"][a:b].tolist(), part["times"][a:b].tolist()), a):
                if found:
                    key.append(part["minimiser"][k])
                    mark.append(part["mark"][k])
                    at.append(found)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(mark, pa.binary()), pa.array(at, pa.list_(pa.int32()))], names=["minimiser", "mark", "at"])


def _wide_buckets(strings: DataFrame) -> DataFrame:
    """The same as ``_buckets`` for minimisers of too many strings: windows as rows, summed before and after the shuffle."""
    words = strings.select("minimiser", "mark", "times", F.split(F.col("packed").cast("string"), " ").alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - WINDOW)).alias("at")
    windows = words.select("minimiser", "mark", "times", "w", at).select("minimiser", "mark", "times", "at", F.array_join(F.slice("w", F.col("at") + 1, WINDOW), " ").alias("window"))
    often = windows.groupBy("window").agg(F.sum("times").alias("total")).where("total > 1").select("window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int"))  # one window may stand in most strings
    return salted.join(often, ["window", "salt"], "left_semi").groupBy("minimiser", "mark").agg(F.collect_list("at").alias("at"))


def covered(n: int, windows: list[int], window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words lie in one of the windows."""
    step = np.zeros(n + 1, dtype=np.int64)
    first = np.unique(np.array(windows, dtype=np.int64))
    step[first] += 1
    np.add.at(step, first + window, -1)
    return np.cumsum(step[:-1]) > 0


def _cut_text(rows: list, texts: bool) -> Iterator[tuple]:
    for doc_id, key, text, windows in rows:
        start, end = spans(text)
        gone = covered(len(start), windows)
        words = np.array(text.split(), dtype=object)
        digest = hashlib.sha256(b" ".join(words[~gone].tolist())).hexdigest()
        if not texts:
            yield doc_id, key, int(gone.sum()), digest, None
            continue
        # a run of removed words goes with the white space after it
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        keep, at = [], 0
        after = np.append(start[1:], len(text))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            keep.append(text[at : start[a]])
            at = int(after[b - 1])
        yield doc_id, key, int(gone.sum()), digest, b"".join(keep) + text[at:]


def repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Return per row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_removed, kept_sha256, kept_text.

    ``kept_text`` is null where nothing is removed, and everywhere without ``texts``. Null or empty texts and texts under ``WINDOW`` words have no window and
    stay. A row repeated with its id is another occurrence of its windows, so both lose them. Null ids and very long texts
    are treated as any other; other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    scan = step(map_rows(keyed, _scan, "doc_id long, text_key long, n_words long, kept_sha256 string, minimisers array<struct<minimiser: long, times: int>>"), "minimisers")
    each = scan.select("doc_id", "text_key", F.inline("minimisers"))
    twice = each.groupBy("minimiser").agg(F.sum("times").alias("places")).where("places > 1").select("minimiser", (F.col("places") > BUCKET).alias("wide"))
    wanted = each.join(twice, "minimiser").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("minimiser", "wide")).alias("wanted"))
    chosen = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "wanted")
    held = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "wanted")
    pieces = step(map_rows(held, _cut_strings, "doc_id long, text_key long, first int, minimiser long, wide boolean, packed binary, mark binary"), "super-k-mers")

    strings = step(pieces.groupBy("minimiser", "wide", "packed", "mark").agg(F.count("*").alias("times")), "strings")
    narrow = strings.where("not wide").select("minimiser", "packed", "mark", "times").repartition("minimiser").sortWithinPartitions("minimiser")
    found = narrow.mapInArrow(_buckets, "minimiser long, mark binary, at array<int>").unionByName(_wide_buckets(strings.where("wide")))
    found = step(found, "repeated-windows")
    cut = pieces.select("doc_id", "text_key", "first", "minimiser", "mark").join(found, ["minimiser", "mark"])
    cut = cut.select("doc_id", "text_key", F.transform("at", lambda x: x + F.col("first")).alias("at"))
    per_row = step(cut.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("at")).alias("windows")), "windows")
    per_row = per_row.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "windows")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    changed = map_rows(
        keyed.join(per_row, same).select("doc_id", "text_key", "text", "windows"),
        partial(_cut_text, texts=texts),
        "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text binary",
    )
    changed = step(changed, "cut-texts").dropDuplicates(["doc_id", "text_key"])
    changed = changed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_removed", F.col("kept_sha256").alias("cut_sha256"), F.col("kept_text").cast("string").alias("kept_text"))
    return scan.join(changed, same, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), "kept_text"
    )


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row_no, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
k AS (SELECT row_no, p, array_to_string(w[p:p + 34], ' ') AS key FROM s),
t AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
h AS (SELECT DISTINCT row_no, unnest(range(p, p + 35)) AS i FROM k JOIN t USING (key)),
g AS (SELECT row_no, list(i) AS gone FROM h GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN gone IS NOT NULL AND list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (row_no)
"""


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated windows cut from their texts, and n_chars following where there is such a column.

    Every row stays, with all its columns, whatever their names. Null and empty texts and texts without a repeated window are
    unchanged; rows repeated with their id repeat each other's windows and lose them; an empty table stays empty.
    """
    doc_id, key, kept = free_names(docs, "_id", "_key", "_kept")
    rows = finish(lambda: repeats(docs).where("n_removed > 0").select("doc_id", "text_key", "kept_text").dropDuplicates(["doc_id", "text_key"]), "changed-texts")
    rows = rows.select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key), F.col("kept_text").alias(kept))
    joined = docs.join(rows, same_row(docs, doc_id, key), "left")
    changed = {"text": F.coalesce(kept, docs["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(key).isNull(), docs["n_chars"]).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
