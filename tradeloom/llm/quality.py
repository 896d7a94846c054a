"""Quality grades by ordinal cumulative-link regression on hashed text.

A graded rating 0..K-1 is modelled with one weight vector for all grades and ordered thresholds: the probability of a grade
of at most k is the logistic function of threshold k minus the text's weighted sum. The sum gives the expected grade and
the probability of the upper grades, by which texts are selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import held_out, map_rows, table
from tradeloom.llm.rules import Measured

DIM = 2048  # buckets of byte trigrams, a power of two
SHAPE = 5  # features beside them
SAMPLE = 1500  # rated texts of each grade, about: ids below a hash threshold
GRADES = 16  # grades that may be learned
RIDGE, STEPS, RATE = 1e-3, 400, 0.05

_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def features(text: str | None) -> np.ndarray:
    """Unit vector of damped trigram counts, then shares of repeated words, repeated lines, capitals and symbols, and length."""
    m = Measured(text)
    raw = np.frombuffer(m.text.encode(), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIM + SHAPE, dtype=np.float32)
    if len(raw) > 2:
        mixed = raw[:-2] * _FACTOR[0] + raw[1:-1] * _FACTOR[1] + raw[2:] * _FACTOR[2]
        mixed ^= mixed >> np.uint32(15)
        counts = np.log1p(np.bincount(mixed & np.uint32(DIM - 1), minlength=DIM))
        out[:DIM] = counts / np.sqrt((counts * counts).sum())
    n = max(1, m.n_words)
    out[DIM:] = (m.n_repeat_words / n, min(1.0, 10 * m.n_dup_lines / n), m.n_upper / n, min(1.0, m.n_symbols / n), min(1.0, np.log1p(m.n_words) / 8))
    return out


def fit(x: np.ndarray, y: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``grades - 1`` ordered thresholds by full-batch descent; grades count by their share in ``y``.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(x)
    weight = np.zeros(x.shape[1])
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, STEPS + 1):
        gaps = np.exp(free[1:])
        bounds = np.concatenate(([-np.inf], free[0] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        z = x @ weight
        low, high = (1 / (1 + np.exp(np.clip(z - bounds[y + k], -40, 40))) for k in (0, 1))
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)  # of the logistic function at the two bounds; 0 at infinity
        d_low[y == 0], d_high[y == grades - 1] = 0, 0
        g_weight = x.T @ ((d_high - d_low) / p) / n + RIDGE * weight
        at = np.array([((d_low / p)[y == k + 1].sum() - (d_high / p)[y == k].sum()) / n for k in range(grades - 1)])
        tails = np.cumsum(at[::-1])[::-1]
        g_free = np.concatenate((tails[:1], tails[1:] * gaps))
        for k, (value, g) in enumerate(((weight, g_weight), (free, g_free))):
            a, b = moments[2 * k], moments[2 * k + 1]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            value -= 4 * RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return weight, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def upper_tails(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Probability of a grade above k, for each k, by row of weighted sums ``z``."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = SAMPLE) -> dict:
    """Model of the whole grades 0, 1, ... in ``labels`` from about ``sample`` rated texts of each, outside the held-out fold."""
    rated = labels.where(F.col(grade).between(0, GRADES - 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col(grade).cast("int").alias("grade"))
    sizes = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # GRADES rows at most
    if not sizes:
        return {"weight": None, "thresholds": np.zeros(0), "grades": 0}
    share = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, min(1.0, sample / n))])[F.col("grade")]
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about GRADES * sample rows of two numbers

    def rows(part: list) -> Iterator[tuple]:
        for g, text in part:
            yield g, features(text).astype("<f4").tobytes()

    seen = map_rows(texts.select("grade", "text"), rows, "grade int, x binary").collect()
    seen.sort(key=lambda r: (r["grade"], bytes(r["x"])))
    grades = max(sizes) + 1
    y = np.array([r["grade"] for r in seen], dtype=int)
    if grades < 2 or len(set(y.tolist())) < 2:
        return {"weight": None, "thresholds": np.zeros(0), "grades": grades}
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in seen])
    weight, thresholds = fit(x, y, grades)
    return {"weight": weight, "thresholds": thresholds, "grades": grades}


def grade(docs: DataFrame, model: dict, upper: int = 1) -> DataFrame:
    """Return per row doc_id, expected_grade, tail (probability of a grade of at least ``upper``), kept (tail of 0.5 or more).

    Null and empty texts are graded by their lack of features. A model of fewer than two grades gives each text that one
    grade and keeps it. Texts are read whole; repeated rows are alike; null ids stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one vector

    def rows(part: list) -> Iterator[tuple]:
        m = sent.value
        if m["weight"] is None:
            only = float(max(0, m["grades"] - 1))
            return [(i, only, 1.0, True) for i, _ in part]
        z = np.array([features(t) @ m["weight"] for _, t in part])
        tails = upper_tails(z, m["thresholds"])
        tail = tails[:, upper - 1] if 0 < upper <= tails.shape[1] else np.full(len(z), float(upper <= 0))
        return list(zip([i for i, _ in part], tails.sum(axis=1).tolist(), tail.tolist(), (tail >= 0.5).tolist()))

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, expected_grade double, tail double, kept boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = grade(docs, learn(docs, table(spark, sf_dir, "labels")))
    return graded.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "expected_grade", "tail", "kept")
