"""Language identification by the nearest of several centroids per language.

A text is its letter trigrams, hashed into ``DIM`` buckets, counted, damped, weighed by inverse document frequency and
normalised. The vectors of a bounded labelled sample are clustered within each language (spherical k-means), as a language
is written in several manners; a text gets the language of the centroid with the highest cosine and is rejected where even
that one is further away than nearly all of the language's own sample was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import held_out, map_rows, table

DIM = 4096  # a power of two
SAMPLE = 400  # labelled texts of each language, about: ids below a hash threshold
CENTROIDS, ROUNDS = 4, 15
OUTER = 0.005  # share of a language's own sample that its rejection distance leaves out
LANGUAGES = 1000  # languages that may be learned

_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def trigrams(text: str) -> np.ndarray | None:
    """Counts of the hashed byte trigrams of the letters, words set apart by one blank; None without letters."""
    text = text.lower()
    if not text.isascii():
        text = "".join([c if c.isalpha() else " " for c in text])
        raw = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
    else:
        raw = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
        raw = np.where((raw >= 97) & (raw <= 122), raw, np.uint8(32))
    blank = raw == 32
    raw = raw[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    if len(raw) < 3:
        return None
    mixed = raw[:-2] * _FACTOR[0] + raw[1:-1] * _FACTOR[1] + raw[2:] * _FACTOR[2]
    mixed ^= mixed >> np.uint32(15)
    return np.bincount(mixed & np.uint32(DIM - 1), minlength=DIM)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; the first is the mean, each further one starts at the vector furthest from all."""
    mean = vectors.mean(axis=0)
    found = [mean / (np.linalg.norm(mean) or 1)]
    while len(found) < min(k, len(vectors)):
        found.append(vectors[int(np.argmin(np.max(vectors @ np.array(found).T, axis=1)))])
    centroids = np.array(found)
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        moved = np.array([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Centroids, document frequencies and rejection cosines from about ``sample`` labelled texts of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & ~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    shares = {r["lang"]: min(1.0, sample / r["count"]) for r in sizes}
    if not shares:
        return {"languages": [], "idf": np.ones(DIM), "centroids": np.zeros((0, DIM)), "owner": np.zeros(0, dtype=int), "least": np.zeros(0)}
    limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit * (1 << 20))

    def rows(part: list) -> Iterator[tuple]:
        for lang, text in part:
            counts = trigrams(text or "")
            if counts is not None:
                yield lang, np.minimum(counts, 65535).astype("<u2").tobytes()

    seen = map_rows(chosen.select("lang", "text"), rows, "lang string, counts binary").collect()  # about ``sample`` rows of 8 KB a language
    seen.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    counts = np.array([np.frombuffer(r["counts"], dtype="<u2") for r in seen], dtype=np.float32).reshape(-1, DIM)
    names = np.array([r["lang"] for r in seen])
    languages = sorted(set(names.tolist()))
    per_language = {g: names == g for g in languages}
    # frequency with every language counting alike, so that the largest does not set the weights
    share = np.mean([(counts[m] > 0).mean(axis=0) for m in per_language.values()], axis=0) if languages else np.ones(DIM)
    idf = np.log((1 + 1e-3) / (share + 1e-3)) + 0.1
    centroids, owner, least = [], [], []
    for k, g in enumerate(languages):
        vectors = np.array([vector(c, idf) for c in counts[per_language[g]]])
        own = cluster(vectors)
        centroids.append(own)
        owner += [k] * len(own)
        least.append(float(np.quantile((vectors @ own.T).max(axis=1), OUTER)))
    return {"languages": languages, "idf": idf, "centroids": np.concatenate(centroids) if centroids else np.zeros((0, DIM)), "owner": np.array(owner, dtype=int), "least": np.array(least)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Return per row doc_id, lang_pred, score (cosine to the nearest centroid), rejected.

    A null text, or one without letters, is ``und`` with score 0 and rejected; so is every text if nothing was learned.
    Letters outside the sample's scripts still get the nearest language, and are rejected. Ties go to the language first
    in order. Texts are read whole; repeated rows are alike; null ids stay; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # LANGUAGES * CENTROIDS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names, idf, owner, least = m["languages"], m["idf"].astype(np.float32), m["owner"], m["least"]
        centroids = m["centroids"].astype(np.float32).T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: list[tuple] = []
                for text in some.column(1).to_pylist():
                    counts = trigrams(text) if text and names else None
                    if counts is None or not any(map(str.isalpha, text)):
                        out.append(("und", 0.0, True))
                        continue
                    near = vector(counts, idf) @ centroids
                    best = int(np.argmax(near))
                    cosine = float(min(1.0, max(0.0, near[best])))
                    out.append((names[owner[best]], cosine, cosine < least[owner[best]]))
                if out:
                    lang, score, rejected = zip(*out)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array([bool(r) for r in rejected])], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
