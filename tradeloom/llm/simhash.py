"""SimHash near-duplicates: 64-bit fingerprints joined through a hierarchical index in Gray order.

A join for all pairs within ``MOST`` differing bits must find every link, so fingerprints are routed by blocks of bits:
of six blocks at least two are untouched by four differences, hence each of the 15 pairs of blocks is one route. Inside a
route the fingerprints are sorted by Gray rank, runs of them become nodes that hold the bits all members share, runs of
nodes become higher nodes, and two subtrees are compared top-down; the differences between their shared bits are a lower
bound that discards both groups at once. A route with more than ``PAGE`` members is cut into pages, and every pair of its
pages is one unit of work, so no task holds more than two pages whatever the size of the route. A unit returns a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import keep_smallest, map_rows, sorted_groups, step, table, text_hash
from tradeloom.llm.graph import components

SHINGLE, MOST, SEED = 4, 4, 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # (first bit, bits)
PAGE = 4096  # fingerprints of a route that one unit of work holds, twice at most
FAN = 8  # children of a node
PAIRS = 1 << 20  # node pairs expanded at once


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hash of every shingle of words, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed long; none gives 0."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes, as a signed long; no words gives 0."""
    return majority(shingle_hashes(text, shingle, seed))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: prefix exclusive-or of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over codes sorted by (group, Gray rank): per level the bits set in all, and in any, of a node's codes."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fan: int = FAN):
        self.order = np.lexsort((gray_rank(codes), group))
        every = any_ = codes[self.order]
        group = group[self.order]
        self.levels, self.children = [(every, any_)], []
        while True:
            new = np.concatenate(([True], group[1:] != group[:-1]))
            first = np.flatnonzero(new)
            if len(first) == len(group):
                break
            inside = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(inside % fan == 0)
            every, any_ = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(any_, starts)
            group = group[starts]
            self.levels.append((every, any_))
            self.children.append((starts, np.diff(np.append(starts, len(inside)))))

    def links(self, most: int = MOST, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of different codes of one group with at most ``most`` differing bits."""
        roots = np.arange(len(self.levels[-1][0]))
        work = [(len(self.levels) - 1, roots, roots)]
        while work:
            level, left, right = work.pop()
            if level == 0:
                keep = left < right
                if keep.any():
                    yield self.order[left[keep]], self.order[right[keep]]
                continue
            if len(left) * FAN * FAN > pairs and len(left) > 1:
                half = len(left) // 2
                work += [(level, left[:half], right[:half]), (level, left[half:], right[half:])]
                continue
            start, size = self.children[level - 1]
            each = size[left] * size[right]
            owner = np.repeat(np.arange(len(left)), each)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            wide = size[right][owner]
            a, b = start[left][owner] + inside // wide, start[right][owner] + inside % wide
            every, any_ = self.levels[level - 1]
            apart = np.bitwise_count((every[a] & ~any_[b]) | (every[b] & ~any_[a]))
            keep = (apart <= most) & (a <= b)
            if keep.any():
                work.append((level - 1, a[keep], b[keep]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices; links are consumed batch by batch."""
    root = np.arange(n)
    for left, right in links:
        while True:
            a, b = root[left], root[right]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if not (apart := low != high).any():
                break
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sorted_groups(batches, ["route", "p", "q"]):
        new = np.ones(len(part["fp"]), dtype=bool)
        new[1:] = (part["route"][1:] != part["route"][:-1]) | (part["p"][1:] != part["p"][:-1]) | (part["q"][1:] != part["q"][:-1])
        codes = part["fp"].astype(np.int64).view(np.uint64)
        root = forest(len(codes), GrayIndex(np.cumsum(new), codes).links())
        child = np.flatnonzero(root != np.arange(len(root)))
        if len(child):
            codes = codes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[child]), pa.array(codes[root[child]])], names=["u", "v"])


def links(codes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct long ``fp`` of ``codes`` exactly as all pairs within ``MOST`` bits do."""
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in BLOCKS]
    routes = [F.lit(k << 22).cast("long") + F.shiftleft(block[a], 11) + block[b] for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    routed = codes.select("fp", F.explode(F.array(*routes)).alias("route"))
    large = routed.groupBy("route").count().where(F.col("count") > PAGE).select("route", F.ceil(F.col("count") / PAGE).cast("int").alias("pages"))
    paged = routed.join(large, "route", "left").withColumn("page", F.when(F.col("pages").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("pages"))).cast("int"))
    # page x meets every other page y in the unit (min, max); a single page meets itself
    partner = F.when(F.col("pages").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("pages") - 1), lambda y: y != F.col("page")))
    units = paged.select("route", "fp", "page", F.explode(partner).alias("y")).select("route", F.least("page", "y").alias("p"), F.greatest("page", "y").alias("q"), "fp")
    units = units.repartition("route", "p", "q").sortWithinPartitions("route", "p", "q")
    return units.mapInArrow(_unit_links, "u long, v long")


def near_duplicates(docs: DataFrame, *key: Column) -> DataFrame:
    """Return one row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, fp_rows.

    With ``key``, a long named text_key, also text_key and root, the fingerprint that stands for the component.

    Texts without words (null, empty, blanks) have fingerprint zero and link like any other. A null id takes part but
    never names a component unless no member has an id, and then the component is null. Repeated rows are one
    fingerprint; other columns are ignored; an empty table gives no rows.
    """
    extra = ["text_key"] if key else []
    prints = map_rows(docs.select("doc_id", F.col("text").cast("binary"), *key), lambda rows: [(i, fingerprint(t), *k) for i, t, *k in rows], "doc_id long, fp long" + ", text_key long" * len(key))
    prints = step(prints, "fingerprints")
    codes = step(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("fp_rows")), "codes")
    roots = components(links(codes.select("fp")))
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "first_id", "fp_rows", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id", "fp_rows", *(["root"] if key else []))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_rows", *extra, *(["root"] if key else []))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each component: the smallest id, then the smallest text hash; rows alike in both once."""
    return keep_smallest(docs, near_duplicates(docs, text_hash(F.col("text")).alias("text_key")))
