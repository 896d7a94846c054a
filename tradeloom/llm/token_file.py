"""Token ids in a word-aligned binary format: Simple-8b words in blocks with their own offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload, as many ids as the widest of them allows. Selector 0 is the
escape: the next word is one id of up to 64 bits as it is. Ids are coded in blocks of ``BLOCK``; each block starts at a word
whose offset stands in the segment's table, so a reader decodes any range of blocks alone, all its words at once.

A segment is a run of documents in id order:
  magic "TLS8", then unsigned 32-bit: version, documents, blocks, words; unsigned 64-bit: ids in all
  documents x signed 64-bit doc ids; documents x 1 byte, 1 where the id is null; padding to 8 bytes
  documents x unsigned 64-bit: ids before each document, within the segment
  blocks x unsigned 32-bit: words before each block; padding to 8 bytes
  words x unsigned 64-bit
All numbers are little-endian. Segments are the rows of Parquet files in a folder every executor reaches, ordered by
(part, segment), so files are written, committed and retried like any other table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import table
from tradeloom.llm.packing import vocabulary_path
from tradeloom.llm.tokens import worker_encoder
from tradeloom.session import scratch_path

END = 2
BLOCK = 4096  # ids of a block
MEMO = 1_200_000  # pieces a worker remembers, some 200 MB
SEGMENT = 1 << 19  # ids after which a segment is closed
# fixed values: ids in a word and bits of each, by selector from 1
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))

SPARSE = 16  # where fewer than one in so many ids fits a width, these alone are looked at

_HEAD = "<4sIIIIQ"


def _heads(place: np.ndarray, taken: np.ndarray, block: int) -> np.ndarray:
    """First ids of the words, followed from word to word in all blocks at once; behind each block lies a place that leads to itself."""
    blocks = -(-len(place) // block)
    home = place + place // block
    after = np.arange(blocks * (block + 1))
    after[home] = home + taken
    found, at = [], np.arange(blocks) * (block + 1)
    while True:
        found.append(at)
        then = after[at]
        if (then == at).all():
            break
        at = then
    heads = np.stack(found, axis=1).ravel()
    heads = heads[after[heads] != heads]
    return heads - heads // (block + 1)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, words before each block) of unsigned 64-bit ``ids``."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    narrow, ids = ids, ids.astype(np.uint64)  # compared as they are
    place = np.arange(n, dtype=np.int32)
    block_end = np.minimum((place // block + 1) * block, n).astype(np.int32)
    selector, taken = np.zeros(n, dtype=np.int8), np.ones(n, dtype=np.int32)
    undecided = np.ones(n, dtype=bool)
    for k, (count, bits) in enumerate(LAYOUT, 1):
        if bits >= 8 * narrow.itemsize:
            large, few = np.zeros(n, dtype=bool), n
        else:
            large = narrow >= narrow.dtype.type(1 << bits)
            few = n - np.count_nonzero(large)
        if not few:
            continue
        if few * SPARSE < n:
            small = np.flatnonzero(~large)
            stop = np.minimum(small + count, block_end[small])
            last = np.arange(len(small)) + (stop - small) - 1
            inside = last < len(small)
            starts = small[inside & (small[np.where(inside, last, 0)] == stop - 1) & undecided[small]]  # the ids up to ``stop`` are all small
        else:
            upto = np.zeros(n + count + 1, dtype=np.int32)
            np.cumsum(large, out=upto[1 : n + 1])
            upto[n + 1 :] = upto[n]
            fits = (upto[count : n + count] == upto[:n]) & undecided
            edge = np.flatnonzero(block_end - place < count)  # these words end with their block
            fits[edge] = (upto[block_end[edge]] == upto[edge]) & undecided[edge]
            starts = np.flatnonzero(fits)
        selector[starts], taken[starts] = k, np.minimum(starts + count, block_end[starts]) - starts
        undecided[starts] = False
        if few == n:
            break  # every id fits this width
    head = _heads(place, taken, block)
    kind, size = selector[head].astype(np.int64), taken[head]
    width = np.where(kind == 0, 2, 1)  # an escape takes a second word
    slot = np.cumsum(width) - width
    bits = np.array([0] + [b for _, b in LAYOUT], dtype=np.uint64)[kind]
    inside = (place - np.repeat(head, size)).astype(np.uint64)
    payload = np.bitwise_or.reduceat(ids << (inside * np.repeat(bits, size)), head)
    words = np.zeros(int(width.sum()), dtype="<u8")
    words[slot] = kind.astype(np.uint64) << np.uint64(60) | np.where(kind == 0, np.uint64(0), payload)
    words[slot[kind == 0] + 1] = payload[kind == 0]
    return words, slot[head % block == 0].astype("<u4")


def decode(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of whole blocks that begin at ``starts``."""
    ids = np.zeros(n, dtype=np.uint64)
    if not n:
        return ids
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (kind == 0).any():  # the word after an escape is an id, whatever its upper bits are
        at, count = 0, len(words)
        escapes = np.flatnonzero(kind == 0).tolist()
        for e in escapes:
            if e >= at and e + 1 < count:
                raw[e + 1] = True
                at = e + 2
    holds = np.array([1] + [c for c, _ in LAYOUT] + [0])[kind]
    holds[raw] = 0
    # the last word of a block may be part empty
    first_id = np.arange(len(starts)) * block
    block_of = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    place = np.cumsum(holds) - holds
    place = place - place[starts][block_of] + first_id[block_of]
    end = np.minimum(first_id + block, n)[block_of]
    for k, (count, bits) in enumerate(LAYOUT, 1):
        of = np.flatnonzero((kind == k) & ~raw)
        for j in range(count if len(of) else 0):
            of = of[place[of] + j < end[of]]
            ids[place[of] + j] = (words[of] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    of = np.flatnonzero((kind == 0) & ~raw)
    ids[place[of]] = words[of + 1]
    return ids


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment of documents whose ids are little-endian unsigned 32-bit bytes."""
    sizes = np.array([len(b) // 4 for b in ids], dtype=np.int64)
    words, starts = encode(np.frombuffer(b"".join(ids), dtype="<u4"))
    return b"".join((
        _pad(struct.pack(_HEAD, b"TLS8", 1, len(ids), len(starts), len(words), int(sizes.sum()))),
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
        _pad(bytes(i is None for i in doc_ids)),
        (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
        _pad(starts.tobytes()),
        words.tobytes(),
    ))


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids before each document and in all, ids as unsigned 32-bit)."""
    magic, version, docs, blocks, words, total = struct.unpack_from(_HEAD, data)
    if magic != b"TLS8" or version != 1:
        raise ValueError("not a token segment")
    at = len(_pad(b"\0" * struct.calcsize(_HEAD)))
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    at += 8 * docs + docs + -docs % 8
    before = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    starts = np.frombuffer(data, "<u4", blocks, at).astype(np.int64)
    at += 4 * blocks + -(4 * blocks) % 8
    ids = decode(np.frombuffer(data, "<u8", words, at), starts, total)
    return [None if z else i for i, z in zip(doc_ids.tolist(), null.tolist())], np.append(before, total), ids.astype("<u4")


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end: int = END, segment: int = SEGMENT) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end`` and write segments in ascending id order to ``path``.

    A null or empty text is its end id alone. Null ids come first, rows that share an id follow each other by text, and each
    counts. A text longer than a segment gets one of its own. Other columns are ignored; an empty table writes no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder, last = worker_encoder(vocabulary, lead=False, most=MEMO), np.array([end], dtype="<u4").tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([len(ids)]), pa.array([size]), pa.array([pack_segment(doc_ids, ids)])], names=["part", "segment", "docs", "ids", "data"])
            doc_ids.clear()
            ids.clear()
            number, size = number + 1, 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, found in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()])):
                    doc_ids.append(doc_id)
                    ids.append(found + last)
                    size += len(found) // 4 + 1
                    if size >= segment:
                        yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, "part long, segment long, docs long, ids long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "data"))):
                doc_ids, edge, ids = read_segment(data)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([segment] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(edge[:-1]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = segments.mapInArrow(run, "part long, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "segment", "ids")
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per written partition
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("part", "segment", (F.col("within") + F.col("earlier")).alias("base"))
    return rows.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), path)
    return read_tokens(spark, path)
