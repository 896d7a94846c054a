"""Spelling variants over a frequency-vector trie.

A word is a vector of counts of ``LETTER_GROUPS`` letter groups; the trie branches on one count a level, the groups of
largest variance first. One edit changes the vector by at most one surplus and one deficit, so a search walks down the
trie with a budget of one each and compares words only at the leaves it reaches.

The upper levels of the trie are the partitioning: their depth is the smallest at which no node holds more than ``NODE``
words. A word goes to its own node and, as a probe, to the nodes its budget reaches; of two nodes that differ only one
sends probes to the other, so that every pair meets once. The lower levels are built and searched in the tasks. A node
that is larger at full depth has its words dealt to pages and its probes sent to each of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import step, table

LETTERS, TIMES = 6, 5  # a word's least code points and occurrences
DROP = 199  # a run loses a letter where this divides its checksum
FACTOR = 5  # a form stands at least so many times as often
LETTER_GROUPS = 16  # code points by their remainder
NODE = 8192  # words of an upper node, and of a page
WIDE = 64  # longer words are compared one by one
STATES, PAIRS = 1 << 18, 1 << 18  # rows a search handles at a time
HELD = 500_000  # counts a task keeps before it passes them on

# code points to U+00FF: A-Z become a-z, other letters stay, the rest ends a run
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
                size = len(run)
                if size < LETTERS:
                    continue
                h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % DROP == 0:
                    run = run[: h % size] + run[h % size + 1 :]
                    if size == LETTERS:
                        continue
                found[run] += n
            if len(found) > HELD:
                yield rows()
    if found:
        yield rows()


def words_of(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def vectors(words: list[bytes], levels: list[int] | None = None) -> np.ndarray:
    """Counts per letter group, a row for each word, in the order of ``levels``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), dtype=np.uint8) % LETTER_GROUPS
    counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * LETTER_GROUPS + letters, minlength=len(words) * LETTER_GROUPS)
    counts = counts.reshape(len(words), LETTER_GROUPS).astype(np.int32)
    return counts if levels is None else counts[:, levels]


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, square, n = np.zeros(LETTER_GROUPS), np.zeros(LETTER_GROUPS), 0
    for batch in batches:
        if batch.num_rows:
            counts = vectors(_latin(batch.column(0))).astype(float)
            total, square, n = total + counts.sum(axis=0), square + (counts**2).sum(axis=0), n + batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(LETTER_GROUPS), pa.int32()), pa.array(total), pa.array(square), pa.array([n] * LETTER_GROUPS, pa.int64())], names=["g", "total", "square", "n"])


def _keys(counts: np.ndarray) -> pa.Array:
    """A row of counts as bytes."""
    flat = np.ascontiguousarray(counts, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(4 * flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _prefixes(batches: Iterator[pa.RecordBatch], levels: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            counts = vectors(_latin(batch.column(0)), levels)
            for depth in range(1, LETTER_GROUPS + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), depth, np.int32)), _keys(counts[:, :depth])], names=["depth", "key"])


def _deltas(depth: int) -> list[tuple[int, int]]:
    """Changes of an upper vector that a probe makes: one more at i, one less at j > i; -1 for neither."""
    return [(-1, -1), *((i, -1) for i in range(depth)), *((i, j) for i in range(depth) for j in range(i + 1, depth))]


def _routes(batches: Iterator[pa.RecordBatch], levels: list[int], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, role, word, n): role 0 is the word in its node, 1 a probe there, 2 one with a surplus, 3 also a deficit spent."""
    for batch in batches:
        if not batch.num_rows:
            continue
        word, n = batch.column("word"), batch.column("n")
        upper = vectors(_latin(word), levels)[:, :depth]
        for role, (i, j) in [(0, (-1, -1)), *((1 + (d[0] >= 0) + (d[1] >= 0), d) for d in _deltas(depth))]:
            counts, use = upper.copy(), np.ones(len(upper), dtype=bool)
            if i >= 0:
                counts[:, i] += 1
            if j >= 0:
                counts[:, j] -= 1
                use = counts[:, j] >= 0
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays([_keys(counts[use]), pa.array(np.full(int(use.sum()), role, np.int32)), word.filter(keep), n.filter(keep)], names=["key", "role", "word", "n"])


class Trie:
    """Nodes of the lower levels; a child is found by its parent's number and its count."""

    def __init__(self, node: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((*counts.T[::-1], node))
        node, counts = node[self.order], counts[self.order]
        self.width = int(counts.max(initial=0)) + 1
        self.children = []
        for level in counts.T:
            key = node * self.width + level
            new = np.concatenate(([True], key[1:] != key[:-1]))
            self.children.append(key[new])
            node = np.cumsum(new) - 1
        self.start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        self.end = np.append(self.start[1:], len(node))

    def step(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.children[level]
        want = node * self.width + count
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return at, (keys[at] == want) & (count >= 0) & (count < self.width)

    def search(self, node: np.ndarray, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe, leaf) arrays; depth first, a stack entry holds the probes that go on together."""
        stack = [(0, np.arange(len(node)), node, surplus, deficit)]
        while stack:
            level, who, node, more, less = stack.pop()
            if len(who) > STATES:
                half = len(who) // 2
                stack += [(level, who[half:], node[half:], more[half:], less[half:]), (level, who[:half], node[:half], more[:half], less[:half])]
                continue
            if level == len(self.children):
                yield who, node
                continue
            count, nexts = counts[who, level], []
            for by in (0, 1, -1):
                use = np.flatnonzero(more) if by > 0 else np.flatnonzero(less) if by else np.arange(len(who))
                at, there = self.step(level, node[use], count[use] + by)
                use, at = use[there], at[there]
                nexts.append((who[use], at, more[use] & (by <= 0), less[use] & (by >= 0)))
            who, node, more, less = (np.concatenate(c) for c in zip(*nexts))
            if len(who):
                stack.append((level + 1, who, node, more, less))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def _objects(values: list[bytes]) -> np.ndarray:
    """An array of the objects themselves, which keep their length."""
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.array([w if len(w) <= WIDE else b"" for w in words], dtype=f"S{WIDE + 1}").view(np.uint8).reshape(len(words), WIDE + 1)


def verified(words: list[bytes], letters: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of word numbers are one edit apart."""
    good = np.zeros(len(a), dtype=bool)
    gap = size[a] - size[b]
    short = (size[a] <= WIDE) & (size[b] <= WIDE)
    same = np.flatnonzero(short & (gap == 0))
    good[same] = (letters[a[same]] != letters[b[same]]).sum(axis=1) == 1
    other = np.flatnonzero(short & (np.abs(gap) == 1))
    longer, less = np.where(gap[other] > 0, a[other], b[other]), np.where(gap[other] > 0, b[other], a[other])
    x, y = letters[longer], letters[less]
    first = np.argmin(x == y, axis=1)
    tail = np.concatenate((x[:, 1:], np.zeros((len(x), 1), np.uint8)), axis=1) == y
    good[other] = (tail | (np.arange(WIDE + 1) < first[:, None])).all(axis=1)
    for k in np.flatnonzero(~short & (np.abs(gap) <= 1)).tolist():
        good[k] = one_edit(words[a[k]], words[b[k]])
    return good


def _best(who: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct ``who`` its number of pairs and the other word of largest n, then smallest."""
    order = np.lexsort((rank[other], -n[other], who))
    who, other = who[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    return who[first], np.diff(np.append(first, len(who))), other[first]


def _pairs(key: np.ndarray, role: np.ndarray, words: list[bytes], levels: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (probe, stored word) by row numbers, of the probes among these rows."""
    node = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))  # rows come sorted by key
    lower = vectors(words, levels)[:, depth:].astype(np.int64)
    stored, probe = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
    if not len(stored) or not len(probe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    trie = Trie(node[stored], lower[stored])
    stored = stored[trie.order]
    names = np.unique(node[stored])
    at = np.searchsorted(names, node[probe])
    at[at == len(names)] = 0
    probe = probe[names[at] == node[probe]]
    if depth < LETTER_GROUPS:
        search = trie.search(node[probe], lower[probe], role[probe] < 2, role[probe] < 3)
    else:
        search = iter([(np.arange(len(probe)), np.searchsorted(names, node[probe]))])
    letters, size = _matrix(words), np.fromiter(map(len, words), np.int64, len(words))
    left, right = [], []
    for who, leaf in search:
        many = trie.end[leaf] - trie.start[leaf]
        cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS), side="left") + 1
        for a, b in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist()):
            m = many[a:b]
            p = np.repeat(probe[who[a:b]], m)
            s = stored[np.repeat(trie.start[leaf[a:b]], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
            good = verified(words, letters, size, p, s)
            p, s = p[good], s[good]
            once = np.array([role[x] > 1 or words[x] < words[y] for x, y in zip(p.tolist(), s.tolist())], dtype=bool)
            left.append(p[once])
            right.append(s[once])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _meet(batches: Iterator[pa.RecordBatch], levels: list[int], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, near, top_n, top) from rows sorted by (key, page, role); keeps the words of one page between batches."""
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _objects([k + p.to_bytes(8, "big") for k, p in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist())])
        role, n, words = batch.column("role").to_numpy(), batch.column("n").to_numpy(), _latin(batch.column("word"))
        if held is not None:
            key, role, n, words = np.concatenate((held[0], key)), np.concatenate((held[1], role)), np.concatenate((held[2], n)), held[3] + words
        p, s = _pairs(key, role, words, levels, depth)
        if len(p):
            ids = np.unique(np.concatenate((p, s)))
            order = np.argsort(_objects([words[k] for k in ids.tolist()]), kind="stable")
            rank = np.zeros(len(words), np.int64)
            rank[ids[order]] = np.arange(len(ids))
            who, near, top = (np.concatenate(c) for c in zip(_best(p, s, n, rank), _best(s, p, n, rank)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k].decode("latin-1") for k in who.tolist()], pa.string()), pa.array(near, pa.int64()), pa.array(n[top], pa.int64()), pa.array([words[k].decode("latin-1") for k in top.tolist()], pa.string())],
                names=["word", "near", "top_n", "top"],
            )
        same = np.fromiter((k == key[-1] for k in key), bool, len(key))  # numpy would strip a lone key's zero bytes
        last = np.flatnonzero((role == 0) & same)
        held = (key[last], role[last], n[last], [words[k] for k in last.tolist()])


def near_words(words: DataFrame, node: int = NODE) -> DataFrame:
    """Per word of ``words`` (word, n; distinct) with a near word: (word, n_near, top_n, top), the near word of largest n."""
    moments = words.select("word").mapInArrow(_moments, "g int, total double, square double, n long").groupBy("g").agg(F.sum("total"), F.sum("square"), F.sum("n")).collect()
    spread = {g: (square - total * total / max(1, n)) for g, total, square, n in moments}
    levels = sorted(range(LETTER_GROUPS), key=lambda g: (-spread.get(g, 0.0), g))
    sizes = words.select("word").mapInArrow(partial(_prefixes, levels=levels), "depth int, key binary").groupBy("depth", "key").agg(F.count("*").alias("size"))
    largest = {r.depth: r.most for r in sizes.groupBy("depth").agg(F.max("size").alias("most")).collect()}
    depth = next((d for d in range(1, LETTER_GROUPS + 1) if largest.get(d, 0) <= node), LETTER_GROUPS)
    routes = words.mapInArrow(partial(_routes, levels=levels, depth=depth), "key binary, role int, word string, n long")
    if largest.get(depth, 0) <= node:
        paged = routes.withColumn("page", F.lit(0))
    else:
        crowded = words.mapInArrow(partial(_routes, levels=levels, depth=depth), "key binary, role int, word string, n long").where("role = 0").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > node)
        pages = crowded.select("key", F.ceil(F.col("size") / node).cast("int").alias("pages"))
        dealt = routes.join(pages, "key", "left").na.fill(1, ["pages"])
        own = F.array(F.pmod(F.xxhash64("word"), "pages").cast("int"))
        paged = dealt.withColumn("page", F.explode(F.when(F.col("role") == 0, own).otherwise(F.sequence(F.lit(0), F.col("pages") - 1)))).drop("pages")
    met = paged.repartition("key", "page").sortWithinPartitions("key", "page", "role").select("key", "page", "role", "word", "n")
    found = met.mapInArrow(partial(_meet, levels=levels, depth=depth), "word string, near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), "top")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("top_n"), F.col("best.top").alias("top"))


def roots(forms: DataFrame, highest: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form) by pointer doubling; a form stands ``FACTOR`` times as often, which bounds chains."""
    links = math.log(max(1.0, highest / TIMES), FACTOR) + 1
    far = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = step(far.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return far


def spelling_variants(docs: DataFrame, node: int = NODE) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words in ``docs`` (doc_id, text).

    Null and empty texts have no words. A null doc_id counts as empty text in a run's checksum; rows repeated with their
    id count again. Near words of equal n are ordered by code points. Texts and words of any length are used whole; other columns
    are ignored; an empty table gives no rows.
    """
    words = step(words_of(docs), "words")
    near = step(near_words(words, node), "near-words")
    every = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("top_n") >= FACTOR * F.col("n"), F.struct("top", "top_n")).alias("best"))
    every = step(every.select("word", F.col("best.top").alias("form"), "n", "n_near", F.col("best.top_n").alias("form_n")), "forms")
    highest = words.agg(F.max("n")).first()[0] or 1
    far = roots(every.where("form IS NOT NULL"), highest)
    return every.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS run FROM d),
u AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= 6 GROUP BY doc_id, run),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM u),
b AS (SELECT run, n, list_transform(range(1, length(code), 2), lambda i: ('0x' || code[i:i + 1])::BIGINT) AS bytes FROM x),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))) AS h FROM b, tab),
s AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT p.word, q.word AS other, q.n FROM c AS p JOIN c AS q ON p.rest = q.rest AND p.i = q.i AND p.word <> q.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.rest = v.word),
m AS (SELECT v.word, v.n, count(e.other) AS n_near, max(e.n) AS most FROM v LEFT JOIN e ON e.word = v.word GROUP BY v.word, v.n),
f AS (SELECT m.word, m.n, m.n_near, CASE WHEN most >= 5 * m.n THEN (SELECT min(e.other) FROM e WHERE e.word = m.word AND e.n = m.most) END AS form,
  CASE WHEN most >= 5 * m.n THEN most END AS form_n FROM m),
w AS (SELECT word, word AS root, form FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.form),
z AS (SELECT word, root FROM w WHERE form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z USING (word)
"""
