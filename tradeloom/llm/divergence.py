"""Source divergence audit: how far the term shares of a language's sources lie apart, computed over a partitioned cube.

1. One pass counts terms per (language, source), summed in the task before anything is shuffled.
2. Groups are dealt to group blocks and kept terms to term blocks. Cell (i, j, t) with i <= j owns all pairs of groups from
   blocks i and j on the terms of block t: the slice of group block i on term block t is sent to every cell that needs it.
   A cell holds two small integer matrices, whatever the sizes of sources and vocabularies.
3. Cells give partial sums per pair of groups, which add up along the term axis.

A term that neither of two groups has adds the same f for all such terms, so a cell only sums what present terms change;
cells of term block 0 add the rest. Everything is integer arithmetic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import step, table

MIN_DOCS = 3  # documents of the language a kept term stands in
SCALE = 1_000_000_000
TOP = 200  # reported terms a group
GROUPS, MOST_GROUPS, TERMS = 16, 128, 8192  # sizes of blocks: groups where there are few and many, terms
HELD = 500_000  # counts a task keeps before it passes them on

# bytes of UTF-8: A-Z become a-z, other ASCII but a-z ends a term, everything else is part of one
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def rows() -> pa.RecordBatch:
        lang, source, term, n, d = [], [], [], [], []
        for key, found in times.items():
            lang += [key[0]] * (len(found) + 1)
            source += [key[1]] * (len(found) + 1)
            term += [None, *found]  # the row without a term says that the group occurs
            n += [0, *found.values()]
            d += [0, *map(docs[key].__getitem__, found)]
        times.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
            names=["lang", "source", "term", "times", "docs"],
        )

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.translate(_FOLD).split()
            mine = times.setdefault((lang, source), Counter())
            before = len(mine)
            mine.update(words)
            docs.setdefault((lang, source), Counter()).update(set(words))
            held += len(mine) - before
            if held > HELD:
                yield rows()
                held = 0
    if times:
        yield rows()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals wide enough for any count."""
    wide = [c.cast("decimal(20,0)") for c in (count + 1, total + kept)]
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])
    return F.when(total + kept > 0, quotient + 1)


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    lang, i, j, t = (k.as_py() for k in key)
    heads = rows.filter(pa.compute.is_null(rows["term"])).sort_by([("side", "ascending"), ("source", "ascending")])
    names, base = heads["source"].to_pylist(), heads["p"].to_numpy()
    kept = int(heads["kept"][0].as_py())
    side = heads["side"].to_numpy()
    body = rows.filter(pa.compute.is_valid(rows["term"]))
    term = body["term"].combine_chunks().dictionary_encode()
    where = {name: k for k, name in enumerate(names)}
    groups = body["source"].combine_chunks().dictionary_encode()
    row = np.array([where[s] for s in groups.dictionary.to_pylist()], dtype=np.int64)[groups.indices.to_numpy()] if len(body) else np.zeros(0, np.int64)
    p = np.repeat(base[:, None], len(term.dictionary), axis=1)
    p[row, term.indices.to_numpy()] = body["p"].to_numpy()

    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) * (a - b)

    first = np.flatnonzero(side == 0)
    second = first if i == j else np.flatnonzero(side == 1)
    source, item, value = [], [], []
    for a in first.tolist():
        others = second[second > a]
        if not len(others):
            continue
        square, empty = gap(p[a], p[others]), gap(base[a], base[others])
        for x, y, part, none in (
            (None, others, (square // p[others]).sum(axis=1), empty // base[others]),
            (others, None, (square // p[a]).sum(axis=1), empty // base[a]),
        ):
            part += (kept * (t == 0) - p.shape[1]) * none
            source += [names[k] for k in x] if x is not None else [names[a]] * len(others)
            item += [names[k] for k in y] if y is not None else [names[a]] * len(others)
            value.append(part)
    values = np.concatenate(value) if value else np.zeros(0, np.int64)
    return pa.table([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "part"])


def term_shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, kept, lang_total, groups) and counted kept terms (lang, source, term, times, all_times).

    ``total`` counts kept terms in the group, ``kept`` is the language's number of kept terms, ``all_times`` a term's count
    in its language. Every occurring group has a row, also one without terms.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term binary, times long, docs long").withColumn("term", F.col("term").cast("string"))
    counts = step(found.groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("times").alias("all_times"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    terms = step(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    totals = terms.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    sizes = terms.groupBy("lang", "term").agg(F.first("all_times").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    present = counts.where("term IS NULL").select("lang", "source")
    many = present.groupBy("lang").agg(F.count("*").alias("groups"))
    groups = present.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(many, "lang").na.fill(0, ["total", "kept", "lang_total"])
    return step(groups, "groups"), terms


def pair_divergence(groups: DataFrame, terms: DataFrame, size: int = GROUPS, most: int = MOST_GROUPS, width: int = TERMS) -> DataFrame:
    """Rows (lang, source, item, value) for every ordered pair of a language's groups: f summed over all kept terms."""
    few, least = F.ceil(F.col("groups") / size), F.ceil(F.col("groups") / most)
    plan = groups.select(
        "lang", "source", "total", "kept", F.greatest(least, F.least(few, F.lit(8))).cast("int").alias("gs"), F.greatest(F.ceil(F.col("kept") / width), F.lit(1)).cast("int").alias("ts")
    ).withColumn("g", F.pmod(F.xxhash64("source"), "gs").cast("int"))
    ahead = plan.select("lang", "source", "g", "gs", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)).alias("t"), F.lit(None).cast("string").alias("term"), share(F.lit(0), F.col("total"), F.col("kept")).alias("p"), "kept")
    body = terms.join(plan, ["lang", "source"]).select(
        "lang", "source", "g", "gs", F.pmod(F.xxhash64("term"), "ts").cast("int").alias("t"), "term", share(F.col("times"), F.col("total"), F.col("kept")).alias("p"), "kept"
    )
    slices = ahead.unionByName(body).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gs") - 1)))
    cells = slices.select(
        "lang", F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"), "t", "source", "term", F.coalesce("p", F.lit(1)).cast("long").alias("p"), "kept", (F.col("g") > F.col("other")).cast("int").alias("side")
    )
    parts = cells.groupBy("lang", "i", "j", "t").applyInArrow(_cell, "lang string, source string, item string, part long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def excess_terms(groups: DataFrame, terms: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (lang, source, item, value, rank): the terms a group uses more than its language, by f, the first ``top``."""
    joined = terms.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("times"), F.col("total"), F.col("kept")).cast("long").alias("p"), share(F.col("all_times"), F.col("lang_total"), F.col("kept")).cast("long").alias("q")
    )
    gap = F.col("p") - F.col("q")
    valued = joined.where("p > q").select("lang", "source", "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, size: int = GROUPS, most: int = MOST_GROUPS, width: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of ``docs`` (text, lang, source); part is ``pair`` or ``term``.

    Null text, language and source are read as empty. A repeated row is one more document. Equal values rank by the item's
    bytes. A language of one source has no pairs, one without kept terms has pairs of value 0; an empty table gives no rows.
    Texts of any length are read whole; ids and further columns are ignored.
    """
    groups, terms = term_shares(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(groups, terms, size, most, width).withColumn("rank", F.row_number().over(order))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(excess_terms(groups, terms, top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) AS p,
    1 + 1000000000 * (k.total + 1) // (v.n + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT 'term', lang, source, term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
