"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A spaced seed is a fixed mask over consecutive tokens that ignores some places, so a hit survives substitutions there.
Every place of a benchmark item and of a document is hashed once per mask; equal hashes are hits. A hit fixes how an item
lies along a document, and the tokens around it are then compared along that alignment: a document is contaminated where
``WIDTH`` aligned tokens (all tokens of a shorter item) agree in at least ``SHARE`` of the places. The masks of a width hit
every window that meets this rule, which a test enumerates; documents are hashed for the widths the benchmark has.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import free_names, same_row, step, table, text_hash

WIDTH, SHARE = 13, 0.8
BROADCAST_BYTES = 8 << 20  # seeds of the benchmark, at 40 bytes a row, are sent to every task up to this size, and so are its items
#: 1: the token counts, 0: it is ignored; every two misses in a window of this width leave one of its masks untouched somewhere
MASKS = {13: ("11101111", "1111010011", "100100111011"), 12: ("111011", "11100101"), 11: ("1101011", "111001001"), 10: ("111011", "11010011", "11111")}
SQL_SPAN, SQL_MASKS = 12, ("110110011011", "101101110101")  # seeds of the SQL, which find a part of the windows

_TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def masks(width: int) -> tuple[str, ...]:
    """Masks that hit every window of ``width`` tokens with as many misses as ``SHARE`` allows."""
    if width in MASKS:
        return MASKS[width]
    if math.ceil(width * SHARE) == width:
        return ("1" * width,)
    return tuple("1" * k + "0" + "1" * (width - k - 1) for k in range(width))


def seeds(hashed: DataFrame, shapes: list[str], *keys: str) -> DataFrame:
    """One row per place and mask of ``h`` (array of token hashes): keys, at (place), seed (hash of mask and tokens)."""
    least = min(map(len, shapes))
    place = F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at")
    placed = hashed.where(F.size("h") >= least).select(*keys, "h", place)
    masked = [F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + i) for i, c in enumerate(m) if c == "1"]) for m in shapes]
    masked = [s if len(m) == least else F.when(F.col("at") + len(m) <= F.size("h"), s) for m, s in zip(shapes, masked)]
    return placed.select(*keys, "at", F.explode(F.array(*masked)).alias("seed")).where("seed IS NOT NULL")


def _agreement(doc: Column, item: Column, low: Column) -> Column:
    """Most agreeing tokens in a window of the aligned stretch ``doc``, which begins at place ``low`` of ``item``; one pass."""
    width = F.least(F.lit(WIDTH), F.size(item))
    same = lambda j: (doc[j] == item[j + low]).cast("int")

    def further(state: Column, j: Column) -> Column:
        now = state["now"] + same(j) - F.when(j >= width, same(j - width)).otherwise(0)
        return F.struct(now.alias("now"), F.when(j >= width - 1, F.greatest(state["best"], now)).otherwise(0).alias("best"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(doc) - 1), start, further, lambda state: state["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, one row per (doc_id, text_key, item_id): agree, the most agreeing tokens in a window.

    An item of under ``WIDTH`` tokens is sought whole; one without tokens overlaps nothing. Null texts have no tokens. Null ids are
    kept as they are. Repeated documents give one row, repeated items each their own by id. A seed common to many
    documents only adds rows to those documents; nothing is gathered by seed. Empty tables give no rows.
    """
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("h")).dropDuplicates(["item_id", "h"]).withColumn("item_key", F.xxhash64("h")).where(F.size("h") > 0)
    items = step(items, "items")
    width = F.least(F.lit(WIDTH), F.size("h"))
    widths = sorted(r[0] for r in items.select(width).distinct().collect()) or [WIDTH]
    shapes = sorted({m for w in widths for m in masks(w)})
    parts = reduce(DataFrame.unionByName, [seeds(items.where(width == w), list(masks(w)), "item_id", "item_key") for w in widths]).withColumnRenamed("at", "item_at")
    small = parts.count() * 40 <= BROADCAST_BYTES
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), "text")
    placed = seeds(keyed.select("doc_id", "text_key", _hashes(F.col("text")).alias("h")), shapes, "doc_id", "text_key")
    hits = placed.join(F.broadcast(parts) if small else parts, "seed").groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    hits = step(hits, "seed-hits")
    found = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "item_id", "item_key", "shifts")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    known = items.select(F.col("item_id").alias("_item"), F.col("item_key").alias("_item_key"), F.col("h").alias("item"))
    ours = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_item_key"))
    known = F.broadcast(known) if small else known
    beside = keyed.join(found, same).select("doc_id", "text_key", _hashes(F.col("text")).alias("h"), "item_id", "item_key", "shifts")
    # the stretch of the document beside the item, cut once and written, so that no later expression hashes the text again
    lain = beside.select("doc_id", "text_key", "h", "item_id", "item_key", F.explode("shifts").alias("shift")).join(known, ours)
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item"), F.size("h") - F.col("shift"))
    lain = step(lain.select("doc_id", "text_key", "item_id", "item_key", low.alias("low"), F.slice("h", low + F.col("shift") + 1, high - low).alias("part")), "aligned")
    checked = lain.join(known, ours).select("doc_id", "text_key", "item_id", F.least(F.lit(WIDTH), F.size("item")).alias("width"), _agreement(F.col("part"), F.col("item"), F.col("low")).alias("agree"))
    right = checked.where(F.col("agree") >= F.ceil(F.col("width") * SHARE))
    return right.groupBy("doc_id", "text_key", "item_id").agg(F.max("agree").cast("long").alias("agree"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items (distinct items found), agree (the best window, 0 if none)."""
    found = overlaps(docs, benchmark).groupBy("doc_id", "text_key").agg(F.count("*").alias("n_items"), F.max("agree").alias("agree"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_items", "agree")
    keys = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"))
    joined = keys.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("agree", F.lit(0)).alias("agree"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _masked_sql(words: str, at: str) -> str:
    return ", ".join(f"struct_pack(m := {k}, k := [{', '.join(f'{words}[{at} + {i + 1}]' for i, c in enumerate(mask) if c == '1')}])" for k, mask in enumerate(SQL_MASKS))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS w FROM benchmark),
dp AS (SELECT row_no, w, unnest(range(0, len(w) - {SQL_SPAN - 1})) AS pos FROM d WHERE len(w) >= {SQL_SPAN}),
bp AS (SELECT item_id, w, unnest(range(0, len(w) - {SQL_SPAN - 1})) AS pos FROM b WHERE len(w) >= {SQL_SPAN}),
ds AS (SELECT row_no, pos, unnest([{_masked_sql("w", "pos")}]) AS seed FROM dp),
bs AS (SELECT item_id, pos AS item_pos, unnest([{_masked_sql("w", "pos")}]) AS seed FROM bp),
h AS (SELECT DISTINCT row_no, item_id, pos - item_pos AS shift FROM ds JOIN bs USING (seed)),
a AS (SELECT row_no, item_id, shift, d.w AS dw, b.w AS bw, greatest(0, -shift) AS low, least(len(b.w), len(d.w) - shift) AS high, least({WIDTH}, len(b.w)) AS width FROM h JOIN d USING (row_no) JOIN b USING (item_id)),
f AS (SELECT row_no, item_id, shift, width, unnest(range(low, high)) AS j, dw, bw FROM a),
g AS (SELECT row_no, item_id, shift, width, j, (dw[j + shift + 1] = bw[j + 1])::INT AS same FROM f),
s AS (SELECT row_no, item_id, width, sum(same) OVER w AS agree, count(*) OVER w AS n
  FROM g WINDOW w AS (PARTITION BY row_no, item_id, shift ORDER BY j ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW)),
v AS (SELECT row_no, item_id, max(agree) AS agree FROM s WHERE n = width AND agree >= ceil(width * {SHARE}) GROUP BY row_no, item_id),
c AS (SELECT row_no, count(*) AS n_items, max(agree) AS agree FROM v GROUP BY row_no)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(agree, 0)::BIGINT AS agree FROM d LEFT JOIN c USING (row_no)
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item.

    Null and empty texts stay; rows repeated or without an id are judged by their text. All columns pass, whatever their
    names; without items every row stays.
    """
    doc_id, key = free_names(docs, "_id", "_key")
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct()
    return docs.join(found, same_row(docs, doc_id, key), "left_anti")
