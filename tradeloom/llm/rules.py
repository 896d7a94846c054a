"""Quality rules as a short-circuit cascade.

Rules look at the words and lines of a text. On a sample each rule is timed and its rejections are counted; rules run in
the order of rejections per second, so a text that any rule rejects mostly meets a cheap and frequent reason first. A text
is kept only if every rule passes, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import map_rows, table

NGRAM = 8  # words of a window whose repetition counts
SAMPLE = 500  # texts that costs and selectivities are estimated on

SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Measured:
    """Counts of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str) -> int | list[str]:
        if name.startswith("_"):
            raise AttributeError(name)
        value = _COUNTS[name](self)
        setattr(self, name, value)
        return value


def repeated_words(words: list[str], n: int = NGRAM) -> int:
    """Words inside windows of ``n`` words that occur twice or more in ``words``, the first occurrence included.

    Windows are named by doubling: pairs of words get numbers, then pairs of pairs, and so on; equal numbers are equal windows.
    """
    if len(words) < n:
        return 0
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    reach = 1
    while reach < n:
        pair = code[:-reach] * (int(code.max()) + 1) + code[reach:]
        code = np.unique(pair, return_inverse=True)[1]
        reach *= 2
    again = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:-n] += again[: len(words) - n + 1]
    np.subtract.at(edge, np.flatnonzero(again) + n, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if _WORDS.search(line)]
    return len(lines) - len(set(lines))


_COUNTS: dict[str, Callable] = {
    "words": lambda m: _WORDS.findall(m.text),
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: sum(map(len, m.words)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_dup_lines": lambda m: duplicate_lines(m.text),
    "n_repeat_words": lambda m: repeated_words(m.words),
    "n_upper": lambda m: sum(1 for w in m.words if len(w) > 1 and w.isupper()),
    "n_lettered": lambda m: sum(1 for w in m.words if any(map(str.isalpha, w))),
    "n_lines": lambda m: sum(1 for line in m.text.split("\n") if _WORDS.search(line)),
}

#: name: true if the text fails; the first two are the base rules
RULES: dict[str, Callable[[Measured], bool]] = {
    "short": lambda m: m.n_words < 20,
    "repeats": lambda m: 100 * m.n_repeat_words > 30 * m.n_words,
    "symbols": lambda m: 100 * m.n_symbols > 10 * m.n_words,
    "word_length": lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 14 * m.n_words,
    "shouting": lambda m: 100 * m.n_upper > 50 * m.n_words,
    "letters": lambda m: 100 * m.n_lettered < 60 * m.n_words,
    "lines": lambda m: m.n_lines > 1 and 100 * m.n_dup_lines > 50 * m.n_lines,
}


def estimate(texts: list[str | None], names: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """(seconds a text, share rejected) of each rule, every rule on fresh measurements."""
    found = {}
    for name in names or list(RULES):
        rule, rejected, began = RULES[name], 0, time.perf_counter()
        for text in texts:
            rejected += rule(Measured(text))
        found[name] = ((time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts)))
    return found


def order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first; ties by name."""
    return sorted(estimates, key=lambda n: (-estimates[n][1] / max(estimates[n][0], 1e-9), n))


def cascade(m: Measured, names: list[str]) -> str | None:
    """The first rule of ``names`` that the text fails."""
    return next((n for n in names if RULES[n](m)), None)


def sample_texts(docs: DataFrame, size: int = SAMPLE) -> list[str | None]:
    """About ``size`` texts by a hash of the id, from every part of the table; at most twice as many."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, size / max(1, total))))
    return [r["text"] for r in part.select("text").limit(2 * size).collect()]


def judge(docs: DataFrame, names: list[str], counts: bool = True) -> DataFrame:
    """Return per row doc_id, n_words, the base counts (with ``counts``; else null), base_failed and kept.

    ``names`` is the order of the cascade. A null, empty or blank text has no words, fails the base rules and is not kept.
    Repeated rows are judged alike, texts whole; null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def rows(part: list) -> Iterator[tuple]:
        for doc_id, text in part:
            m = Measured(text)
            kept = cascade(m, names) is None
            base = m.n_words < 20 or (100 * m.n_repeat_words > 30 * m.n_words) if counts else None
            yield (doc_id, m.n_words, *((m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) if counts else (None,) * 4), base, kept)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_rows(docs.select("doc_id", "text"), rows, schema)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, order(estimate(sample_texts(docs))))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
s AS (SELECT row_no, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
k AS (SELECT row_no, p, array_to_string(w[p:p + 7], ' ') AS key FROM s),
t AS (SELECT row_no, key FROM k GROUP BY row_no, key HAVING count(*) > 1),
h AS (SELECT DISTINCT row_no, unnest(range(p, p + 8)) AS i FROM k JOIN t USING (row_no, key)),
r AS (SELECT row_no, count(*) AS n_repeat_words FROM h GROUP BY row_no),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM d LEFT JOIN lc USING (row_no) LEFT JOIN r USING (row_no)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_upper > 50 * n_words
    OR 100 * n_lettered < 60 * n_words OR (n_lines > 1 AND 100 * n_dup_lines > 50 * n_lines)) AS kept
FROM b
"""
