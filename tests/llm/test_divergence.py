"""The divergence audit against a literal reading of its definition, with blocks small enough that every axis is cut."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradeloom.llm.divergence import audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"


def plain(rows, min_docs=3, top=200):
    docs, times, groups = Counter(), {}, set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        times.setdefault((lang, source), Counter()).update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        mine = sorted(s for g, s in groups if g == lang)
        kept = sorted((w for g, w in docs if g == lang and docs[g, w] >= min_docs), key=lambda w: w.encode())
        counts = {s: {w: times[lang, s][w] for w in kept} for s in mine}
        every = {w: sum(counts[s][w] for s in mine) for w in kept}

        def shares(c):
            return {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}

        p, q = {s: shares(counts[s]) for s in mine}, shares(every)
        for s in mine:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in mine if o != s]
            term = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found), 1)]
    return sorted(out)


def rows_of(many):
    """Sources of uneven sizes, one with a third of all rows, and terms that few or all of them share."""
    rows = []
    for k in range(many):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        words = [f"w{chr(97 + k * j % 23)}É" for j in range(k % 9)] + ["The", "the", "ÉA", f"only{chr(97 + k % 26)}"]
        rows.append((k, " ".join(words) + "_x-y" * (k % 4), "en" if k % 5 else "de", source, "clash", 1))
    return rows


ODD = [
    (None, None, None, None, None, None),
    (1, "", "en", None, None, None),
    (1, "same same", "xx", "a", None, None),
    (1, "same same", "xx", "a", None, None),
    (1, "same same", "xx", "a", None, None),
    (2, "longlong " * 20000, "xx", "b", None, None),
    (3, "123 !?", "yy", "lonely", None, None),
    (4, "\x00once\x7ftwice", "zz", "a", None, None),
    (5, "nothing kept", "zz", "b", None, None),
]


@pytest.mark.parametrize("sizes", [(16, 128, 8192), (2, 3, 4), (1, 1, 1)])
def test_brute_force(spark, sizes):
    rows = rows_of(60) + ODD
    got = audit(spark.createDataFrame(rows, SCHEMA), 3, 5, *sizes).collect()
    assert sorted(map(tuple, got)) == plain(rows, top=5)


def test_empty(spark):
    empty = spark.createDataFrame(ODD, SCHEMA).where(F.lit(False))
    assert audit(empty).collect() == []
