"""Spelling variants against a literal reading of the definition, also where nodes are so small that every word list is paged."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tradeloom.llm.variants import one_edit, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, key string"


def plain(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in beside.items() if vs and max(words[v] for v in vs) >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(beside[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows_of():
    deal = random.Random(7)
    base = ["bridges", "committee", "Evening", "opponéntsÿ", "abcabcabc", "cabcabcab", "m" * 70, "m" * 71, "nm" * 40]
    spelt = list(base)
    for w in base:
        for _ in range(12):
            k = deal.randrange(len(w))
            c = deal.choice("aeiqué")
            spelt.append(deal.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))
    text = [" ".join(deal.choices(base, k=400) + deal.choices(spelt, k=25)) for _ in range(30)]
    chain = " ".join(["longish"] * 5 + ["longisk"] * 25 + ["longosk"] * 125 + ["lungosk"] * 625)
    return [(k, t, "w", 1, "k") for k, t in enumerate(text)] + [(100, chain, None, None, None)]


ODD = [
    (None, None, None, None, None),
    (None, "nobody " * 6, None, None, None),
    (5, "", None, None, None),
    (7, "repeats×÷ " * 3 + "日本語words語", None, None, None),
    (7, "repeats×÷ " * 3 + "日本語words語", None, None, None),
    (8, "z" * 40000 + " " + ("z" * 40001 + " ") * 5 + ("z" * 40000 + " ") * 5, None, None, None),
    (9, "short ones only a bc", None, None, None),
]


@pytest.mark.parametrize("node", [8192, 12, 1])
def test_brute_force(spark, node):
    rows = rows_of() + ODD
    want = plain(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of forms
    assert sorted(map(tuple, spelling_variants(spark.createDataFrame(rows, SCHEMA), node).collect()), key=str) == want


def test_one_edit():
    assert one_edit(b"abc", b"abd") and one_edit(b"abc", b"abxc") and one_edit(b"abc", b"ab") and one_edit(b"aab", b"ab")
    assert not one_edit(b"abc", b"abc") and not one_edit(b"abc", b"acb") and not one_edit(b"abc", b"a") and not one_edit(b"abcd", b"bce")


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame(ODD, SCHEMA).where(F.lit(False))).collect() == []
