"""Recall on held-out toxic documents as written and misspelt, and the order of use, misspelling and quotation."""

import duckdb

import compare
from tradeloom.llm import toxicity
from tradeloom.llm.common import table

SF_DIR = f"{compare.ROOT}/sf0.1"  # the smaller tables hold six toxic rows outside the sample


def changed(text, scorer, place):
    """Each whole term with one letter replaced: its first, or one inside."""
    out = (text or "").split()
    for i, w in enumerate(out):
        word = w.lower().strip(toxicity._EDGE)
        found = scorer.find(w.lower())
        if found and not found[1]:
            at = 0 if place == "first" else 1 + i % (len(word) - 1)
            new = word[:at] + ("x" if word[at] != "x" else "k") + word[at + 1 :]
            out[i] = w.lower().replace(word, new)
    return " ".join(out)


def test_misspelt_terms_are_caught(spark):
    model = toxicity.learn(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"))
    assert all(b >= 0 for b in model["beta"][:-1])  # no kind of hit speaks for a text
    judge = toxicity._Judge(model)
    rows = duckdb.sql(f"SELECT text, toxic, lang FROM '{SF_DIR}/documents.parquet' JOIN '{SF_DIR}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL").fetchall()
    toxic, clean = [t for t, y, _ in rows if y], [t for t, y, _ in rows if not y]
    share = lambda texts: sum(judge(t)[0] >= 0.5 for t in texts) / len(texts)
    assert share(toxic) >= 0.93 and share(clean) <= 0.02
    assert share([changed(t, judge.scorer, "inside") for t in toxic]) >= 0.89
    # terms of the other languages are one edit from clean words of theirs, so only their right spelling counts
    assert share([changed(t, judge.scorer, "first") for t, y, lang in rows if y and lang == "en"]) >= 0.9


def test_use_misspelling_quotation_in_order():
    judge = toxicity._Judge({"terms": ["pathetic", "worthless"], "weights": [3.0, 3.0], "beta": [2.0, 0.3, 0.3, 0.1, -4.0]})
    used, misspelt, cited = (judge(t)[0] for t in ("you are pathetic and worthless", "you are pathatic and worthliss", 'he called them "pathetic and worthless" once'))
    assert used > misspelt > cited
