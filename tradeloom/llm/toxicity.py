"""Toxicity scores: a fuzzy lexicon walk finds terms, their context separates use from quotation.

The lexicon is learned from labelled rows. Its terms form a trie; a Levenshtein automaton of the budgeted number of edits
is intersected with the trie, and the product is determinised lazily, so a word is read once, letter by letter, and most
words leave the automaton after a few letters. Each hit is weighed by its context window: quotation marks around it and
words of speaking before it lower it, other hits nearby raise it. A misspelt hit carries its term's weight at a fixed
discount per edit. A logistic model over the sums of a text turns them into the score; it is fitted on the same labelled
sample and on toxic texts of it with their terms misspelt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import held_out, map_rows, step, table

SAMPLE = 2000  # labelled rows of each class that the lexicon and the model are fitted on, at most
TERMS = 2000  # terms of the lexicon, at most
EVIDENCE, RATIO = 4.0, 8.0  # a term needs this G² beyond what the best of all candidates has by chance, and this ratio of rates
DISCOUNT = 0.85  # of a misspelt term's weight, for each edit
CHANCE = 0.001  # of clean texts in which a misspelt term may show before only its right spelling counts
FIRST = 5  # letters of a term whose first letter may be wrong
STEM = 4  # letters of the beginnings that are learned as terms too, written with a star
NEAR = 6  # words on each side of a hit that form its context
MEMO, STATES = 200_000, 100_000  # words and automaton states remembered by a worker

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’¡¿…–—"
_OPEN, _CLOSE = "\"'«„“‚‘`", "\"'»“”’`"
# words that announce a quotation or the mention of a word, in the languages of the corpus
REPORTING = frozenset("said says wrote called calling word term phrase quote quoted slur insult nannte sagte wort zitat begriff dit disait mot terme citation dijo palabra cita término".split())


def edits_allowed(term: str) -> int:
    """Misspellings accepted for a term by its length: none below 4 letters and for beginnings, one below 9, then two."""
    return 0 if term.endswith("*") or len(term) < 4 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The product of a lexicon trie and Levenshtein automata, made deterministic as words arrive.

    A product state is a set of (trie node, whether the first letter was edited, edits so far); only terms of ``FIRST``
    letters or more may have their first letter wrong. ``match`` gives (term index, edits) of the nearest term, ties to the smaller index, or None; a word that
    only begins like a starred term counts as one edit away.
    """

    def __init__(self, terms: list[str], exact: frozenset[int] = frozenset()):
        self.allowed = [0 if i in exact else edits_allowed(t) for i, t in enumerate(terms)]
        self.child: list[dict[str, int]] = [{}]
        self.term, self.budget = [-1], [0]
        self.stem: dict[int, int] = {}  # trie node at which any word with this beginning is a hit
        for i, term in enumerate(terms):
            node = 0
            for ch in term.rstrip("*"):
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.budget.append(0)
                node = self.child[node][ch]
                self.budget[node] = max(self.budget[node], self.allowed[i])
            if term.endswith("*"):
                self.stem[node] = i
            else:
                self.term[node] = i
        self.letters = {ch for t in terms for ch in t}
        self.long = [len(t) >= FIRST for t in terms]
        self.budget[0] = max((a for a, long in zip(self.allowed, self.long) if long), default=0)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.begins: list[int] = []
        start: dict[tuple[int, bool], int] = {}
        self._reach(start, 0, False, 0)
        self._state(frozenset(start.items()))

    def _state(self, now: frozenset) -> int:
        if now not in self.ids:
            self.ids[now] = len(self.states)
            self.states.append(now)
            self.moves.append({})
            ends = [(e, t) for (n, first), e in now if (t := self.term[n]) >= 0 and e <= self.allowed[t] and (self.long[t] or not first)]
            self.accepts.append(min(ends)[::-1] if ends else None)
            self.begins.append(next((self.stem[n] for (n, _), e in now if n in self.stem and not e), -1))
        return self.ids[now]

    def _reach(self, best: dict[tuple[int, bool], int], node: int, first: bool, edits: int) -> None:
        if edits <= self.budget[node] and edits < best.get((node, first), 99):
            best[node, first] = edits
            for below in self.child[node].values():  # a letter of the term left out
                self._reach(best, below, first or not node, edits + 1)

    def _step(self, state: int, ch: str) -> int:
        best: dict[tuple[int, bool], int] = {}
        for (node, first), edits in self.states[state]:
            for letter, below in self.child[node].items():
                if letter == ch:
                    self._reach(best, below, first, edits)
                else:  # a letter replaced
                    self._reach(best, below, first or not node, edits + 1)
            self._reach(best, node, first or not node, edits + 1)  # a letter put in
        return self._state(frozenset(best.items())) if best else -1

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > STATES:
            self._forget()
        state, begun = 0, None
        for ch in word:
            ch = ch if ch in self.letters else "\0"
            after = self.moves[state].get(ch)
            if after is None:
                after = self.moves[state][ch] = self._step(state, ch)
            if after < 0:
                return begun
            state = after
            if self.begins[state] >= 0:
                begun = (self.begins[state], 1)
        return self.accepts[state] or begun


class Scorer:
    """Hits and context sums of whole texts for one lexicon."""

    def __init__(self, terms: list[str], weights: list[float], exact: list[int] | tuple = ()):
        self.lexicon, self.weights, self.memo = FuzzyLexicon(terms, frozenset(exact)), weights, {}

    def find(self, word: str) -> tuple[int, int] | None:
        try:
            return self.memo[word]
        except KeyError:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self.lexicon.match(word.strip(_EDGE))
            return found

    def hits(self, words: list[str]) -> list[tuple[int, int, int, bool]]:
        """(place, term, edits, quoted) of each hit, in order."""
        known = {w: f for w in set(words) if (f := self.find(w))}
        if not known:
            return []
        return [(i, *known[w], quoted(words, i)) for i, w in enumerate(words) if w in known]

    def features(self, text: str | None) -> tuple[list[float], int, int]:
        """Log sums of used, quoted and crowded hits, the share of words hit; hits and quoted hits."""
        words = (text or "").lower().split()
        hits = self.hits(words)
        used = cited = crowded = 0.0
        for k, (at, term, edits, inside) in enumerate(hits):
            weight = self.weights[term] * DISCOUNT**edits
            near = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(hits) and abs(hits[j][0] - at) <= NEAR)
            if inside:
                cited += weight
            else:
                used += weight
                crowded += weight * near
        share = math.log1p(1000 * len(hits) / len(words)) if words else 0.0
        return [math.log1p(used), math.log1p(cited), math.log1p(crowded), share], len(hits), sum(h[3] for h in hits)


def misspelt(text: str, scorer: Scorer) -> str:
    """``text`` with one letter of every whole term it holds replaced, at a place that the term and its position choose."""
    out = (text or "").lower().split()
    for i, w in enumerate(out):
        found, word = scorer.find(w), w.strip(_EDGE)
        if found and not found[1] and len(word) > 4:
            at = 1 + (i + len(word)) % (len(word) - 1)
            out[i] = w.replace(word, f"{word[:at]}{chr(97 + (ord(word[at]) + 7) % 26)}{word[at + 1:]}")
    return " ".join(out)


def quoted(words: list[str], at: int, near: int = NEAR) -> bool:
    """True if the word at ``at`` stands between an opening and a closing mark of its window, or after a word of speaking."""
    before, after = words[max(0, at - near) : at + 1], words[at : at + near + 1]
    opened = closed = False
    for w in reversed(before):
        if w is not words[at] and w[-1] in _CLOSE and w[0] not in _OPEN:
            break  # an earlier quotation ends here
        if w[0] in _OPEN:
            opened = True
            break
    for w in after:
        if w[-1] in _CLOSE or (len(w) > 1 and w[-2] in _CLOSE):
            closed = True
            break
    return (opened and closed) or any(w.strip(_EDGE) in REPORTING for w in before[:-1][-2:])


def _contexts(rows: list) -> Iterator[tuple]:
    """Distinct (term, its neighbours) of a text, for words and their beginnings; neighbours tell copies from separate use."""
    for doc_id, toxic, text in rows:
        words = [w.strip(_EDGE) for w in (text or "").lower().split()]
        ends = ["", *words, ""]
        for a, w, b in set(zip(ends, words, ends[2:])):
            if w:
                yield w, f"{a} {b}", toxic, doc_id
            if len(w) > STEM + 1 and w[:STEM].isalpha():
                yield w[:STEM] + "*", f"{a} {w} {b}", toxic, doc_id


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Up to ``most`` rows of each class as (doc_id, toxic, text), chosen by a hash of the id; ids are unique."""
    learn = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    each = [learn.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    chosen = each[0].unionByName(each[1]).dropDuplicates(["doc_id"])
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # 2 * most rows of two numbers
    return met.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))  # an id on several texts gives one row


def learn_lexicon(sample: DataFrame, most: int = TERMS) -> list[tuple[str, float]]:
    """Terms found in far more toxic than clean documents, with log ratios; at most ``most``, strongest first.

    A use in the same words as another document's counts for that document only, so copies are no evidence.
    """
    each = map_rows(sample.select("doc_id", "toxic", "text"), _contexts, "term string, near string, toxic int, doc_id long")
    apart = each.groupBy("term", "near").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    per_term = apart.select("term", "toxic", "doc_id").distinct().groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all_t, all_c = (float(max(1, size.get(k, 0))) for k in (1, 0))
    t, c = F.col("t"), F.col("c")
    ratio = ((t + 0.5) / (all_t + 1)) / ((c + 0.5) / (all_c + 1))
    expected = (t + c) * (all_t / (all_t + all_c))
    g2 = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / ((t + c) - expected))).otherwise(0))
    scored = step(per_term.where("t > 2").select("term", F.log(ratio).alias("weight"), g2.alias("g2")), "candidates")
    chance = 2 * math.log(max(1, scored.count()))
    top = scored.where((F.col("g2") >= EVIDENCE + chance) & (F.col("weight") >= math.log(RATIO))).orderBy(F.desc("g2"), "term").limit(most)
    return [(r["term"], r["weight"]) for r in top.collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic weights, constant last, with classes weighed so that the positive share is ``share``."""
    design = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.diag([*[1.0] * x.shape[1], 1e-3]) * 0.1
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - ridge * 0.1 * np.append(beta[:-1], 1e-3 * beta[-1]))
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _ambiguous(clean: DataFrame, model: dict) -> list[int]:
    """Terms whose neighbours by edits are words of their language: more than ``CHANCE`` of the clean texts hold one."""

    def rows(part: list) -> Iterator[tuple]:
        scorer = Scorer(model["terms"], model["weights"])
        for (text,) in part:
            yield from {(term,) for _, term, edits, _ in scorer.hits((text or "").lower().split()) if edits and not model["terms"][term].endswith("*")}

    seen = map_rows(clean, rows, "term int").groupBy("term").count()
    return sorted(r["term"] for r in seen.where(F.col("count") > CHANCE * clean.count()).collect())  # at most the lexicon


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """Lexicon and model from a bounded labelled sample outside the held-out fold."""
    sample = labelled_sample(docs, labels, most)
    terms = learn_lexicon(sample)
    model = {"terms": [t for t, _ in terms], "weights": [w for _, w in terms], "exact": [], "beta": None}
    if terms:
        model["exact"] = _ambiguous(sample.where("toxic = 0").select("text"), model)

        def rows(part: list) -> list:
            scorer = Scorer(model["terms"], model["weights"], model["exact"])
            misspellings = [(toxic, misspelt(text, scorer)) for toxic, text in part if toxic]
            return [(toxic, scorer.features(text)[0]) for toxic, text in [*part, *misspellings]]

        seen = map_rows(sample.select("toxic", "text"), rows, "toxic int, x array<double>", chunk=4096).collect()  # 3 * most rows of four numbers
        x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen])
        if len(set(y.tolist())) == 2:
            model["beta"] = fit_logistic(x, y, 0.5).tolist()
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Return per row doc_id, score, n_hits, n_quoted.

    Null, empty and blank texts have no hits and get the model's score for none. If the labels held no toxic row, or no
    term passed, every score is 0. Repeated rows are scored alike, texts whole whatever their length; other columns are
    ignored; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(model)
        for batch in batches:
            out = [judge(value.as_py()) for value in batch.column(1)]
            if out:
                s, n, cited = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(cited, pa.int64())], names=["doc_id", "score", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_hits long, n_quoted long")


class _Judge:
    """(score, hits, quoted hits) of a text under a model."""

    def __init__(self, model: dict):
        self.scorer, self.beta = Scorer(model["terms"], model["weights"], model.get("exact", ())), model["beta"]

    def __call__(self, text: str | None) -> tuple[float, int, int]:
        x, n, cited = self.scorer.features(text)
        if not self.beta:
            return 0.0, n, cited
        z = sum(a * b for a, b in zip(x, self.beta)) + self.beta[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n, cited


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the texts that score ``least`` or more; the model learns from ``labelled`` documents.

    Rows pass with all their columns, whatever their names, in the one scan that scores them. Null and empty texts stay unless
    the model scores them as toxic, rows repeated or without an id are judged each by its text; an empty table stays empty.
    """
    model = learn(labelled, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(model)
        for batch in batches:
            yield batch.filter(pa.array([judge(value.as_py())[0] < least for value in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
