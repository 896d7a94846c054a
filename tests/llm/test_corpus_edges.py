"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; parts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeloom.llm.common import keep_smallest
from tradeloom.llm import chat, decontaminate, language, near_copies, packing, quality, repeats, rules, simhash, token_file, tokens, toxicity
from tradeloom.session import scratch_path

WORDS = [f"w{k}" for k in range(40)]
chance = random.Random(1)
LONG = " ".join(chance.choice(WORDS) for _ in range(30_000))
ROWS = [
    (1, "a b c d e f g h", "en"), (1, "a b c d e f g h", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "de"),
    (None, "nobody knows this one", "en"), (5, LONG, "en"), (6, LONG + " tail", "en"), (7, "12 34 !?", None), (8, "ü ß <|end|> </s>", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "s", len(t or ""), k, "x") for k, (i, t, g) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root long, fp string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def both(df, empty):
    assert empty.count() == 0 and empty.columns == df.columns
    return df.collect()


def test_every_operator_keeps_every_row(spark, docs, labels):
    none = docs.where("1 = 0")
    bench = spark.createDataFrame([(1, None), (2, " ".join(WORDS[:20])), (None, LONG[:400])], "item_id long, text string")
    path = packing.vocabulary_path("byte_bpe_50k.json")
    model = toxicity.learn(docs, labels)
    assert len(both(toxicity.score(docs, model), toxicity.score(none, toxicity.learn(none, labels.where("1 = 0"))))) == len(ROWS)
    grades = quality.learn(docs, labels)
    assert len(both(quality.grade(docs, grades), quality.grade(none, quality.learn(none, labels.where("1 = 0"))))) == len(ROWS)
    named = both(language.predict(docs, language.learn(docs)), language.predict(none, language.learn(none)))
    assert {r["doc_id"] for r in named if r["lang_pred"] == "und"} == {2, 3, 4, 7}
    judged = both(rules.judge(docs, list(rules.RULES)), rules.judge(none, list(rules.RULES)))
    assert sorted(r["n_words"] for r in judged) == sorted(len((t or "").split()) for _, t, _ in ROWS)
    near = both(simhash.near_duplicates(docs), simhash.near_duplicates(none))
    component = {(r["doc_id"], r["component_id"]) for r in near}
    assert len(near) == len(ROWS) and {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 5), (None, None)} <= component
    cut = both(repeats.repeats(docs), repeats.repeats(none))
    assert {r["doc_id"]: r["n_removed"] for r in cut} == {1: 0, 2: 0, 3: 0, 4: 0, None: 0, 5: 30_000, 6: 30_000, 7: 0, 8: 0}
    assert {r["kept_text"] for r in cut if r["doc_id"] == 6} == {"tail"}
    found = both(decontaminate.contamination(docs, bench), decontaminate.contamination(none, bench))
    assert len(found) == len(ROWS) and {r["doc_id"] for r in found if r["contaminated"]} >= {5, 6}
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.where("1 = 0")).collect())
    pieces = both(packing.pack(docs, path), packing.pack(none, path))
    assert sorted(r["length"] for r in pieces if r["doc_id"] in (2, 3)) == [1, 1]
    where = scratch_path(spark, "edge-tokens")
    word = packing.vocabulary_path("word_bpe_49k.json")
    token_file.write_tokens(docs, word, where)
    read = sorted(token_file.read_tokens(spark, where).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted((i for i, _, _ in ROWS), key=lambda i: (i is not None, i or 0))
    token_file.write_tokens(none, word, where + "-none")
    assert token_file.read_tokens(spark, where + "-none").count() == 0


def test_stages_keep_columns_and_clean_rows(spark, docs, labels):
    bench = spark.createDataFrame([(2, " ".join(WORDS[:20]))], "item_id long, text string")
    once = simhash.keep_one(docs)
    assert once.columns == docs.columns and sorted(r["doc_id"] or 0 for r in once.collect()) == [0, 1, 2, 5, 7, 8]
    cut = repeats.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {(r["doc_id"], r["root"]): r for r in cut.collect()}
    assert len(rows) == len(ROWS) and rows[6, 7]["text"] == "tail" and rows[6, 7]["n_chars"] == 4 and rows[2, 2]["text"] is None
    assert toxicity.drop_toxic(docs, docs, labels).columns == docs.columns
    assert decontaminate.drop_contaminated(docs, bench).count() == len(ROWS)


def test_wide_buckets_agree(spark, monkeypatch):
    chance = random.Random(3)
    shared = [chance.choice(WORDS) for _ in range(60)]
    rows = [(k, " ".join([f"l{k}", *shared[chance.randrange(20) :], f"r{k}"])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(repeats.repeats(docs).select("doc_id", "n_removed", "kept_text").collect())
    monkeypatch.setattr(repeats, "BUCKET", 3)
    assert sorted(repeats.repeats(docs).select("doc_id", "n_removed", "kept_text").collect()) == usual
    assert any(r["n_removed"] for r in usual)


def test_paged_routes_agree(spark, monkeypatch):
    chance = random.Random(4)
    base = chance.getrandbits(63)
    codes = {base ^ sum(1 << b for b in chance.sample(range(63), chance.randrange(9))) for _ in range(300)}
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    want = {frozenset(g) for g in _components(codes)}
    for page in (4096, 16):
        monkeypatch.setattr(simhash, "PAGE", page)
        found = {c: {c} for c in codes}
        for r in simhash.links(frame).collect():
            a, b = found[r["u"]], found[r["v"]]
            if a is not b:
                a |= b
                for c in b:
                    found[c] = a
        assert {frozenset(g) for g in found.values()} == want


def _components(codes):
    left, groups = set(codes), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            c = todo.pop()
            near = {d for d in left if (c ^ d).bit_count() <= simhash.MOST}
            left -= near
            group |= near
            todo += near
        groups.append(group)
    return groups


def test_fuzzy_lexicon_is_levenshtein():
    terms = ["idiot", "pathetic", "scum", "wort*"]
    lexicon = toxicity.FuzzyLexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    chance = random.Random(5)
    for _ in range(3000):
        term = chance.choice(terms[:3])
        word = list(term)
        for _ in range(chance.randrange(4)):
            at = chance.randrange(len(word))
            word[at : at + chance.randrange(2)] = chance.choice(["", "a", "t", "ö"])
        word = "".join(word)
        near = [(distance(t, word), k) for k, t in enumerate(terms[:3]) if len(t) >= toxicity.FIRST]  # any letter may be wrong
        near += [(distance(t[1:], word[1:]), k) for k, t in enumerate(terms[:3]) if t[0] == word[:1]]
        near = [(d, k) for d, k in near if d <= toxicity.edits_allowed(terms[k])]
        assert lexicon.match(word) == (min(near)[::-1] if near else None), word
    assert lexicon.match("worthless") == (3, 1) and lexicon.match("wor") is None


def test_quotation_lowers_the_score():
    scorer = toxicity.Scorer(["idiot"], [3.0])
    plain, cited = scorer.features("you are an idiot and always were"), scorer.features('she wrote "what an idiot he is" in the report')
    assert plain[1:] == (1, 0) and cited[1:] == (1, 1) and cited[0][0] == 0 < cited[0][1]
    assert scorer.features(None)[1] == scorer.features("")[1] == 0


def test_encoder_equals_the_tokenizer():
    odd = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\nfoo bar", "a.\nB c", "a.\n\nB c", "x | y", "don't stop", "Σας ΣΑΣ. x", "<|endoftext|> a", "tab\tx y", "日本語 。", "😀 😀😀", "a\u0085b c", "É.\nÇa va. Ô,", "ﬁ x", "a\n\n\nb c"]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = packing.vocabulary_path(name)
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
        encoder = tokens.Encoder(path, lead)
        assert encoder.encode(odd) == want and encoder.encode(odd) == want


def test_simple8b_round_trip():
    chance = np.random.default_rng(0)
    for n in (0, 1, 5, 4095, 4096, 4097, 9000):
        for most in (2, 300, 49408, 2**31, 2**61, 2**64 - 1):
            ids = chance.integers(0, most, n, dtype=np.uint64, endpoint=True) >> chance.integers(0, 40, n).astype(np.uint64)
            words, starts = token_file.encode(ids)
            assert (token_file.decode(words, starts.astype(np.int64), n) == ids).all()


def test_plan_uses_up_the_demand():
    chance = np.random.default_rng(0)
    for n in (1, 40, 5000):
        demand = np.bincount(chance.integers(1, 129, n), minlength=129)[1:]
        chosen = packing.plan(demand, 128)
        assert (sum(p * k for p, k in chosen) == demand).all() and all((p * np.arange(1, 129)).sum() <= 128 for p, _ in chosen)
        bound = -(-int((demand * np.arange(1, 129)).sum()) // 128)
        assert sum(k for _, k in chosen) <= bound * 1.02 + (demand[64:] > 0).sum() * (n < 100)


def test_repeated_words_brute_force():
    chance = random.Random(6)
    for _ in range(200):
        words = [chance.choice("abc") for _ in range(chance.randrange(60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert rules.repeated_words(words) == len(hit)


def test_cascade_order_changes_cost_only():
    order = rules.order({"short": (1.0, 0.5), "lines": (0.1, 0.2), "symbols": (0.1, 0.2), "letters": (1.0, 0.0)})
    assert order == ["lines", "symbols", "short", "letters"]
    for text in (None, "", "a b", "a " * 50, "#### " * 30, "word " * 19 + "x", LONG):
        verdicts = {rules.cascade(rules.Measured(text), names) is None for names in (list(rules.RULES), list(rules.RULES)[::-1])}
        assert len(verdicts) == 1


def test_ordinal_grades():
    chance = np.random.default_rng(0)
    x = chance.normal(size=(600, 5))
    y = np.digitize(x[:, 0] + 0.1 * chance.normal(size=600), [-0.7, 0.7])
    weight, thresholds = quality.fit(x, y, 3)
    tails = quality.upper_tails(x @ weight, thresholds)
    assert thresholds[0] < thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()
    assert (np.rint(tails.sum(axis=1)) == y).mean() > 0.85


def test_chat_round_trip_and_mask(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|> <\\\\|", "", "  lead\n", "<", "|x", "héé 日本 😀", None]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(said)] + [(2, 0, None, "x"), (2, 0, "assistant", "y"), (None, None, "assistant", None), (3, 1, "<|text|>", "z")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    path = packing.vocabulary_path("byte_bpe_50k.json")
    for r in chat.format_chats(frame, path).collect():
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]])
        assert chat.read_turns(r["formatted"]) == [(role, text) for _, _, role, text in own]
        spans = np.column_stack((r["starts"], r["ends"]))
        assert [t for t in chat.learned_texts(r["formatted"], spans, np.array(r["mask"], dtype=bool))] == [text for _, _, role, text in own if role == "assistant" and text]
    assert chat.digests(chat.format_chats(frame.where(F.lit(False)), path)).count() == 0


def test_stages_take_any_columns(spark):
    """Helper names of the stages as columns, no n_chars, a third of the rows without id, one id on several texts."""
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " one", passage + " two", "short", "", None, "alpha beta " * 20, "alpha beta " * 20, " ".join(f"b{k}" for k in range(20))]
    names = ["_id", "_key", "_kept", "_rows", "_item", "root", "a", "b", "h", "n", "place", "m", "text_key"]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t, *[k] * len(names)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    benchmark = spark.createDataFrame([(1, texts[-1])], "item_id long, text string")
    cut = repeats.cut_repeats(docs).collect()
    assert len(cut) == len(texts) and {r["_key"]: r["text"] for r in cut} == {k: {0: "one", 1: "two", 5: "", 6: ""}.get(k, t) for k, t in enumerate(texts)}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["_id"] for r in kept.collect()) == list(range(len(texts) - 1))
    alone = keep_smallest(docs, near_copies.near_copies(docs))
    assert alone.columns == docs.columns and sorted(r["_id"] for r in alone.collect()) == [1, 2, 4, 5, 7]
    none = docs.where("1 = 0")
    for out in (repeats.cut_repeats(none), decontaminate.drop_contaminated(none, benchmark), keep_smallest(none, near_copies.near_copies(none))):
        assert out.columns == docs.columns and out.count() == 0


def test_words_of_all_blocks_are_followed_at_once():
    """Same words as from id to id, also for escapes, part blocks and widths that hold few or most ids; no step per id."""
    chance = np.random.default_rng(3)
    for n, block in ((1, 4), (37, 8), (700, 64), (5000, 4096)):
        for most in (2, 300, 49408, 2**32 - 1):
            ids = (chance.integers(0, most, n, dtype=np.uint64, endpoint=True) >> chance.integers(0, 24, n).astype(np.uint64)).astype("<u4")
            for some in (ids, ids.astype(np.uint64) << np.uint64(chance.integers(0, 32))):
                words, starts = token_file.encode(some, block)
                at, first, total = 0, [], 0
                while at < n:
                    if at % block == 0:
                        first.append(total)
                    end = min((at // block + 1) * block, n)
                    fit = next((count for count, bits in token_file.LAYOUT if int(some[at : min(at + count, end)].max()) < 1 << bits), 0)
                    total += 1 if fit else 2
                    at = min(at + fit, end) if fit else at + 1
                assert len(words) == total and starts.tolist() == first
                assert (token_file.decode(words, starts.astype(np.int64), n, block) == some).all()
    taken = np.ones(1 << 20, dtype=np.int32)
    assert len(token_file._heads(np.arange(1 << 20, dtype=np.int32), taken, 256)) == 1 << 20


def test_blanks_beside_a_space_are_seen():
    encoder = tokens.Encoder(packing.vocabulary_path("word_bpe_49k.json"), False)
    for blank in ("\t", "\n", " ", " ", " "):
        assert encoder.pieces(f"a {blank}b") is None and encoder.pieces(f"a{blank} b") is None
    assert encoder.pieces("a b\nc d") == ["a", "b\nc", "d"]
