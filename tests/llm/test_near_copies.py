"""The near-duplicate stage against brute-force Jaccard; survivors where ids are null or repeated."""

import random

from tradeloom.llm import near_copies, simhash
from tradeloom.llm.common import finish, keep_smallest, step

SAME = " ".join(f"s{k}" for k in range(60))


def _grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _groups(texts):
    grams = [_grams(t) for t in texts]
    left, groups = set(range(len(texts))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if len(grams[a] & grams[b]) * 5 >= 4 * len(grams[a] | grams[b])}
            left -= near
            todo += near
        groups.append(frozenset(group))
    return set(groups)


def test_components_are_brute_force_jaccard(spark, monkeypatch):
    chance, texts = random.Random(7), [None, "", " \n", "one two", "One  two", "one two three four five six"]
    for base in range(8):
        words = [f"b{base}w{k}" for k in range(chance.randrange(12, 120))]
        for _ in range(9):
            own = list(words)
            for _ in range(chance.randrange(5)):
                own[chance.randrange(len(own))] = f"x{chance.random()}"
            texts.append(" ".join(own[: len(own) - chance.randrange(9)]))
    texts += [SAME + " " + " ".join(f"t{k}v{j}" for j in range(chance.randrange(4, 60))) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _groups(texts)
    assert any(1 < len(g) < 9 for g in want)
    for short, page in ((32, 256), (2, 4)):
        monkeypatch.setattr(near_copies, "SHORT", short)
        monkeypatch.setattr(near_copies, "PAGE", page)
        found = {}
        for r in near_copies.near_copies(docs).collect():
            found.setdefault(r["root"], set()).add(r["doc_id"])
        assert {frozenset(g) for g in found.values()} == want
    none = near_copies.near_copies(docs.where("1 = 0"))
    assert none.count() == 0 and keep_smallest(docs.where("1 = 0"), none).count() == 0


def test_near_copies_beyond_four_bits_go(spark):
    chance = random.Random(8)
    words = [f"w{chance.randrange(10**6)}" for _ in range(240)]
    texts = [" ".join(words), " ".join(words[:100] + ["other"] + words[101:200] + ["word"] + words[201:])]
    texts.append(" ".join(words[20:] + [f"e{k}" for k in range(10)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(_groups(texts)) == 1 and len({simhash.fingerprint(t.encode()) for t in texts}) == 3
    assert [r["doc_id"] for r in keep_smallest(docs, near_copies.near_copies(docs)).collect()] == [0]


def test_survivors_by_component_not_by_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, c), (7, c), (7, d), (7, d), (8, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(0, a), (0, b), (7, c), (7, d)])
    for kept in (simhash.keep_one(docs), keep_smallest(docs, near_copies.near_copies(docs))):
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == want


def test_counts_never_rule_out_a_similar_pair():
    chance = random.Random(9)
    for _ in range(300):
        n = chance.choice([1, 3, 20, 400, 40000])
        a = [f"w{chance.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(chance.randrange(1 + n // 30)):
            b[chance.randrange(n)] = "other"
        x, y = (near_copies.shingles(" ".join(t).encode()) for t in (a, b[chance.randrange(1 + n // 20) :]))
        if near_copies.similar(x, y):
            assert near_copies.possible(len(x), near_copies.counts(x), len(y), near_copies.counts(y))
    x, y = (near_copies.shingles(" ".join(f"{c}{k}" for k in range(300)).encode()) for c in "ab")
    assert not near_copies.possible(len(x), near_copies.counts(x), len(y), near_copies.counts(y))


def test_a_finished_stage_leaves_only_its_result(spark):
    from pathlib import Path

    from tradeloom.session import shared_folder

    folder = Path(shared_folder(spark))
    before = {p.name for p in folder.iterdir()}
    out = finish(lambda: step(step(spark.range(7), "inner-one"), "inner-two").where("id > 2"), "stage-result")
    assert sorted(r.id for r in out.collect()) == [3, 4, 5, 6]
    assert [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before] == ["stage"]


def test_marks_rule_out_only_what_is_not_similar():
    chance = random.Random(10)
    for _ in range(300):
        n = chance.choice([1, 3, 20, 400, 40000])
        a = [f"w{chance.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(chance.randrange(1 + n // 30)):
            b[chance.randrange(n)] = "other"
        x, y = (near_copies.shingles(" ".join(t).encode()) for t in (a, b[chance.randrange(1 + n // 20) :]))
        if near_copies.similar(x, y):
            assert near_copies.agreeable(len(x), near_copies.marks(x), len(y), near_copies.marks(y))
    words = [f"w{chance.randrange(10**6)}" for _ in range(6000)]
    x, y = (near_copies.shingles(" ".join(words[:5000] + words[a:b]).encode()) for a, b in ((5000, 6000), (0, 0)))
    z = near_copies.shingles(" ".join(words[1200:] + [f"v{k}" for k in range(1200)]).encode())
    assert near_copies.similar(x, y) and not near_copies.similar(x, z)
    assert near_copies.possible(len(x), near_copies.counts(x), len(z), near_copies.counts(z))
    assert not near_copies.agreeable(len(x), near_copies.marks(x), len(z), near_copies.marks(z))


def test_simhash_links_come_first(spark, monkeypatch):
    """The index of fingerprints gives links; the lists need not find them again."""
    words = [f"w{k * 7919 % 10007}" for k in range(900)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words + ["more"])), (2, " ".join(words[::-1]))], "doc_id long, text string")
    prints = [simhash.majority(simhash.shingle_hashes(r["text"].encode(), near_copies.SHINGLE)) for r in docs.collect()]
    assert prints[0] != prints[1] and (prints[0] ^ prints[1]).bit_count() <= simhash.MOST
    monkeypatch.setattr(near_copies, "prefix", lambda own, frequent: own[:0])
    roots = {r["doc_id"]: r["root"] for r in near_copies.near_copies(docs).collect()}
    assert roots[0] == roots[1] != roots[2]


def test_stages_leave_only_their_small_results(spark):
    from pathlib import Path

    import corpus_pipeline
    from tradeloom.session import shared_folder

    folder = Path(shared_folder(spark))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(0, text), (1, text + " more"), (2, None), (3, text[::-1])], "doc_id long, text string")
    for stage, left in ((corpus_pipeline.near_duplicates, "near-copies"), (corpus_pipeline.substrings, "changed-texts")):
        before = {p.name for p in folder.iterdir()}
        stage(spark, docs, "").count()
        assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before} <= {left, "edges"}


def test_what_travels_at_once_follows_the_sets(spark, monkeypatch):
    """Lists are made in rounds, pairs and units followed in slices; the components stay those of brute force."""
    chance, texts, names = random.Random(11), [], []
    for base in range(6):
        words = [f"b{base}w{k}" for k in range(chance.randrange(30, 90))]
        for _ in range(9):
            own = list(words)
            for _ in range(chance.randrange(6)):
                own[chance.randrange(len(own))] = f"x{chance.random()}"
            texts.append(" ".join(own))
    texts += [SAME + " " + " ".join(f"t{k}v{j}" for j in range(chance.randrange(4, 30))) for k in range(12)]
    for name, value in {"SHORT": 2, "PAGE": 4, "ROUNDS": 3, "PAIRS": 0.1, "COUNTED": 0.5, "HELD": 0.1}.items():
        monkeypatch.setattr(near_copies, name, value)
    monkeypatch.setattr(near_copies, "step", lambda df, name: names.append(name) or step(df, name))
    found = {}
    for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(r["root"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in found.values()} == _groups(texts)
    assert names.count("lists") == 3 and min(names.count(x) for x in ("pairs-by-counts", "links", "unit-members", "unit-links")) > 1
