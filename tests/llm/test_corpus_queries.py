"""Corpus queries against their SQL, or against brute force where SQL cannot state them, on the smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from tradeloom.llm.packing import vocabulary_path
from tradeloom.llm.queries import ORACLE, QUERIES

SF_DIR = f"{compare.ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, con, name):
    assert not compare.compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)


def test_simhash_brute_force(spark, texts):
    rows = QUERIES["op6_simhash"](spark, SF_DIR).collect()
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                low = min(component[a], component[b])
                if (prints[a] ^ prints[b]).bit_count() <= 4 and component[a] + component[b] != 2 * low:
                    component[a] = component[b] = low
                    changed = True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", component[i]) for i, f in prints.items()}


def _ids(name, texts, end):
    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4") for i, t in texts.items()}


def test_packing_is_whole_and_dense(spark, texts):
    rows = QUERIES["op4_packing"](spark, SF_DIR).collect()
    ids, seen, filled = _ids("byte_bpe_50k.json", texts, 1), {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        seen[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : seen[r["doc_id"]]].tobytes())
    assert seen == {i: len(v) for i, v in ids.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert sum(filled.values()) >= 0.95 * 2048 * len(filled)


def test_token_files_round_trip(spark, texts):
    rows = sorted(QUERIES["op9_token_file"](spark, SF_DIR).collect(), key=lambda r: r["doc_id"])
    ids, at = _ids("word_bpe_49k.json", texts, 2), 0
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_classifiers_on_held_out_rows(spark, con):
    toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    quality = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    scored = QUERIES["op1_toxicity"](spark, SF_DIR).collect()
    assert len(scored) == len(lang) and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert not any(r["predicted"] for r in scored if toxic.get(r["doc_id"]) == 0)
    graded = QUERIES["op2_quality"](spark, SF_DIR).collect()
    right = [r["kept"] == (quality[r["doc_id"]] == 1) for r in graded if r["held_out"] and r["doc_id"] in quality]
    assert len(graded) == len(lang) and sum(right) >= 0.8 * len(right)
    named = QUERIES["op3_language"](spark, SF_DIR).collect()
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in named if r["held_out"] and lang[r["doc_id"]]]
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in named) and sum(right) >= 0.95 * len(right)


def test_pipeline_stages(spark, con, texts):
    """Every stage against what it must have decided on its own input."""
    docs, columns = spark.read.parquet(f"{SF_DIR}/documents.parquet"), None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        before = docs.select("doc_id", "text").collect()
        docs = corpus_pipeline.step(stage(spark, docs, SF_DIR), f"test-{name}")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns and {r["doc_id"] for r in kept[name][1]} <= {r["doc_id"] for r in before}
    toxic = {i for (i,) in con.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    assert toxic <= {r["doc_id"] for r in kept["toxicity"][1]}
    assert len(kept["near_duplicates"][1]) < len(kept["near_duplicates"][0])
    own = duckdb.connect()
    for name, key in (("substrings", "op10_substring"), ("decontamination", "op8_decontamination")):
        import pandas as pd

        frame = pd.DataFrame([(r["doc_id"], r["text"]) for r in kept[name][0]], columns=["doc_id", "text"])
        own.register("documents", frame)
        own.register("benchmark", con.execute("SELECT * FROM benchmark").df())
        want = own.execute(ORACLE[key]).df().set_index("doc_id")
        got = {r["doc_id"]: r["text"] for r in kept[name][1]}
        if name == "substrings":
            assert {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in got.items()} == want.kept_sha256.to_dict()
        else:
            assert set(got) == set(want.index[~want.contaminated])
    assert {r["doc_id"] for r in kept["packing"][1]} == {r["doc_id"] for r in kept["packing"][0]}
