"""Repeated phrases against a brute-force count of windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pairs import complement, thue_morse

from salesflow.llm import phrase_dedup
from salesflow.llm.phrase_dedup import query, remove_phrases

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in docs}
    times = Counter(tuple(w[i:i + length]) for w in split.values() for i in range(len(w) - length + 1))
    out = {}
    for k, w in split.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if times[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def run(spark, docs, length):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, route string, n int")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_phrases(df, length).collect()}


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", "\n", "  "]).join(rng.choice(["a", "bb", "é x", "Abc", "d"]) for _ in range(n))
    passages = [text(length + 20).split(" ") for _ in range(3)]
    docs = []
    for i in range(50):
        parts = [text(rng.randint(1, 60)) for _ in range(3)]
        if rng.random() < 0.7:
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), " ".join(p[rng.randint(0, 15):len(p) - rng.randint(0, 15)]))
        docs.append((i, " ".join(parts)))
    return docs + [(100, docs[3][1]), (None, docs[5][1]), (102, None), (103, ""), (104, "a " * 300), (105, "a b " * 50), (106, "a " * (length - 1)),
                   (107, docs[7][1] + " " + docs[7][1])]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(phrase_dedup, "HOT_SPOTS", hot)
    monkeypatch.setattr(phrase_dedup, "SHARD_LETTERS", 500)
    for seed, length in ((1, 14), (2, 35)):
        docs = corpus(seed, length)
        assert run(spark, docs, length) == brute(docs, length)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in brute(docs, 35).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in query(spark, SF).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, [], 35) == {}
    once = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(1, once), (1, once), (2, "x " + once[:60])], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_phrases(df, 35).collect()) == [(1, 0), (1, 0), (2, 0)]


def test_words_that_polynomials_confuse(spark):
    words = [f"w{i}" for i in range(41)]
    docs = [(i, " ".join([*words[:20], w, *words[21:]])) for i, w in enumerate((thue_morse(), complement()))]
    assert run(spark, docs, 35) == brute(docs, 35) and all(v[1] == 0 for v in run(spark, docs, 35).values())


def test_long_text(spark):
    text = " ".join(f"v{i}" for i in range(250_000))
    docs = [(1, text), (2, " ".join(f"v{i}" for i in range(100_000, 100_050)) + " end"), (3, None)]
    got = run(spark, docs, 35)
    assert {k: v[:2] for k, v in got.items()} == {1: (250_000, 50), 2: (51, 50), 3: (0, 0)} and got[2][2] == "end"
