"""Repeated byte strings against a brute-force search."""

import hashlib
import random

import numpy as np
import pytest

from salesflow.llm import suffix_dedup
from salesflow.llm.suffix_dedup import query, remove_repeats, suffix_order

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    """docs: (key, text) with distinct keys, None first."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        out[key] = (len(data), [tuple(e) for e in edges.tolist()], bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def run(spark, docs, length):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, route string, n int")
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, length).collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(3)]
        if rng.random() < 0.7:
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 20):len(p) - rng.randint(0, 60)])
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (None, docs[5][1]), (102, None), (103, ""), (104, "a" * 700), (105, "ab" * 300),
             (106, "a" * 40), (107, docs[7][1] + docs[7][1])]
    return docs


@pytest.mark.parametrize("hot", [50_000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    for seed, length in ((1, 40), (2, 100)):
        docs = corpus(seed)
        assert run(spark, docs, length) == brute(docs, length)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest()) for k, (n, s, kept) in brute(docs, 100).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in query(spark, SF).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, [], 100) == {}
    df = spark.createDataFrame([(1, "x y" * 60), (1, "x y" * 60), (2, "x y" * 60)], "doc_id bigint, text string")
    rows = sorted((r.doc_id, len(r.kept)) for r in remove_repeats(df, 100).collect())
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2] == (2, 0) and 0 < rows[0][1] < 180


def test_suffix_order_on_prefixes():
    rng = random.Random(4)
    for _ in range(200):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 50))], np.int64)
        for need in (4, 20, 100):
            order = suffix_order(s, need)
            cut = [tuple(s[i:i + need]) for i in order]
            assert cut == sorted(cut) and sorted(order) == list(range(len(s)))
