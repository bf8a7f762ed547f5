"""Ranked search against scoring every document, and against the check SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from check import compare, duck, passed
from salesflow.llm import lexical_search
from salesflow.llm.lexical_search import best_documents, index_documents, search

SF = "/root/testdata/sf0.001"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    bags = [(key, Counter(terms(t))) for key, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for key, bag in bags:
            m = 100 - 75 + (75 * bag.total() * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            scored += [(-score, key is not None, key or 0, key)] if score > 0 else []
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("segment,block", [(1 << 24, 1 << 18), (300, 20)])
def test_against_scoring_every_document(spark, monkeypatch, segment, block):
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, docs[3][1]), (None, None), (7, docs[7][1]), (7, "w1 w2 W3"), (900, ""), (901, "Zoë's naïve-test: 日本 x_y W1!"), (902, "\x00\x7f ~"), (903, "w5 " * 30000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(None, "w1 w2 w2"), (3, None), (4, ""), (5, "no such term here"), (5, "ZOË 日本 w1"), (6, "w1"), (6, "w1"), (8, "w5 " * 50)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, term string, query int").repartition(3)
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    for k in (1, 4, 10):
        assert got(search(index_documents(df), it, k)) == brute(docs, items, k)


def test_accumulators_stop_and_survivors_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        weights = sorted(rng.integers(1, 50, int(rng.integers(1, 7))).tolist(), reverse=True)
        lists = [(place := np.flatnonzero(rng.random(n) < rng.random()), rng.integers(1, 9, len(place))) for _ in weights]
        total = np.zeros(n, np.int64)
        for w, (place, adds) in zip(weights, lists):
            total[place] += w * adds
        least = int(rng.choice([0, 40]))
        found, scores = best_documents(weights, [w * int(a.max(initial=0)) for w, (_, a) in zip(weights, lists)], lists, n, k, least)
        assert (total[found] == scores).all()
        wanted = [i for i in sorted(range(n), key=lambda i: (-total[i], i))[:k] if total[i] > 0 and total[i] >= least]
        assert set(wanted) <= set(found.tolist())


def test_common_terms_create_no_accumulators():
    rare, common = (np.array([3]), np.array([9])), (np.arange(1000), np.ones(1000, np.int64))
    found, scores = best_documents([100, 1], [900, 1], [rare, common], 1000, 1, 0)
    assert found.tolist() == [3] and scores.tolist() == [901]


def test_matches_check_sql(spark):
    verdict = compare(spark, duck(SF), "op11_lexical_search", SF)
    assert passed(verdict) and verdict.startswith("ok"), verdict


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert got(search(index_documents(docs), items)) == []
    assert got(search(index_documents(full), items.limit(0))) == []
    assert len(got(search(index_documents(full), items))) == 1
