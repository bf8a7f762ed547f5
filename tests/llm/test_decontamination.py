"""Benchmark decontamination against brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pairs import complement, thue_morse

from salesflow.llm import decontamination
from salesflow.llm.decontamination import RADIUS, BlockIndex, find_leaks, query

SF = "/root/testdata/sf0.001"


def grams(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    """(key, item) pairs with a window at weighted similarity 0.8 or more."""
    words = {i: split(t) for i, t in items if len(split(t)) >= 5}
    df = Counter(g for w in words.values() for g in set(grams(w)))
    weight = lambda g: max(1 / df[g], 0.5) if g in df else 1.0
    found = set()
    for k, t in docs:
        w = split(t)
        for i, iw in words.items():
            want = Counter(grams(iw))
            for a in range(len(w) - len(iw) + 1):
                got = Counter(grams(w[a:a + len(iw)]))
                if got.keys() & want.keys():
                    low = sum(weight(g) * min(got[g], want[g]) for g in got | want)
                    high = sum(weight(g) * max(got[g], want[g]) for g in got | want)
                    if low >= 0.8 * high:
                        found.add((k, i))
                        break
    return found


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "ITEM_SHINGLES", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(50, "too few words"), (51, None), (52, "a b c d e " * 4)]
    items.append((53, items[0][1]))
    docs = []
    for k in range(60):
        w = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            copy = rng.choice(items[:30])[1].split()
            for _ in range(rng.randint(0, 1)):
                copy[rng.choice([0, 1, len(copy) // 2, -1])] = word()
            at = rng.randint(0, len(w))
            w[at:at] = [c.upper() for c in copy]
        docs.append((k, rng.choice([" ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (None, items[2][1]), (102, "a b c d e " * 30), (103, items[3][1]), (103, items[3][1])]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()]
    assert set(got) == brute(docs, items) and len(set(got)) > 30


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = {}
    for k, i in brute(docs, items):
        want.setdefault(k, []).append(i)
    got = {r.doc_id: r["items"] for r in query(spark, SF).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_the_index_finds_everything_in_the_radius_and_little_else():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 400, dtype=np.uint64)
    index = BlockIndex(items)
    queries = items[rng.integers(0, 400, 600)]
    for _ in range(RADIUS):
        queries = queries ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    q, item, d = index.near(queries)
    every = np.bitwise_count(queries[:, None] ^ items)
    assert set(zip(q.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(every <= RADIUS))))
    assert (d <= RADIUS).all()
    strangers = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    assert len(index.candidates(strangers)[0]) < 0.05 * 2000 * 400


def test_recall_of_edited_copies(spark):
    """Copies edited to similarities from 0.8 on: at least nine in ten are found (97 % measured), and nothing below 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(45, 120)))) for i in range(60)]
    docs = []
    for k in range(600):
        w = rng.choice(items)[1].split()
        for at in rng.sample(range(len(w)), max(1, round(len(w) * rng.uniform(0.01, 0.035)))):
            w[at] = word()
        docs.append((k, " ".join([word(), *w, word()])))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 200


def test_words_that_polynomials_confuse(spark):
    words = [f"w{i}" for i in range(41)]
    a, b = (" ".join([*words[:20], w, *words[21:]]) for w in (thue_morse(), complement()))
    got = find_leaks(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string"), spark.createDataFrame([(9, a)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]


def test_long_text(spark):
    item = " ".join(f"i{n}" for n in range(30))
    text = "some other words " * 150_000 + item + " and more" * 50_000
    got = find_leaks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 9, 450_000, 1.0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert find_leaks(docs.limit(0), bench).collect() == [] == find_leaks(docs, bench.limit(0)).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in find_leaks(docs, bench).collect()] == [(1, 1, 0, 1.0)]
