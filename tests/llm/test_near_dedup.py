"""Near-duplicate classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pairs import complement, thue_morse

from salesflow.llm import near_dedup
from salesflow.llm.components import components
from salesflow.llm.near_dedup import _apart, linked_members, near_duplicates, one_of_each, query

SF = "/root/testdata/sf0.001"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """docs: (key, text), keys distinct; returns key -> (set size, component)."""
    keys, sets = [k for k, _ in docs], [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    low = lambda k: (k is not None, k)
    best = {}
    for i, k in enumerate(keys):
        best[find(i)] = min(best.get(find(i), k), k, key=low)
    return {k: (len(sets[i]), best[find(i)]) for i, k in enumerate(keys)}


def run(spark, docs):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, root string, sid int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    docs, passage = [], [word() for _ in range(40)]
    for base in range(6):
        text = [word() for _ in range(rng.choice([6, 8, 30, 120, 400]))]
        for _ in range(12):   # chains of edits around the threshold
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = word()
            text = copy if rng.random() < 0.5 else text
            docs.append(" ".join(copy))
    docs += [" ".join([*[word() for _ in range(80)], *passage, *[word() for _ in range(30)]]) for _ in range(20)]
    docs += ["a b c d", "A b  c\nd", "a b c", "", None, "x " * 50, "x " * 80, docs[0].upper(), "a b c d e", "a b c d e f"]
    rng.shuffle(docs)
    return [*enumerate(docs), (None, docs[0])]


@pytest.mark.parametrize("block,sketch", [(1 << 19, 128), (200, 128), (500, 64)])
def test_against_brute_force(spark, monkeypatch, block, sketch):
    monkeypatch.setattr(near_dedup, "BLOCK_VALUES", block)
    monkeypatch.setattr(near_dedup, "SKETCH", sketch)
    if sketch == 64:
        monkeypatch.setattr(near_dedup, "LEAST_ESTIMATE", 0.6)
    for seed in (1, 2):
        docs = corpus(seed)
        assert run(spark, docs) == brute(docs)


def test_members_of_a_cell(monkeypatch):
    """Links of a cell join what brute force joins, and are a forest."""
    rng = np.random.default_rng(4)
    for sketch in (128, 20):
        monkeypatch.setattr(near_dedup, "SKETCH", sketch)
        monkeypatch.setattr(near_dedup, "LEAST_ESTIMATE", 0.0 if sketch == 20 else 0.7)
        for _ in range(20):
            base = rng.integers(0, 2**62, 60)
            sets = [np.unique(np.append(base[rng.random(60) < rng.choice([0.8, 0.95, 0.99])], rng.integers(0, 2**62, rng.integers(0, 6)))) for _ in range(30)]
            side = rng.integers(0, 3, 30) if rng.random() < 0.5 else np.zeros(30, int)
            links = linked_members(sets, list(range(30)), side.tolist(), 85)
            root = list(range(30))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i in range(30):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and not (side[i] and side[i] == side[j]):
                        root[find(i)] = find(j)
            want = {frozenset(k for k in range(30) if find(k) == find(i)) for i in range(30)}
            assert len(links) == 30 - len(want)
            got = list(range(30))
            for a, b in links:
                got = [got[a] if x == got[b] else x for x in got]
            assert {frozenset(k for k in range(30) if got[k] == got[i]) for i in range(30)} == want


def test_a_group_whose_members_are_just_not_linked(spark, monkeypatch):
    """Hundreds of texts at similarities around 0.75 to one another: no links but the planted ones."""
    rng = random.Random(9)
    base, docs = [f"w{i}" for i in range(150)], []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(0, 150, 6), 4):
            copy[at] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(copy))
    docs += [docs[5] + " one more", docs[77] + " y z"]
    got = run(spark, list(enumerate(docs)))
    assert got == brute(list(enumerate(docs))) and got[300][1] == 5 and got[301][1] == 77 and len({c for _, c in got.values()}) > 250


def test_words_that_polynomials_confuse(spark):
    words = [f"w{i}" for i in range(41)]
    docs = [(i, " ".join([*words[:20], w, *words[21:]])) for i, w in enumerate((thue_morse(), complement()))]
    assert run(spark, docs) == brute(docs) == {0: (37, 0), 1: (37, 1)}


def test_long_text(spark):
    text = " ".join(f"v{i * 7919 % 1_000_003}" for i in range(300_000))
    docs = [(1, text), (2, text[:-40] + " changed"), (3, text[:len(text) // 2])]
    assert {k: c for k, (_, c) in run(spark, docs).items()} == {1: 1, 2: 1, 3: 3}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: (*v, k == v[1]) for k, v in brute(docs).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in query(spark, SF).collect()}
    assert got == want and not all(v[2] for v in got.values())


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(3, 3), (3, 3), (5, 3)]


def test_one_row_of_each_class_stays(spark):
    long = "one two three four five six seven eight nine ten " * 4
    rows = [(1, "one two", "s"), (1, "totally other", "s"), (2, "Totally  other", "s"), (3, None, "a"), (3, None, "b"), (4, "", "a"), (None, "one two", "z"),
            (5, long + "a b", "y"), (5, long + "a b", "x"), (6, long + "a b", "w"), (7, long + "a c", "w"), (7, "", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r) for r in one_of_each(df).collect()), key=str)
    assert got == sorted([rows[1], rows[3], rows[4], rows[5], rows[6], rows[8], rows[10], rows[11]], key=str)
    assert one_of_each(df.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id * 7 % 307 as a", "(id + 1) * 7 % 307 as b").union(spark.createDataFrame([(900, 901), (901, 902)], "a bigint, b bigint"))
    got = {r.id: r.root for r in components(edges).collect()}
    assert {v for k, v in got.items() if k < 900} == {0} and got[902] == 900 and len(got) == 304


def test_lists_with_the_same_members_are_compared_once(spark):
    entries = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 10, 5), (2, 11, 6), (3, 10, 5), (3, 12, 7), (4, 13, 9)], "list bigint, sid bigint, n bigint")
    roots = spark.createDataFrame([], "id bigint, root bigint")
    assert sorted(tuple(r) for r in _apart(entries, roots)[1].collect()) == [(1, 11), (3, 12)]
    joined = spark.createDataFrame([(10, 10), (11, 10)], "id bigint, root bigint")
    assert sorted(tuple(r) for r in _apart(entries, joined)[1].collect()) == [(3, 12)]
