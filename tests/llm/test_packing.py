"""Best-two-fit: the plan against a sequence-by-sequence version, and whole tables against plain encoding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from salesflow.llm.packing import Places, pack, plan, query
from salesflow.llm.token_files import default_tokenizer

SF = "/root/testdata/sf0.001"


def brute(lengths, capacity):
    """One sequence at a time, one document at a time, over a sorted list."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], capacity
        while (fit := next((x for x in left if x <= gap), None)) is not None:
            left.remove(fit)
            held.append(fit)
            gap -= fit
        if gap and len(held) > 1:
            room = gap + held[-1]
            pairs = [(left[i] + y, left[i], y) for i in range(len(left)) for y in left[i + 1:] if left[i] + y <= room]
            if pairs and max(pairs)[0] > held[-1]:
                _, a, b = max(pairs)
                left += [held.pop()]
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                held += [a, b]
        out.append(tuple(sorted(held, reverse=True)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_the_method(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64])
    lengths = [min(capacity, max(1, int(rng.expovariate(rng.choice([1, 3, 8]) / capacity)))) for _ in range(rng.choice([1, 30, 150]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    got = [tuple(k for k, n in p.lengths for _ in range(n)) for p in plan(counts, capacity) for _ in range(p.times)]
    assert Counter(got) == Counter(brute(lengths, capacity))


def test_two_documents_replace_the_smallest():
    # greedy: 6 + 3, gap 1; 2 + 2 fill it instead of 3
    assert plan(np.bincount([6, 3, 2, 2], minlength=11), 10)[0].lengths == ((6, 1), (2, 2))


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(5)
    counts = np.bincount(rng.integers(1, 257, 5000), minlength=257)
    few, many = plan(counts, 256), plan(counts * 10**9, 256)
    assert len(many) < 3000 and sum(p.times for p in many) <= 1.001 * 10**9 * sum(p.times for p in few)
    assert sum(p.times for p in many) * 256 < 1.01 * 10**9 * int((np.arange(257) * counts).sum())
    number = np.array([0, counts[7] * 10**9 - 1])
    sequence, offset = Places(many).find(np.full(2, 7), number)
    assert (sequence < Places(many).sequences).all() and (offset <= 249).all()


def check(rows, texts, capacity):
    """``texts``: (key, text). Every document is there, piece by piece, and every sequence is without gaps or overlaps."""
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % capacity + 1
        for j, (a, b) in enumerate([(0, head), *((a, a + capacity) for a in range(head, len(ids), capacity))]):
            want[key, j, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = query(spark, SF).collect()
    n = check(rows, texts, 2048)
    total = sum(r.length for r in rows)
    assert n == len(brute([r.length for r in rows], 2048)) and n <= total / 2048 * 1.02 + 1


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, "a b c", 9), (1, "a b c", 9), (1, "other text", 9), (None, None, 9), (None, "x", 9), (4, "", None), (5, "word " * 700, 1),
            (6, "<|endoftext|> b", 0), *[(100 + i, "tie tie", 0) for i in range(50)], (7, "x" * 100_000, 0), (8, "e f " * 400_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").selectExpr("*", "length as uid", "length as number", "text as ids")
    got = pack(df, capacity=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    got = got.collect()
    check(got, [r[:2] for r in rows], 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
