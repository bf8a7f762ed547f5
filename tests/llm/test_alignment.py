"""Alignment of two tokenizers against a token-by-token version."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from salesflow.llm import alignment
from salesflow.llm.alignment import align_tokenizers, aligned_blocks, pair_counts, query

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table():
    """The bytes that a byte-level entry's characters stand for, as published for this kind of vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    tokenizer, model, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    tokenizer.encode_special_tokens = True
    entry = {i: bytes(table.get(c, 0) for c in t) for t, i in tokenizer.get_vocab().items()}
    out, held, count = [], [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a = [(i, entry[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, model.id_to_piece(i)) for i in model.encode(text))]
            if not (b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()):
                a, b = [], []
        i, j, end_a, end_b, now = 0, 0, 0, 0, ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            x, y = end_a + len(a[i][1]), end_b + len(b[j][1])
            if x <= y:
                now[0].append(a[i][0])
            if y <= x:
                now[1].append(b[j][0])
            if x == y:
                groups.append(",".join(map(str, now[0])) + "|" + ",".join(map(str, now[1])))
                now = ([], [])
            i, end_a = (i + 1, x) if x <= y else (i, end_a)
            j, end_b = (j + 1, y) if y <= x else (j, end_b)
        count.update(set(links))
        held.append(links)
        out.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(*row[:4], sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), row[4]) for row, links in zip(out, held)], count


TEXTS = ["Hello world, hello wörld", None, "", " ", "a", "  two  spaces ", "tab\there\n\nnew line", "<|endoftext|> and <s> </s> <unk> <0x41>",
         "▁ is a mark", "a ▁b c", "x▁", "日本語 と 中文 😀 ñandú", "it's  we'll 1234 56", "á é", " x 　y", "the same words", "the same words",
         "the same words again " * 50, "x" * 5000, "a b \x00 c", "ﬁ Ａ ½"]


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = [(i if i != 5 else None, t, 1) for i, t in enumerate(TEXTS)] + [(3, "the same words", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int").selectExpr("*", "text as a", "text as groups").repartition(3)
    want, count = brute([t for _, t, _ in rows])
    assert got(align_tokenizers(df)) == sorted(((k, *w) for (k, _, _), w in zip(rows, want)), key=str)
    pairs = pair_counts(aligned_blocks(df, A, B)).collect()
    assert {(r.a, r.b): r.docs for r in pairs} == count and len(pairs) == len(count)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = brute([t for _, t in docs])
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in query(spark, SF).collect()}
    assert rows == {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (k, _), w in zip(docs, want)}


def test_long_text_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1 << 16)
    texts = ["long words follow each other and on " * 40_000, "short words", "y " * 100_000 + "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, _ = brute(texts)
    assert got(align_tokenizers(df)) == sorted(((k, *w) for k, w in enumerate(want)), key=str)


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
