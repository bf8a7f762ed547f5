"""Token files: exact round trip, random access, offsets and edge cases."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from salesflow.llm import encoding, token_files
from salesflow.llm.token_files import CodeFile, default_tokenizer, query, read_tokens, write_codes, write_tokens

SF = "/root/testdata/sf0.001"


def plain(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts, special=True):
    encoder = encoding.encoder_for(default_tokenizer(), special)
    return [ids[a:b].tolist() for _, ids, bounds in encoder.encode_column(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:])]


def test_any_range_of_a_file():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        ids = rng.choice([3, 255, 256, 50_000, 70_000, 2**24 + 5], n).astype(np.uint32)
        out = io.BytesIO()
        write_codes(ids, out)
        codes = CodeFile(out)
        assert codes.n == n
        for _ in range(50):
            a = int(rng.integers(0, n + 1))
            k = int(rng.integers(0, n - a + 1))
            assert codes.ids(a, k).tolist() == ids[a:a + k].tolist()


def test_pieces_do_not_change_the_ids():
    texts = ["", " ", "a", " a b", "a  b", "a \n b", "a  b", "x\n\ny z ", "it's  we'll\t x", "<|endoftext|> a", "é  b  c", "1 2 3", "a\x1c b", "\n a"]
    assert [e + [0] for e in encoded(texts)] == plain(texts)
    rng = random.Random(3)
    parts = [*texts, " ", "  ", "don't", "1", "ñ", "中", " <|endoftext|>", "<|endoftext|>", "\u0301", ".", "\x1c", "\x85", "\ufeff", "\u3000", "\u2581"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    assert [e + [0] for e in encoded(texts)] == plain(texts)


def test_special_strings_are_found_unless_they_are_plain_text():
    assert encoded(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]
    assert 50256 not in encoded(["a <|endoftext|> b"], special=False)[0]


def test_a_worker_remembers_pieces(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_PIECES", 5)
    monkeypatch.setattr(encoding, "RUN_BYTES", 8)
    encoder = encoding.PieceEncoder(*encoding.byte_level(default_tokenizer()))
    for texts in (["a b c"], ["a b c", "d e f g h i"], ["word " * 9, "a b", "d e f g h i"]):
        got = [ids[a:b].tolist() + [0] for _, ids, bounds in encoder.encode_column(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == plain(texts)
    assert len(encoder.known) <= 5


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, {}
    for (k, _), ids in zip(docs, plain([t for _, t in docs])):
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in query(spark, SF).collect()} == want


def test_small_files_nulls_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 20)
    monkeypatch.setattr(encoding, "SLICE_BYTES", 40)
    rows = [(5, "a b c", "x"), (2, None, "y"), (None, "z", "z"), (5, "a b c", "x"), (9, "", None), *[(100 + i, "word " * i, "w") for i in range(20)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, file string")
    index = write_tokens(df, str(tmp_path / "ids"), default_tokenizer())
    got = sorted(read_tokens(index, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc for r in got] == [r[0] for r in want]
    assert [list(r.ids) for r in got] == plain([r[1] for r in want])
    assert [r.start for r in got] == np.cumsum([0, *[r.n for r in got]])[:-1].tolist()
    assert len({r.file for r in got}) > 3
    few = read_tokens(index.where("doc = 110"), str(tmp_path / "ids")).collect()
    assert [list(r.ids) for r in few] == plain(["word " * 10])


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert read_tokens(write_tokens(df, str(tmp_path / "ids"), default_tokenizer()), str(tmp_path / "ids")).collect() == []
