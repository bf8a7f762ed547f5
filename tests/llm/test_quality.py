"""Quality rules: counts against brute force, bands against noise, repetition and running text."""

import base64
import random
import re
from collections import Counter

import pytest
from pairs import complement, thue_morse

from salesflow.llm.quality import Bands, compression_bands, fit_bands, measure, query, rejected_shares

SF = "/root/testdata/sf0.01"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["a", "bb", "é", "中文", "a b", " ", "  ", "\n", "\n\n", "\t", "\r\n", "#", "|x|", "\x0b", "\xa0", "\x85", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", " ", "\n", "x", "same\nsame\nsame ", f"{thue_morse()}\n{complement()}", "word " * 50, "one two three " * 30_000]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, n_words int").repartition(3)
    got = compression_bands(df, Bands()).collect()
    assert sorted(tuple(r[c] for c in COUNTS) for r in got) == sorted(map(brute, texts))
    assert sum(r.doc_id is None for r in got) == sum(i % 7 == 0 for i in range(len(texts)))
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and r.kept == (not r.base_failed and r.in_band)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert {k: tuple(r[c] for c in COUNTS) for k, r in got.items()} == {k: brute(t) for k, t in docs.items()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    judged = [r for k, r in got.items() if k in good and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)       # the bands leave good texts alone


@pytest.fixture(scope="module")
def bands(spark):
    return fit_bands(measure(spark.read.parquet(f"{SF}/documents.parquet")), least_texts=30)


def prose(rng, n):
    syllables = ["an", "the", "ing", "ou", "er", "nd", "ti", "re", "ea", "st", "on", "ha", "es", "ly", "to", "of", "wh", "in"]
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) + rng.choice([" ", " ", " ", ", ", ". "])
    return out


def test_noise_and_repetition_are_out_of_band_and_running_text_is_not(spark, bands):
    rng = random.Random(5)
    noise = [("".join(rng.choice("0123456789abcdef") for _ in range(6000))), base64.b64encode(rng.randbytes(2500)).decode(),
             "".join(chr(rng.randint(33, 126)) for _ in range(3500)), " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(400))]
    repeated = ["the same words again and again. " * 40, prose(rng, 300) * 12]
    mixed = [prose(rng, 2500) + "".join(chr(rng.randint(33, 126)) for _ in range(2500)), prose(rng, 3000) + "line of words. " * 250]
    clean = [prose(rng, n) for n in (300, 500, 900, 1500, 3000, 6000, 12000) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(noise + repeated + mixed + clean)), "doc_id bigint, text string")
    bad = range(len(noise + repeated + mixed))
    fitted = {r.doc_id: r.in_band for r in compression_bands(df, bands).collect()}
    assert not any(fitted[k] for k in bad)
    assert sum(fitted[k] for k in fitted if k not in bad) >= 0.9 * len(clean)
    default = {r.doc_id: r.in_band for r in compression_bands(df, Bands()).collect()}   # wider: hex and spaced noise pass
    assert not any(default[k] for k in (1, 2, 4, 5, 6, 7)) and all(default[k] for k in default if k not in bad)


def test_bands_are_fitted_by_length_on_all_texts(spark, bands):
    assert len(bands.limits) > 6 and all(low < high for _, low, high in bands.limits)
    some = {k: (low, high) for k, low, high in bands.limits}
    assert some[24][0] > some[18][0]            # longer texts compress better
    shares = rejected_shares(query(spark, SF)).collect()
    assert sum(r.n_texts for r in shares) == 1000 and sum(r.n_out_of_band for r in shares) > 0
    assert fit_bands(measure(spark.createDataFrame([], "doc_id bigint, text string"))) == Bands()


def test_every_byte_is_in_a_chunk(spark):
    texts = ["x" * n for n in (0, 1, 1023, 1024, 1025, 1279, 1280, 1281, 2048, 5000)]
    rows = measure(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(sum(c["size"] for c in r.chunks) == r.n_bytes == len(texts[r.doc_id]) for r in rows)
    assert {r.n_bytes: len(r.chunks) for r in rows} == {0: 0, 1: 1, 1023: 1, 1024: 1, 1025: 1, 1279: 1, 1280: 1, 1281: 2, 2048: 2, 5000: 5}


def test_empty_table(spark):
    assert compression_bands(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
