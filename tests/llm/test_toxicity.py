"""Ordinal severity: held-out accuracy, monotone severity, edge cases."""

import re

import numpy as np
from pyspark.sql import functions as F
from test_textops import plain as plain_hash

from salesflow.llm.textops import mixed
from salesflow.llm.toxicity import FEATURE_BITS, PREFIXES, Model, fit, fit_ordinal, query, reject, severity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    model = fit(docs, labels.join(held, "doc_id", "left_anti"))
    got = severity(docs, model).join(held.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    bad = [r for r in got if r.truth == 1]
    fine = [r for r in got if r.truth == 0]
    assert len(bad) > 50 and sum(r.toxic for r in bad) >= 0.85 * len(bad)   # some 300 toxic training rows only
    assert sum(r.toxic for r in fine) <= 0.015 * len(fine)
    assert np.mean([r.severity for r in bad]) > 1 > 0.2 > np.mean([r.severity for r in fine])
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)


def test_recovers_an_ordinal_model():
    rng = np.random.default_rng(3)
    n, true = 4000, np.array([2.0, -1.0, 0.5])
    x = rng.random((n, 3)) < 0.5
    latent = x @ true + rng.logistic(size=n)
    grade = np.digitize(latent, [0.0, 1.0, 2.5])
    w, t = fit_ordinal(*np.nonzero(x), grade, 3)
    assert np.abs(w - true).max() < 0.25 and np.abs(t - [0.0, 1.0, 2.5]).max() < 0.25


def test_one_row_per_document_and_rejects(spark):
    out = query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count() and 0 < out.where("toxic = 'true'").count() < 0.3 * docs.count()
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("toxic = 'false'").count()


def test_nulls_repeats_and_missing_classes(spark):
    rows = [(i, f"w{i % 7} awful w{i % 5}" if i % 2 else f"w{i % 7} w{i % 5}", "k") for i in range(60)] + [(None, None, None), (99, "", "k"), (1, "awful", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(60)], (None, 1), (5, None), (5, 1)], "doc_id bigint, toxic int")
    got = severity(docs, fit(docs, labels))
    assert got.count() == len(rows) and [r.toxic for r in got.where("doc_id = 1").collect()] == [True, True]
    assert {r.toxic for r in got.where("doc_id is null or doc_id = 99 or doc_id = 2").collect()} == {False}
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        assert severity(docs, fit(docs, few)).where("toxic").count() == 0
    assert severity(docs.limit(0), fit(docs, labels)).collect() == []
    assert isinstance(fit(docs.limit(0), labels), Model)


def plain_features(text):
    """Feature numbers of a text, word by word: the word and its first 4, 5 and 6 bytes."""
    marks = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").translate(str.maketrans(marks, " " * len(marks)))
    out = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", lower):
        w = w.encode()
        for h in [plain_hash(w), *[(plain_hash(w[:k]) + (k << 40)) % 2**64 for k in PREFIXES]]:
            out.add(int(mixed(np.array([h], np.uint64))[0]) >> (64 - FEATURE_BITS))
    return out


def test_scores_word_by_word(spark):
    rng = np.random.default_rng(6)
    model = Model(np.where(rng.random(1 << FEATURE_BITS) < 0.5, rng.normal(size=1 << FEATURE_BITS), 0.0), np.array([0.3, 1.0, 2.5]))
    texts = ["Some words, some WORDS!", "x", "", None, "ünï(code) don't éé", "a b c d e f g " * 3, "long " * 300_000 + "end", " \x0b\n- "]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, severity double")
    for r in severity(df, model).collect():
        score = sum(model.weights[f] for f in plain_features(texts[r.doc_id]))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        grades = -np.diff([1.0, *above, 0.0])
        assert np.isclose(r.severity, sum(above)) and np.isclose(r.probability, above[0])
        assert r.grade == int(np.argmax(grades)) and r.toxic == (above[0] >= 0.5)
