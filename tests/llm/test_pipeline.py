"""The pipeline, stage by stage, against brute force; and the schedule of the mix."""

import sys
import zlib
from collections import Counter
from math import ceil, floor
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from salesflow.llm import mixing, toxicity
from salesflow.session import materialize
from test_decontamination import brute as leaks
from test_near_dedup import brute as classes
from test_token_files import plain

SF = "/root/testdata/sf0.001"


def edf(weights, blocks):
    """Slots of every block by simulation: release floor(j Q / w), deadline ceil((j + 1) Q / w)."""
    q, done, slots, t = sum(weights.values()), Counter(), {}, 0
    while any(done[s] < blocks[s] for s in weights):
        ready = [(ceil((done[s] + 1) * q / w), s) for s, w in sorted(weights.items()) if floor(done[s] * q / w) <= t]
        s = min(ready)[1]
        slots[s, done[s]] = t
        done[s] += 1
        t += 1
        assert all(abs(done[x] - t * w / q) < 1 for x, w in weights.items())
    return slots


def test_schedule_is_the_simulated_one(spark):
    rows = [(i, "x" * (i * 37 % 90), "abc"[i % 3]) for i in range(120)] + [(500, None, None), (501, "y" * 45, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = {"": 1, "a": 5, "b": 3, "c": 2}
    table = spark.createDataFrame([(k or None, w) for k, w in weights.items()], "source string, weight int")
    got = mixing.schedule(docs, table, block_chars=40).collect()
    blocks = Counter()
    for r in got:
        blocks[r.source or ""] = max(blocks[r.source or ""], r.block + 1)
    slots = edf(weights, blocks)
    assert len(got) == len(rows) and all(r.slot == slots[r.source or "", r.block] for r in got)
    before = Counter()
    for k, t, s in sorted(rows):
        r = next(x for x in got if x.doc_id == k)
        assert r.block == before[s] // 40
        before[s] += len(t or "")


def test_schedule_without_weight_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (2, "b", "b")], "doc_id bigint, text string, source string")
    table = spark.createDataFrame([("a", 2), ("b", 0)], "source string, weight int")
    assert sorted((r.doc_id, r.slot) for r in mixing.schedule(docs, table).collect()) == [(1, 0), (2, None), (2, None)]
    assert mixing.schedule(docs.limit(0)).collect() == []


def test_schedule_ignores_other_columns(spark):
    docs = spark.createDataFrame([(i, "x" * 9, "ab"[i % 2]) for i in range(9)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.schedule(docs, block_chars=20).collect()))
    clash = docs.selectExpr("*", "7 as slot", "'q' as weight", "1 as block", "2 as chars", "3 as w", "4 as turn", "'k' as key", "5 as before")
    assert sorted(map(tuple, mixing.schedule(clash, block_chars=20).collect())) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF))
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.severity(spark.read.parquet(f"{SF}/documents.parquet"), model).where("toxic").collect()}
    assert kept["toxicity"].keys() == start.keys() - bad
    assert kept["near_dedup"].keys() == {k for k, (_, c) in classes(list(kept["toxicity"].items())).items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept["decontamination"].keys() == kept["near_dedup"].keys() - {k for k, _ in leaks(list(kept["near_dedup"].items()), items)}
    assert kept["mixing"] == kept["decontamination"]

    slots = {r.doc_id: (r.slot, r.source) for r in mixing.schedule(docs).collect()}
    order = sorted(slots, key=lambda k: (*slots[k], k))
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    at, want = 0, {}
    for k, ids in zip(order, plain([kept["mixing"][k] for k in order])):
        want[k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in final} == want
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, final))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0)]])
def test_stages_on_empty_and_null_rows(spark, rows):
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == len(rows)


def test_an_id_with_two_texts_is_two_documents(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "totally other words are in this one", "en", "b", 2), (2, "one two  three four five six", "en", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.text[:3] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == ["one", "tot"]
    mixed = materialize(corpus_pipeline.mix_sources(spark, materialize(corpus_pipeline.drop_near_copies(spark, docs, SF)), SF))
    assert mixed.count() == 2 and corpus_pipeline.write_tokens(spark, mixed, SF).count() == 2
