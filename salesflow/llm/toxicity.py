"""Toxicity: cumulative-link ordinal regression over sparse word features, with expected severity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.tables import table
from salesflow.llm.textops import LOWER, mixed, range_hash, slices, words
from salesflow.session import materialize

FEATURE_BITS = 20
PREFIXES = (4, 5, 6)   # bytes
TRAIN_ROWS = 20_000    # most labelled rows that the model is fitted on, chosen by the hash of their id
GRADES = 4             # 0 clean, 1 to 3 toxic with more and more marks
LEAST_Z = 3.0          # standard deviations by which a word must prefer a class to become a feature
LEAST_ROWS = 3         # training rows that must hold it
STEPS, RATE, SHRINK = 400, 0.1, 1e-4

_TRAINING = "key bigint, toxic int, words array<int>"
_AS_SPACE = LOWER.copy()
_AS_SPACE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


@dataclass
class Model:
    """weights per feature (most are 0) and rising thresholds: P(grade <= k) = sigmoid(thresholds[k] - weights x)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected severity, most probable grade, probability of any toxic grade."""
        above = self.above(score)
        edges = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
        return above.sum(axis=1), np.argmax(edges[:, :-1] - edges[:, 1:], axis=1), above[:, 0]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all rows and index of each row's first one: every word and its beginnings of PREFIXES bytes.

    Case (A-Z) and ASCII punctuation don't count. A beginning differs from a word that is spelled the same.
    """
    plain = _AS_SPACE[data]
    start, end, first = words(plain, offsets)
    hashed = range_hash(plain)
    columns = [hashed(start, end), *[hashed(start, np.minimum(start + k, end)) + np.uint64(k << 40) for k in PREFIXES]]
    return (mixed(np.stack(columns, axis=1).ravel()) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), first * len(columns)


def _score_rows(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the distinct features of every row."""
    out = np.zeros(len(column))
    for lo, hi, data, offsets in slices(column):
        feature, first = _features(data, offsets)
        at = np.flatnonzero(weights[feature])
        row = np.searchsorted(first, at, side="right") - 1
        pairs = np.unique(row * len(weights) + feature[at])
        out[lo:hi] = np.bincount(pairs // len(weights), weights=weights[pairs % len(weights)], minlength=hi - lo)
    return out


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a proportional-odds model with binary features, by full-batch Adam.

    ``row`` and ``feature`` list the features that are present; all thresholds share the weights.
    """
    n, k = len(grade), GRADES - 1
    share = np.array([(np.count_nonzero(grade <= j) + 0.5) / (n + 1) for j in range(k)])
    logit = np.log(share / (1 - share))
    # gaps between thresholds are kept positive by their logarithm
    p = np.concatenate([np.zeros(size), [logit[0]], np.log(np.maximum(np.diff(logit), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        w, gaps = p[:size], np.exp(p[size + 1:])
        theta = np.concatenate([[p[size]], p[size] + np.cumsum(gaps)])
        score = np.bincount(row, weights=w[feature], minlength=n)
        upto = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -40, 40)))
        edges = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        hit = np.arange(n)
        prob = np.maximum(edges[hit, grade + 1] - edges[hit, grade], 1e-12)
        slope = edges * (1 - edges)
        hi, lo = slope[hit, grade + 1] / prob, slope[hit, grade] / prob
        by_theta = np.zeros((n, GRADES + 1))
        by_theta[hit, grade + 1] += hi
        by_theta[hit, grade] -= lo
        g_theta = by_theta[:, 1:-1].mean(axis=0)
        g = np.concatenate([np.bincount(feature, weights=(lo - hi)[row], minlength=size) / n, [g_theta.sum()],
                            [g_theta[j + 1:].sum() * gaps[j] for j in range(k - 1)]])
        g[:size] -= SHRINK * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:size], np.concatenate([[p[size]], p[size] + np.cumsum(np.exp(p[size + 1:]))])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, class and distinct features of every row."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            feature, first = _features(data, offsets)
            lists = [np.unique(feature[first[i]:first[i + 1]]) for i in range(hi - lo)]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int32)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                   pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["key", "toxic", "words"])


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each row; row and feature of every entry of the lists."""
    lists = batch.column(2)
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    return np.asarray(batch.column(1)) > 0, np.repeat(np.arange(batch.num_rows), sizes), np.asarray(lists.flatten(), np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows of every feature in a partition."""
    total, in_bad = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for batch in batches:
        bad, row, feature = _entries(batch)
        np.add.at(total, feature, 1)
        np.add.at(in_bad, feature[bad[row]], 1)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(x) for x in (seen, total[seen], in_bad[seen])], names=["feature", "total", "in_bad"])


def _used_rows(used: np.ndarray):
    """Rows as they are, but only the features ``used``, by their number in that (sorted) list."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, feature = _entries(batch)
            at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
            hit = used[at] == feature
            ends = np.cumsum(np.append(0, np.bincount(row[hit], minlength=batch.num_rows))).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], names=["key", "toxic", "words"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents (those with the smallest hash of their id); runs jobs.

    A row of ``labels`` says whether its document is toxic (1) or not (0); of several the largest counts, nulls are left out.
    The labels have no severity, so the grades of toxic documents are thirds of the number of different features in them
    that mark toxic documents in the training rows. Spark counts the features; the driver gets only those that prefer a
    class, and the training rows cut down to them. Without toxic or without clean training rows every score is clean.
    """
    chosen = labels.select(F.col(key).alias("key"), F.col(toxic).alias("toxic")).dropna().groupBy("key").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(rows)   # at most ``rows`` pairs of numbers, so it may be broadcast
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), F.col("k") == F.col("key")).select(F.col("key").cast("bigint"), F.col("toxic").cast("int"), "text")
    picked = materialize(picked.mapInArrow(_training_rows, _TRAINING))
    size = 1 << FEATURE_BITS
    n, n_bad = picked.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") > 0)).first()
    clean = Model(np.zeros(size), np.arange(GRADES - 1) + 40.0)
    if n_bad in (0, n):
        return clean
    rate = n_bad / n
    counts = picked.mapInArrow(_count_rows, "feature bigint, total bigint, in_bad bigint").groupBy("feature").agg(
        F.sum("total").alias("total"), F.sum("in_bad").alias("in_bad"))
    z = (F.col("in_bad") - F.col("total") * rate) / F.sqrt(F.col("total") * (rate * (1 - rate)))
    found = counts.where(F.col("total") >= LEAST_ROWS).select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    found = found.toArrow().sort_by("feature")   # at most 2 ** FEATURE_BITS rows
    used, marks = found.column("feature").to_numpy(), found.column("z").to_numpy() > 0
    if not len(used):
        return clean
    got = picked.mapInArrow(_used_rows(used), _TRAINING).toArrow().sort_by("key").combine_chunks()
    bad, row, feature = _entries(got.to_batches()[0])
    amount = np.bincount(row, weights=marks[feature], minlength=n)
    cuts = np.quantile(amount[bad], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(bad, 1 + np.searchsorted(cuts, amount, side="right"), 0)
    w, thresholds = fit_ordinal(row, feature, grade, len(used))
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, thresholds)


def severity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``key``, severity (expected grade, 0 to 3), grade (most probable), probability (of any toxic grade) and toxic.

    One row per input row, from its whole text; null and empty texts score like a text of unknown words. Nothing is
    shuffled and other columns are not read.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, grade, p = model.grades(_score_rows(batch.column(1), model.weights))
            yield pa.record_batch([batch.column(0), pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(p), pa.array(p >= threshold)],
                                  names=["key", "severity", "grade", "probability", "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        rows, f"key {kind}, severity double, grade int, probability double, toxic boolean")
    return out.withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not toxic."""
    place = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.grades(_score_rows(batch.column(place), model.weights))[2]
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.round("severity", 6).alias("severity"), "grade", F.col("toxic").cast("string").alias("toxic"))
