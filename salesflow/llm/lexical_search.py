"""Ranked lexical search: accumulator-limited evaluation, term at a time.

An index holds segments of about SEGMENT_BYTES of text, one row each, with the inverted lists of all their terms. A query
goes through a segment's lists rarest term first. Once the terms that are left cannot lift a new document to the kth best
score found so far, no more accumulators are created; those that can still reach it get the rest of their scores by look-ups
in the remaining lists, so the scores of survivors are exact. A task carries the kth score on from segment to segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.encoding import binary_of, spans
from salesflow.llm.storage import packed, read_block, stored_blocks, unpacked
from salesflow.llm.suffix_dedup import NO_KEY
from salesflow.llm.tables import table
from salesflow.llm.textops import LOWER, slices
from salesflow.session import materialize

K = 10
SEGMENT_BYTES = 16 << 20   # text of one segment
BLOCK_TERMS = 1 << 18      # query terms that a task holds at a time
SPREAD = 64                # parts in which a query's candidates are cut to the best k before they meet
_TERM = np.ones(256, bool)
_TERM[[c for c in range(128) if not chr(c).isalnum()]] = False
_SEGMENT = ("keys binary, lengths binary, vocabulary binary, vocabulary_bounds binary, bounds binary, places binary, times binary, "
            "documents bigint, terms bigint")


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a slice, and the bounds of its rows in them."""
    data = LOWER[data]
    inside = _TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[offsets[offsets < len(data)]] |= inside[offsets[offsets < len(data)]]
    start = np.flatnonzero(opens)
    kept = np.append(0, np.cumsum(inside))
    return binary_of(data[inside], np.append(kept[start], kept[-1])), np.searchsorted(start, offsets)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.asarray(batch.column(0))
        for lo, hi, data, offsets in slices(batch.column(1), SEGMENT_BYTES):
            terms, rows = _terms(data, offsets)
            n, lengths = hi - lo, np.diff(rows)
            found = terms.dictionary_encode()
            code, times = np.unique(found.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
            words = found.dictionary
            bounds = np.searchsorted(code, np.arange(len(words) + 1) * n)
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
            blobs = [keys[lo:hi], lengths, np.frombuffer(words.buffers()[2] or b"", np.uint8), ends, bounds,
                     (code % n).astype(np.int32), times.astype(np.int32)]
            yield pa.record_batch([*[pa.array([packed(x)], pa.binary()) for x in blobs], pa.array([int((lengths > 0).sum())]),
                                   pa.array([int(lengths.sum())])], names=[c.split()[0] for c in _SEGMENT.split(", ")])


def index_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored index of all rows. Terms are the longest runs of letters and digits of ASCII and of characters beyond it, with A-Z
    in lower case, in the whole text. Null texts have no terms; repeated rows are documents of their own. Runs a job when called."""
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("doc"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_segment_rows, _SEGMENT))


class Segment:
    """The inverted lists of one index row."""

    def __init__(self, row: dict):
        self.keys, self.lengths = unpacked(row["keys"], np.int64), unpacked(row["lengths"], np.int64)
        self.words = binary_of(unpacked(row["vocabulary"], np.uint8), unpacked(row["vocabulary_bounds"], np.int64))
        self.bounds = unpacked(row["bounds"], np.int64)
        self.places, self.times = unpacked(row["places"], np.int32), unpacked(row["times"], np.int32)

    def find(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 if no document has it."""
        return pc.fill_null(pc.index_in(terms, value_set=self.words), -1).to_numpy().astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment({c: batch.column(c)[i].as_py() for c in batch.schema.names})


def _count_rows(folder: str, names: list[str]):
    """How many documents of each segment have each term of the query blocks."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            for name in names:
                terms = read_block(folder, name)["term"].combine_chunks()
                at = segment.find(terms.cast(pa.large_binary()))
                there = np.flatnonzero(at >= 0)
                n = segment.bounds[at[there] + 1] - segment.bounds[at[there]]
                yield pa.record_batch([terms.take(pa.array(there)), pa.array(n)], names=["term", "n"])
    return rows


def best_documents(weights: list[int], bounds: list[int], lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment of ``n`` that can be among the best ``k``, and their exact scores.

    Terms come rarest first: their weights, the most that each can add, and their lists (documents in ascending order, what one
    occurrence adds). ``least`` is the kth best score known before (0: none). Every document that is left out scores less than k others.
    """
    rest = [*np.cumsum(bounds[::-1])[::-1].tolist(), 0]
    total = np.zeros(n, np.int64)
    alive = None
    for i, (weight, (place, adds)) in enumerate(zip(weights, lists)):
        if alive is None and rest[i] < least:   # new documents cannot reach the kth score any more
            alive = np.flatnonzero(total)
        if alive is None:
            total[place] += weight * adds
            # the kth partial score can only count if it may exceed what is left
            if rest[i + 1] < rest[0] - rest[i + 1] and n >= k:
                least = max(least, int(np.partition(total, n - k)[n - k]))
        else:
            alive = alive[total[alive] + rest[i] >= least]
            if len(place):
                at = np.minimum(np.searchsorted(place, alive), len(place) - 1)
                hit = place[at] == alive
                total[alive[hit]] += weight * adds[at[hit]]
    alive = np.flatnonzero(total) if alive is None else alive
    alive = alive[(total[alive] >= least) & (total[alive] > 0)]
    return alive, total[alive]


def _rank_rows(folder: str, names: list[str], k: int, documents: int, terms: int):
    """The best ``k`` documents of every query in the segments of a task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}   # scores in descending order, keys
        for segment in _segments(batches):
            m = 100 - 75 + (75 * segment.lengths * documents) // max(terms, 1)
            for name in names:
                block = read_block(folder, name)
                words = block["term"].combine_chunks().cast(pa.large_binary()).dictionary_encode()
                at = segment.find(words.dictionary)
                first = np.where(at >= 0, segment.bounds[at], 0)
                index, upto = spans(first, np.where(at >= 0, segment.bounds[at + 1] - first, 0))
                place, times = segment.places[index], segment.times[index].astype(np.int64)
                adds = (1_000_000_000 * times) // (1000 * times + 8 * m[place])
                filled = np.flatnonzero(np.diff(upto))
                most = np.zeros(len(at), np.int64)
                most[filled] = np.maximum.reduceat(adds, upto[filled]) if len(filled) else 0
                term, weight, query = words.indices.to_numpy(), block["weight"].to_numpy(), block["query"].to_numpy()
                use = np.flatnonzero(most[term] > 0)
                use = use[np.lexsort((-weight[use], query[use]))]   # rarest first
                heads = np.append(np.flatnonzero(np.diff(query[use], prepend=-1)), len(use))
                for a, b in zip(heads[:-1], heads[1:]):
                    of = int(query[use[a]])
                    scores, keys = best.get(of, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    t, w = term[use[a:b]], weight[use[a:b]]
                    lists = [(place[upto[x]:upto[x + 1]], adds[upto[x]:upto[x + 1]]) for x in t]
                    found, score = best_documents(w.tolist(), (w * most[t]).tolist(), lists, len(segment.keys), k, int(scores[k - 1]) if len(scores) == k else 0)
                    scores, keys = np.append(scores, score), np.append(keys, segment.keys[found])
                    order = np.lexsort((keys, -scores))[:k]
                    best[of] = scores[order], keys[order]
        for of, (scores, keys) in best.items():
            yield pa.record_batch([pa.array([of] * len(scores), pa.int64()), pa.array(keys), pa.array(scores)], names=["query", "doc", "score"])
    return rows


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            terms, rows = _terms(data, offsets)
            query = batch.column(0).take(pa.array(np.repeat(np.arange(lo, hi), np.diff(rows))))
            yield pa.record_batch([query, terms.cast(pa.large_string()).cast(pa.string())], names=["query", "term"])


def search(index: DataFrame, items: DataFrame, k: int = K, item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``k`` best documents of ``index`` for every row of ``items``: ``item_key``, rank (from 1), doc_id, score.

    A term that n of the N documents with terms hold weighs floor(1000 * ln((2 * N + 2) / (2 * n + 1))); a document's score adds, over the
    item's terms with repeats, weight * ((10**9 * tf) div (1000 * tf + 8 * m)) with m = 25 + (75 * its length * N) div all terms. Only
    scores above 0 count; equal scores go by ascending doc_id (null first). Items without terms, null ones among them, have no rows; repeated items
    have a result each; an empty index or item table gives no rows; other columns are not read. Queries are stored in blocks of bounded size, which
    tasks read one at a time, so one pass over the index answers them all. Runs jobs when called.
    """
    items = materialize(items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()))
    terms = items.select("query", "text").mapInArrow(_query_terms, "query bigint, term string").groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = materialize(terms)
    documents, length = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    lists = index.select("keys", "lengths", "vocabulary", "vocabulary_bounds", "bounds", "places", "times")
    held = lists.mapInArrow(_count_rows(*stored_blocks(terms.select("term").distinct(), "term", BLOCK_TERMS)), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("n") + 1))).cast("bigint")
    weighted = terms.join(held, "term").select("query", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    found = lists.mapInArrow(_rank_rows(*stored_blocks(weighted, "query", BLOCK_TERMS), k, documents, length), "query bigint, doc bigint, score bigint")
    found = found.withColumn("part", F.spark_partition_id() % SPREAD)
    for group in (["query", "part"], ["query"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "doc"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    named = found.join(items.select("query", "item"), "query")
    return named.select(F.col("item").alias(item_key), "rank", F.nullif("doc", F.lit(NO_KEY)).alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT item_id, row_number() OVER () AS item_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, item_no, term, count(*) AS times FROM q GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
s AS (SELECT item_no, item_id, row_no, doc_id,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM qt JOIN w USING (term) JOIN p USING (term), total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
