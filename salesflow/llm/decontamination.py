"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted shingles.

For every length that a benchmark item has, the windows of that many words that hold at least one shingle of the
benchmark get a 64-bit SimHash (other windows have similarity 0). Items are indexed by every value that differs from one of
their BLOCKS blocks of bits in PROBED bits at most: of RADIUS differing bits some block holds no more, so the index finds
every fingerprint in the radius and passes about 4 % of the others. Weighted shingle similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.encoding import spans
from salesflow.llm.storage import read_block, stored_blocks
from salesflow.llm.tables import table
from salesflow.llm.textops import LOWER, as_signed, gram_hash, mixed, range_hash, slices, words
from salesflow.session import materialize

WORDS = 5
SIMILARITY = 0.8
BLOCKS = 4                # of 64 / BLOCKS bits each
PROBED = 3
RADIUS = BLOCKS * (PROBED + 1) - 1   # 15; windows at weighted similarity 0.8 differ in 9 to 10 bits on average, sd below 3
ITEM_SHINGLES = 1 << 18   # shingles of the items that a task holds at a time

_HITS = "key bigint, item_id bigint, start bigint, n_words bigint, distance int, similarity double"


@dataclass
class Items:
    """The benchmark items of one block."""

    ids: np.ndarray            # item id per item
    sizes: np.ndarray          # words per item
    shingles: list[np.ndarray]  # shingle hashes per item, in order
    vocabulary: np.ndarray     # sorted distinct shingle hashes
    weights: np.ndarray        # weight per vocabulary entry
    other: float               # weight of any other shingle
    prints: np.ndarray         # SimHash per item


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and the index of each row's first word; case and ASCII white space don't count."""
    start, end, first = words(data, offsets)
    return gram_hash(range_hash(LOWER[data])(start, end), WORDS), first


def _signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums of weight * (+1 or -1) for each of the 64 bits; row i sums the first i shingles."""
    bits = np.unpackbits(mixed(hashes)[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    out = np.zeros((len(hashes) + 1, 64), np.float32)
    np.cumsum((2 * bits - 1) * weights[:, None].astype(np.float32), axis=0, out=out[1:])
    return out


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 1e-3, axis=1, bitorder="little").view(np.uint64).ravel()


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of every item, in order; items of fewer than WORDS words have none."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2)):
            grams, first = _shingles(data, offsets)
            n = np.diff(first)
            count = np.maximum(n - WORDS + 1, 0)
            index, bounds = spans(first[:-1], count)
            row = np.repeat(np.arange(lo, hi), count)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.repeat(n, count)),
                                   pa.array(index - np.repeat(first[:-1], count)), as_signed(grams[index])], names=["item", "nth", "n_words", "place", "shingle"])


def item_shingles(benchmark: DataFrame, text: str, item: str) -> DataFrame:
    """(item, nth, n_words, place, shingle, weight) for every shingle of every benchmark row; ``nth`` tells rows apart.

    A shingle weighs 1 / (number of rows that hold it), at least one half: what items share says less. The number counts the
    whole benchmark, so weights do not depend on how the items are dealt out. Rows with null ids or texts are left out.
    """
    rows = benchmark.select(F.col(item).cast("bigint").alias("item"), F.monotonically_increasing_id().alias("nth"), F.col(text).cast("string").alias("text"))
    rows = rows.dropna().mapInArrow(_item_rows, "item bigint, nth bigint, n_words bigint, place bigint, shingle bigint")
    rows = materialize(rows)
    held = rows.groupBy("shingle", "nth").agg(F.count(F.lit(1)).alias("times")).groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    return rows.join(held, "shingle").select("item", "nth", "n_words", "place", "shingle", F.greatest(1 / F.col("items"), F.lit(0.5)).alias("weight"))


def build_items(block: pa.Table) -> Items:
    """The items of a block of ``item_shingles`` with their fingerprints."""
    block = block.sort_by([("nth", "ascending"), ("place", "ascending")])
    nth, shingle, weight = (block[c].to_numpy() for c in ("nth", "shingle", "weight"))
    shingle = shingle.view(np.uint64)
    heads = np.append(np.flatnonzero(np.diff(nth, prepend=-1)), len(nth))
    vocabulary, first = np.unique(shingle, return_index=True)
    prints = [_fingerprint(_signs(shingle[a:b], weight[a:b])[-1:])[0] for a, b in zip(heads[:-1], heads[1:])]
    return Items(block["item"].to_numpy()[heads[:-1]], block["n_words"].to_numpy()[heads[:-1]], np.split(shingle, heads[1:-1]),
                 vocabulary, weight[first], 1.0, np.array(prints, np.uint64))


class BlockIndex:
    """Items by all values within PROBED bits of each block of their fingerprint."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        size = 64 // BLOCKS
        near = [sum(1 << b for b in bits) for k in range(PROBED + 1) for bits in combinations(range(size), k)]
        for block in range(BLOCKS):
            values = (self._value(prints, block)[:, None] ^ np.array(near)).ravel()
            order = np.argsort(values, kind="stable")
            bounds = np.searchsorted(values[order], np.arange((1 << size) + 1)).astype(np.int32)
            self.tables.append((bounds, (order // len(near)).astype(np.int32)))

    @staticmethod
    def _value(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * 64 // BLOCKS)) & np.uint64((1 << 64 // BLOCKS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of the pairs that meet in a block, once each."""
        found = []
        for block, (bounds, items) in enumerate(self.tables):
            value = self._value(prints, block)
            n = bounds[value + 1] - bounds[value]
            index, _ = spans(bounds[value], n)
            found.append(np.repeat(np.arange(len(prints)), n) * len(self.prints) + items[index])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of every pair within RADIUS."""
        q, item = self.candidates(prints)
        distance = np.bitwise_count(prints[q] ^ self.prints[item])
        close = distance <= RADIUS
        return q[close], item[close], distance[close]


def _similarity(a: np.ndarray, b: np.ndarray, items: Items) -> float:
    """Sum of the smaller weighted counts over sum of the larger ones."""
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    na, nb = np.bincount(back[:len(a)], minlength=len(values)), np.bincount(back[len(a):], minlength=len(values))
    at = np.minimum(np.searchsorted(items.vocabulary, values), len(items.vocabulary) - 1)
    w = np.where(items.vocabulary[at] == values, items.weights[at], items.other)
    return float((w * np.minimum(na, nb)).sum() / (w * np.maximum(na, nb)).sum())


class Searcher:
    """A block of items, indexed by their length in words."""

    def __init__(self, block: pa.Table):
        self.items = build_items(block)
        self.longest = int(self.items.sizes.max(initial=0))
        self.lengths = {}
        for size in np.unique(self.items.sizes):
            members = np.flatnonzero(self.items.sizes == size)
            self.lengths[int(size)] = (members, BlockIndex(self.items.prints[members]))

    def hits(self, grams: np.ndarray, known: np.ndarray, similarity: float) -> Iterator[tuple]:
        """Hits in one stretch of shingles of a document: (item, first word, distance, similarity)."""
        items = self.items
        at = np.minimum(np.searchsorted(items.vocabulary, grams), len(items.vocabulary) - 1)
        sums = _signs(grams, np.where(known, items.weights[at], items.other))
        seen = np.concatenate([[0], np.cumsum(known)])
        for size, (members, index) in self.lengths.items():
            n = size - WORDS + 1
            start = np.arange(max(0, len(grams) - n + 1))
            start = start[seen[start + n] > seen[start]]
            if not len(start):
                continue
            q, item, distance = index.near(_fingerprint(sums[start + n] - sums[start]))
            for i, j, d in zip(start[q].tolist(), members[item].tolist(), distance.tolist()):
                score = _similarity(grams[i:i + n], items.shingles[j], items)
                if score >= similarity:
                    yield j, i, d, score

    def search(self, grams: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple]:
        """The best window per item of every stretch of every row: (row, item id, start, words, distance, similarity)."""
        items = self.items
        if not len(items.vocabulary):
            return
        at = np.minimum(np.searchsorted(items.vocabulary, grams), len(items.vocabulary) - 1)
        known = items.vocabulary[at] == grams
        places = np.flatnonzero(known)
        row = np.searchsorted(first, places, side="right") - 1
        ok = places <= first[row + 1] - WORDS
        places, row = places[ok], row[ok]
        breaks = np.flatnonzero((np.diff(places) > 2 * self.longest) | (np.diff(row) > 0))   # stretches that no window spans
        for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(places) - 1)) if len(places) else ():
            i = int(row[a])
            begin, end = first[i], first[i + 1] - WORDS + 1
            lo, hi = max(begin, places[a] - self.longest), min(end, places[b] + self.longest + 1)
            best: dict[int, tuple] = {}
            for item, start, d, score in self.hits(grams[lo:hi], known[lo:hi], similarity):
                best[item] = max(best.get(item, (0,)), (score, -(lo - begin + start), d))
            for j, (score, s, d) in best.items():
                yield i, int(items.ids[j]), int(-s), int(items.sizes[j]), int(d), score


@lru_cache(maxsize=2)
def _searcher(folder: str, name: str) -> Searcher:
    return Searcher(read_block(folder, name))


def _search_rows(folder: str, names: list[str], similarity: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, _, data, offsets in slices(batch.column(1)):
                grams, first = _shingles(data, offsets)
                for name in names:
                    out += [(batch.column(0)[lo + i].as_py(), *hit) for i, *hit in _searcher(folder, name).search(grams, first, similarity)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _HITS.split(", ")])
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, n_words, distance, similarity): benchmark items found in documents.

    A hit is a window of as many words as the item, within RADIUS bits of its SimHash, whose weighted shingle
    similarity (five words, A-Z lower-cased, counts taken into account) is at least ``similarity``. Of the windows of
    one stretch of a document the best one per item is returned, ties to the first; a document without hits has no row.
    The whole text is searched. Null and empty texts, items of fewer than five words and null ids of items give nothing.
    Repeated documents and items give repeated rows. ``key`` is a whole number or null.

    The items are stored in blocks of bounded size, which tasks read one at a time: a benchmark of any size is a stated query
    set that one pass over the documents answers. Documents are not shuffled. Runs jobs over the benchmark when called.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    folder, names = stored_blocks(item_shingles(benchmark, item_text, item), "nth", ITEM_SHINGLES)
    return rows.mapInArrow(_search_rows(folder, names, similarity), _HITS).withColumnsRenamed({"key": key})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaked items: doc_id, n_items, items (ascending), best similarity."""
    docs = table(spark, sf_dir, "documents")
    hits = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count_distinct("item_id").alias("n_items"),
                                      F.round(F.max("similarity"), 6).alias("similarity"))
