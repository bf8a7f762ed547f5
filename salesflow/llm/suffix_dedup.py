"""Removal of repeated byte strings with a difference-cover suffix sort.

A string of ``length`` bytes is found again by the smallest of its grams (its seed): equal strings have
equal seeds at equal places, so only strings around seeds that recur can repeat. These are dealt out by
seed, each shard is suffix-sorted by difference cover (sampled triples, names, recursion, merge of the
rest), and strings that stand next to each other and agree are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.tables import table
from salesflow.llm.textops import _CODES, as_signed, gram_hash, inside, mixed, range_hash, slices, window_seeds
from salesflow.session import materialize

LENGTH = 100
GRAM = 32
SEED_SLICE = 1 << 18     # bytes hashed at a time
SHARD_BYTES = 1 << 20    # text that is suffix-sorted at once
HOT_PIECES = 50_000      # distinct pieces of one seed beyond which they are dealt out window by window
NO_KEY = -2**63          # stands for a null document id

_SEEDS = "route bigint, piece bigint, doc bigint, text_hash bigint, start bigint, n bigint, covered boolean"
_PIECES = "route bigint, doc bigint, text_hash bigint, start bigint, n bigint, covered boolean, content binary"
_RANGES = "doc bigint, text_hash bigint, start bigint, n bigint"


def _later_copies(group: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have the same group as a row of smaller (doc, text_hash, start)."""
    out = np.zeros(len(group), bool)
    _, back, n = np.unique(group, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(n[back] > 1)
    order = rows[np.lexsort((start[rows], text_hash[rows], doc[rows], group[rows]))]
    if len(order):
        opens = np.append(True, group[order][1:] != group[order][:-1])
        first = order[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        out[order] = (doc[order] != doc[first]) | (text_hash[order] != text_hash[first]) | (start[order] != start[first])
    return out


def _route(group: np.ndarray, doc: np.ndarray, start: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Rows that are settled already go anywhere, so that copies of one text do not meet in one task."""
    return np.where(covered, mixed(doc.astype(np.uint64) + start.astype(np.uint64)), group)


def _seed_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = []
            for lo, hi, data, offsets in slices(batch.column(2), SEED_SLICE):
                grams = gram_hash(_CODES[data], GRAM)
                seed, first, n = window_seeds(grams, length - GRAM + 1, inside(offsets, length, len(data)))
                if len(seed):
                    row = np.searchsorted(offsets, first, side="right") - 1
                    parts.append((seed, range_hash(data)(first, first + n - 1 + length), docs[0][lo + row],
                                  docs[1][lo + row], first - offsets[row], n))
            if not parts:
                continue
            seed, piece, doc, text_hash, start, n = map(np.concatenate, zip(*parts))
            covered = _later_copies(mixed(seed + piece), doc, text_hash, start)
            yield pa.record_batch([as_signed(_route(seed, doc, start, covered)), as_signed(piece), doc, text_hash, start, n,
                                   pa.array(covered)], names=[c.split()[0] for c in _SEEDS.split(", ")])
    return rows


def _piece_rows(length: int):
    """Cut the pieces of the listed seeds out of their documents; those of hot seeds window by window."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (doc, text_hash, spots) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                text = batch.column(2)[i].as_py().encode()
                for spot in spots:
                    start, n = spot["start"], spot["n"]
                    content = text[start:start + n - 1 + length]
                    if not spot["hot"]:
                        out.append((spot["route"], doc, text_hash, start, n, content, False))
                        continue
                    at = np.arange(n)
                    for j, h in enumerate(as_signed(range_hash(np.frombuffer(content, np.uint8))(at, at + length)).tolist()):
                        out.append((h, doc, text_hash, start + j, 1, content[j:j + length], True))
            if not out:
                continue
            *numbers, content, window = zip(*out)
            route, doc, text_hash, start, n = (np.array(x, np.int64) for x in numbers)
            window = np.array(window)
            group = np.where(window, route.view(np.uint64), mixed(np.arange(len(route), dtype=np.uint64)))
            covered = _later_copies(group, doc, text_hash, start) & window
            yield pa.record_batch([as_signed(_route(route.view(np.uint64), doc, start, covered)), doc, text_hash, start, n,
                                   pa.array(covered), pa.array(content, pa.binary())], names=[c.split()[0] for c in _PIECES.split(", ")])
    return rows


def suffix_order(symbols: np.ndarray, need: int) -> np.ndarray:
    """Start positions in the order of their suffixes, exact on the first ``need`` symbols (ties in any order).

    Difference cover modulo 3: the suffixes that start at 1 and 2 modulo 3 are sorted by their triples, the
    triples get names, the string of names is sorted the same way unless the names tell all apart or
    cover ``need`` symbols; the suffixes at 0 modulo 3 follow from their first symbol and the rank behind
    it, and are merged in by the same comparison.
    """
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    base = int(s.max()) + 1
    last = n + (n % 3 == 1)                       # one empty suffix more keeps the two halves apart
    sample = np.concatenate([np.arange(1, last, 3), np.arange(2, last, 3)])
    names = _names([s[sample], s[sample + 1], s[np.minimum(sample + 2, n + 2)]], base)
    if need > 3 and names.max() < len(names):
        by_rank = suffix_order(names, -(-need // 3))
    else:
        by_rank = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    if need > 3:
        rank[sample[by_rank]] = np.arange(1, len(sample) + 1)
    else:
        rank[sample] = names
    top = len(sample) + 2
    sorted12 = sample[by_rank]
    rest = np.arange(0, n, 3)
    one_ahead = s[rest] * top + rank[rest + 1]
    order0 = np.argsort(one_ahead)
    rest, one_ahead = rest[order0], one_ahead[order0]
    mod1, mod2 = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    at1, at2 = np.flatnonzero(sorted12 % 3 == 1), np.flatnonzero(sorted12 % 3 == 2)
    key1 = s[mod1] * top + rank[mod1 + 1]
    pair = _names([s[np.concatenate([rest, mod2])], s[np.concatenate([rest, mod2]) + 1]], base)
    two_ahead = pair[:len(rest)] * top + rank[rest + 2]
    key2 = pair[len(rest):] * top + rank[mod2 + 2]
    place = np.zeros(n + 1, np.int64)
    place[rest] = np.arange(len(rest)) + np.searchsorted(np.sort(key1), one_ahead) + np.searchsorted(np.sort(key2), two_ahead)
    place[mod1] = at1 + np.searchsorted(one_ahead, key1, side="right")
    place[mod2] = at2 + np.searchsorted(np.sort(two_ahead), key2, side="right")
    return np.argsort(place[:n], kind="stable")


def _names(columns: list[np.ndarray], base: int) -> np.ndarray:
    """Dense ranks (from 1) of the tuples formed by ``columns`` with values below ``base``."""
    key, size = columns[0], base
    for column in columns[1:]:
        if size * base >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * base + column, size * base
    order = np.argsort(key)
    changed = np.ones(len(key), np.int64)
    changed[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(changed)
    return out


def repeated_windows(content: list[bytes], n: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (piece, first, number) that also start earlier in another place of the shard."""
    sizes = np.array([len(c) for c in content])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(content) + bytes(8), np.uint8)
    order = suffix_order(data[:sizes.sum()].astype(np.int64) + 1, length)
    piece_of = np.repeat(np.arange(len(content)), sizes)
    valid = np.arange(sizes.sum()) - begin[piece_of] < n[piece_of]
    order = order[valid[order]]
    eight = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel()
    left, right, same = order[:-1], order[1:], np.ones(len(order) - 1, bool)
    for k in [*range(0, length - 7, 8), length - 8]:   # adjacent prefixes, eight bytes at a time
        at = np.flatnonzero(same)
        same[at] = eight[left[at] + k] == eight[right[at] + k]
    member = np.append(same, False) | np.append(False, same)
    group = np.cumsum(np.append(True, ~same))[member]
    spot = order[member]
    p = piece_of[spot]
    at = start[p] + spot - begin[p]
    copies = np.sort(spot[_later_copies(group.astype(np.uint64), doc[p], text_hash[p], at)])
    if not len(copies):
        return copies, copies, copies
    opens = np.append(True, (np.diff(copies) != 1) | (np.diff(piece_of[copies]) != 0))
    first = copies[opens]
    return piece_of[first], first - begin[piece_of[first]], np.diff(np.append(np.flatnonzero(opens), len(copies)))


def _sort_shards(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(shard: pa.Table) -> pa.RecordBatch:
            doc, text_hash, start, n, covered = (shard.column(c).to_numpy() for c in ("doc", "text_hash", "start", "n", "covered"))
            todo = np.flatnonzero(~covered)
            content = shard.column("content").take(pa.array(todo)).to_pylist()
            done = np.flatnonzero(covered)
            out = [(doc[done], text_hash[done], start[done], n[done])]
            if content:
                piece, first, number = repeated_windows(content, n[todo], doc[todo], text_hash[todo], start[todo], length)
                piece = todo[piece]
                out.append((doc[piece], text_hash[piece], start[piece] + first, number))
            return pa.record_batch([np.concatenate(x).astype(np.int64) for x in zip(*out)], names=["doc", "text_hash", "start", "n"])

        size, last_route = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            route = np.asarray(batch.column(0))
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(6)), np.int64))])
            cuts = np.flatnonzero(np.append(bool(held) and route[0] != last_route, route[1:] != route[:-1]))  # where a seed ends
            lo = 0
            for cut in cuts:
                if size + sizes[cut] - sizes[lo] >= SHARD_BYTES:
                    yield settle(pa.Table.from_batches([*held, batch.slice(lo, cut - lo)]))
                    held, size, lo = [], 0, int(cut)
            held.append(batch.slice(lo))
            size, last_route = size + int(sizes[-1] - sizes[lo]), route[-1]
        if held:
            yield settle(pa.Table.from_batches(held))
    return rows


def _cut_rows(length: int):
    """Remove the covered ranges of every document: spans and remaining bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, size = [], [], []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                text = (batch.column(2)[i].as_py() or "").encode()
                merged: list[list[int]] = []
                for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in ranges or []):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *[x for span in merged for x in span], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in merged])
                size.append(len(text))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                   pa.array(kept, pa.binary())], names=["doc", "text_hash", "n_bytes", "spans", "kept"])
    return rows


def repeated_ranges(rows: DataFrame, length: int) -> DataFrame:
    """(doc, text_hash, start, n): starts of ``length``-byte strings that also start earlier, as runs of n starts.

    Strings are compared on the input. Stores two intermediates, so jobs run when it is called.
    """
    seeds = rows.mapInArrow(_seed_rows(length), _SEEDS)
    # explicit exchange by seed: both windows below use it; equal pieces of one batch were combined before it
    dealt = seeds.repartition("route")
    by_piece = Window.partitionBy("route", "piece").orderBy("doc", "text_hash", "start")
    by_seed = Window.partitionBy("route")
    me = F.struct("doc", "text_hash", "start")
    dealt = dealt.withColumn("nth", F.row_number().over(by_piece)).withColumn("owner", F.first(me).over(by_piece))
    dealt = dealt.withColumn("pieces", F.sum(F.when((F.col("nth") == 1) & ~F.col("covered"), 1).otherwise(0)).over(by_seed))
    copy = F.col("covered") | (F.col("owner") != me)
    settled = materialize(dealt.where(copy | ((F.col("nth") == 1) & (F.col("pieces") > 1))).select(
        "route", "doc", "text_hash", "start", "n", copy.alias("copy"), (F.col("pieces") > HOT_PIECES).alias("hot")))
    first = settled.where("not copy").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("route", "start", "n", "hot")).alias("spots"))
    first = first.withColumnsRenamed({"doc": "d", "text_hash": "h"}).hint("shuffle_hash")
    texts = rows.join(first, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")))
    pieces = texts.select("doc", "text_hash", "text", "spots").mapInArrow(_piece_rows(length), _PIECES)
    shards = pieces.repartition("route").sortWithinPartitions("route")
    sorted_out = materialize(shards.mapInArrow(_sort_shards(length), _RANGES))
    return settled.where("copy").select("doc", "text_hash", "start", "n").unionByName(sorted_out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means in a row of smaller ``key`` (null first; equal keys by the hash of the text), or before in
    the same text. Matches never cross texts, overlaps count, and strings are judged on the input.
    Returns one row per input row: ``key``, n_bytes, spans (maximal removed runs as byte ranges) and kept (the
    remaining bytes; they may end inside a character). Null is an empty text. Rows that repeat both key and text
    count as one document and all get its result. ``key`` is a whole number; other columns are not read.
    """
    if not GRAM <= length <= GRAM + 126:
        raise ValueError(f"length must lie between {GRAM} and {GRAM + 126}")
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("doc"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    found = repeated_ranges(rows, length).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    found = found.withColumnsRenamed({"doc": "d", "text_hash": "h"}).hint("shuffle_hash")
    joined = rows.join(found, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    out = joined.select("doc", "text_hash", "text", "ranges").mapInArrow(
        _cut_rows(length), "doc bigint, text_hash bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_KEY)).alias(key), "n_bytes", "spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d),
win AS (SELECT r, i, md5(substring(h, 2 * i + 1, 200)) AS k FROM starts),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS nth FROM win) WHERE nth > 1),
opens AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM opens),
spans AS (SELECT r, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY r, run),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
    string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
