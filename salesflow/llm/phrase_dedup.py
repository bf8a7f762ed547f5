"""Removal of repeated phrases with sharded Aho-Corasick automata.

Every window of ``length`` words has a seed, the smallest of its word grams. Only windows whose seed occurs
again can recur, so the pieces of text around recurring seeds are dealt out by seed. Each shard confirms
which phrases recur, compiles them into an automaton, and streams its pieces through it to locate every
occurrence. A window is spelled as a few letters, each the hash of LETTER consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.suffix_dedup import NO_KEY
from salesflow.llm.tables import table
from salesflow.llm.textops import as_signed, gram_hash, inside, mixed, range_hash, slices, window_seeds, words
from salesflow.session import materialize

LENGTH = 35
GRAM = 8
LETTER = 7
SHARD_LETTERS = 1 << 18   # letters whose windows form one automaton
HOT_SHARE = 0.001         # of all rows of recurring seeds
HOT_SPOTS = 50_000        # occurrences of one seed beyond which its pieces are dealt out window by window

_SEEDS = "route bigint, doc bigint, text_hash bigint, start bigint, n int"
_PIECES = "route bigint, n int, letters binary, spots array<struct<doc:bigint,text_hash:bigint,start:bigint>>"
_RANGES = "doc bigint, text_hash bigint, start bigint, n bigint"


def _seed_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, hi, data, offsets in slices(batch.column(2)):
                start, end, first = words(data, offsets)
                grams = gram_hash(range_hash(data)(start, end), GRAM)
                seed, at, n = window_seeds(grams, length - GRAM + 1, inside(first, length, len(start)))
                row = np.searchsorted(first, at, side="right") - 1
                yield pa.record_batch([as_signed(seed), doc[lo + row], text_hash[lo + row], at - first[row], n.astype(np.int32)],
                                      names=["route", "doc", "text_hash", "start", "n"])
    return rows


def _piece_rows(length: int):
    """Letters of the pieces around the listed seeds; equal pieces of a batch become one row."""
    step = length - LETTER

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int, bytes], set] = {}
            docs, hashes, lists = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for lo, hi, data, offsets in slices(batch.column(2)):
                start, end, first = words(data, offsets)
                word = range_hash(data)(start, end)
                letters = (gram_hash(word, LETTER) >> np.uint64(32)).astype(np.uint32)
                window = as_signed(gram_hash(word, length))
                for i in range(lo, hi):
                    for spot in lists[i]:
                        a, n, who = first[i - lo] + spot["start"], spot["n"], (docs[i], hashes[i])
                        if spot["hot"]:
                            for j in range(a, a + n):
                                out.setdefault((int(window[j]), 1, letters[j:j + step + 1].tobytes()), set()).add((*who, spot["start"] + j - a))
                        else:
                            out.setdefault((spot["route"], n, letters[a:a + n + step].tobytes()), set()).add((*who, spot["start"]))
            if out:
                route, n, content = zip(*out)
                yield pa.record_batch(
                    [pa.array(route, pa.int64()), pa.array(n, pa.int32()), pa.array(content, pa.binary()),
                     pa.array([[dict(zip(("doc", "text_hash", "start"), s)) for s in spots] for spots in out.values()],
                              pa.list_(pa.struct([("doc", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64())])))],
                    names=["route", "n", "letters", "spots"])
    return rows


def _alone(of: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each id in ``of``: whether all its places have the same entry (0 or more) in ``other``."""
    order = np.argsort(of, kind="stable")
    opens = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    low, high = np.minimum.reduceat(other[order], opens), np.maximum.reduceat(other[order], opens)
    return (low == high) & (low >= 0)


def confirmed_phrases(pieces: list[tuple[np.ndarray, int]], times: list[int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """The phrases that occur at two places or more in the pieces of a shard: their first window, as letters,
    and their number of windows.

    Recurring windows that always follow each other, wherever they stand, form one phrase, so its first window
    stands for all of them.
    """
    picks = np.arange(0, length, LETTER)
    sizes = np.array([n for _, n in pieces])
    rows = np.concatenate([letters[np.arange(n)[:, None] + picks] for letters, n in pieces])
    code = np.zeros(len(rows), np.uint64)
    for column in rows.T.astype(np.uint64):
        code = mixed(code + column)
    _, first, window = np.unique(code, return_index=True, return_inverse=True)
    often = (np.bincount(window, weights=np.repeat(times, sizes)) >= 2)[window]
    opens = np.cumsum(sizes) - sizes
    before, after = np.append(-1, window[:-1]), np.append(window[1:], -1)
    before[opens], after[opens + sizes - 1] = -1, -1
    goes_on = often & np.append(often[1:], False) & _alone(window, after)[window]
    glued = np.append(False, goes_on[:-1]) & _alone(window, before)[window]
    glued[opens] = False
    ends = np.append(np.flatnonzero(~glued), len(rows))
    heads = first[often[first] & ~glued[first]]
    return list(zip(map(tuple, rows[heads].tolist()), (ends[np.searchsorted(ends, heads) + 1] - heads).tolist()))


def locate(pieces: list[tuple[np.ndarray, int]], phrases: list[tuple[tuple[int, ...], int]]) -> list[list[tuple[int, int]]]:
    """For each piece the runs of windows (first, number) of the phrases in it, found by one automaton."""
    if not phrases:
        return [[]] * len(pieces)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for spelled, n in phrases:
        machine.add_word(spelled, n)
    machine.make_automaton()
    back = LETTER * (len(phrases[0][0]) - 1)
    found = []
    for letters, _ in pieces:
        hits = sorted((phase + LETTER * end - back, n) for phase in range(LETTER) for end, n in machine.iter(tuple(letters[phase::LETTER].tolist())))
        runs: list[list[int]] = []
        for start, n in hits:
            if runs and start <= runs[-1][0] + runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], start + n - runs[-1][0])
            else:
                runs.append([start, n])
        found.append([tuple(r) for r in runs])
    return found


@dataclass
class _Held:
    """A distinct piece of a shard: its number of windows, where it is first, and whether it is anywhere else."""

    n: int
    first: tuple[int, int, int]
    again: bool = False


def _search_shards(length: int):
    """Places of recurring windows in each shard; rows come sorted by seed.

    A piece that is at two places recurs as a whole, so its places are given out as they come and are not kept: a phrase that
    a third of all documents share needs no more memory than another. Of other pieces the automaton finds what recurs.
    """
    def settle(held: dict[tuple[int, bytes], _Held]) -> list[tuple]:
        pieces = [(np.frombuffer(letters, np.uint32), h.n) for (_, letters), h in held.items()]
        phrases = confirmed_phrases(pieces, [1 + h.again for h in held.values()], length)
        alone = [(p, h.first) for p, h in zip(pieces, held.values()) if not h.again]
        return [(doc, text_hash, start + first, n) for (doc, text_hash, start), runs in zip((f for _, f in alone), locate([p for p, _ in alone], phrases))
                for first, n in runs]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=["doc", "text_hash", "start", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], _Held] = {}
        size, last, out = 0, None, []
        for batch in batches:
            for route, n, letters, spots in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if size >= SHARD_LETTERS and route != last:   # a shard ends where a seed ends
                    out += settle(held)
                    held, size = {}, 0
                last = route
                for spot in spots:
                    where = (spot["doc"], spot["text_hash"], spot["start"])
                    known = held.get((route, letters))
                    if known is None:
                        held[route, letters] = _Held(n, where)
                        size += len(letters) // 4
                    elif where != known.first:   # a row that repeats key and text is no other place
                        out += [(*where, n)] if known.again else [(*known.first, n), (*where, n)]
                        known.again = True
            yield given(out)
            out = []
        yield given(settle(held) if held else [])
    return rows


def _cut_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            count, removed, kept = [], [], []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                found = (texts[i].as_py() or "").encode().split()   # bytes split at ASCII white space only
                count.append(len(found))
                if ranges:
                    gone = np.zeros(len(found), bool)
                    for r in ranges:
                        gone[r["start"]:r["start"] + r["n"] + length - 1] = True
                    found = [w for w, g in zip(found, gone.tolist()) if not g]
                removed.append(count[-1] - len(found))
                kept.append(b" ".join(found))
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                                   pa.array(kept, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept"])
    return rows


def repeated_phrases(rows: DataFrame, length: int) -> DataFrame:
    """(doc, text_hash, start, n): runs of n starts of windows whose words occur at another place too.

    Stores three intermediates, so jobs run when it is called.
    """
    seeds = rows.mapInArrow(_seed_rows(length), _SEEDS)
    seeds = materialize(seeds)
    # counts are combined before their shuffle; the at most 1 / HOT_SHARE seeds with many rows meet those where they are
    again = materialize(seeds.groupBy("route").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    least = again.agg(F.sum("times") * HOT_SHARE).scalar()
    heavy = materialize(again.where(F.col("times") >= least))
    light = again.where(F.col("times") < least).hint("shuffle_hash")
    rest = seeds.join(F.broadcast(heavy.select("route")), "route", "left_anti").join(light, "route")
    spots = materialize(seeds.join(F.broadcast(heavy), "route").unionByName(rest).select(
        "doc", "text_hash", "route", "start", "n", (F.col("times") > HOT_SPOTS).alias("hot")))
    lists = spots.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("route", "start", "n", "hot")).alias("spots"))
    lists = lists.withColumnsRenamed({"doc": "d", "text_hash": "h"}).hint("shuffle_hash")
    texts = rows.join(lists, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")))
    pieces = texts.select("doc", "text_hash", "text", "spots").mapInArrow(_piece_rows(length), _PIECES)
    return materialize(pieces.repartition("route").sortWithinPartitions("route").mapInArrow(_search_shards(length), _RANGES))


def remove_phrases(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts anywhere else.

    Words are runs of anything but ASCII white space, compared as they are; every occurrence goes, the first
    included, and windows are judged on the input. Returns one row per input row: ``key``, n_words, n_removed
    and kept (the remaining words joined by one space). Null is an empty text. Rows that repeat both key and
    text count as one document and all get its result. ``key`` is a whole number or null; other columns are
    not read. ``length`` is a multiple of LETTER from 14 to 133.
    """
    if length % LETTER or not 14 <= length <= 133:
        raise ValueError("length must be a multiple of 7 from 14 to 133")
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("doc"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    found = repeated_phrases(rows, length).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    found = found.withColumnsRenamed({"doc": "d", "text_hash": "h"}).hint("shuffle_hash")
    joined = rows.join(found, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    out = joined.select("doc", "text_hash", "text", "ranges").mapInArrow(_cut_rows(length), "doc bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.nullif("doc", F.lit(NO_KEY)).alias(key), "n_words", "n_removed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_phrases(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM win JOIN again USING (k)),
kept AS (SELECT r, count(*) AS n, string_agg(one, ' ' ORDER BY pos) AS s
  FROM (SELECT r, unnest(w) AS one, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
