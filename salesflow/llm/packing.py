"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

A sequence is filled greedily, longest document first. If a gap is left, its smallest document is taken out again and
replaced by the two unpacked documents that fill the wider gap best, when they fill it better. What the method does
depends only on how many documents of each length are left, so it runs on the counts per length: a choice is repeated
as long as the documents it needs are there. The plan has a bounded size (lengths, not documents); each document
finds its sequence from its number among the documents of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.encoding import encoder_for
from salesflow.llm.tables import running_totals, table
from salesflow.llm.token_files import END_ID, default_tokenizer
from salesflow.session import materialize

CAPACITY = 2048
_PIECES = "doc bigint, piece bigint, start bigint, length bigint, crc bigint"


@dataclass(frozen=True)
class Pattern:
    """The lengths of one sequence (length, how often), and how many sequences are filled this way."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths with the largest sum up to ``room``, the longer one as long as possible; zeros if there are none."""
    longest = np.maximum.accumulate(np.where(left[:room + 1] > 0, np.arange(room + 1), 0))   # the longest up to x
    a = np.flatnonzero(left[:room + 1])
    b = longest[np.minimum(a, room - a)]
    b = np.where((b == a) & (left[a] < 2), longest[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    if not total.any():
        return 0, 0
    i = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(a[i]), int(b[i])


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Best-two-fit on ``counts`` (documents of each length; index is the length, 1 to ``capacity``).

    Equal to choosing sequence by sequence: a choice stays the same while every length that it looked at is left.
    """
    counts = counts.astype(np.int64).copy()
    patterns = []
    while counts.any():
        left, gap, held = counts.copy(), capacity, Counter()
        while gap > 0 and left[:gap + 1].any():
            longest = int(np.flatnonzero(left[:gap + 1])[-1])
            n = int(min(left[longest], gap // longest))
            held[longest] += n
            left[longest] -= n
            gap -= n * longest
        need = Counter(held)
        if gap > 0 and held.total() > 1:
            smallest = min(held)
            two = _best_two(left, gap + smallest)
            if sum(two) > smallest:
                need.update(two)
                held.update(two)
                held[smallest] -= 1
        held = {k: n for k, n in sorted(held.items(), reverse=True) if n}
        times = 1 + min((int(counts[k]) - need[k]) // n for k, n in held.items())
        for k, n in held.items():
            counts[k] -= times * n
        patterns.append(Pattern(tuple(held.items()), times))
    return patterns


class Places:
    """Sequence and offset of a document from its length and its number among the documents of that length."""

    def __init__(self, patterns: list[Pattern]):
        used: Counter = Counter()
        first, rows = 0, []
        for p in patterns:
            base = 0
            for length, n in p.lengths:
                rows.append((length, used[length], n, first, base))
                used[length] += n * p.times
                base += n * length
            first += p.times
        self.length, self.since, self.each, self.first, self.base = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.sequences = first

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.zeros(len(length), np.int64)
        for k in np.unique(length):
            a, b = np.searchsorted(self.length, [k, k + 1])
            mine = length == k
            row[mine] = a + np.searchsorted(self.since[a:b], number[mine], side="right") - 1
        beyond = number - self.since[row]
        return self.first[row] + beyond // self.each[row], self.base[row] + beyond % self.each[row] * length


def _piece_rows(tokenizer: str, capacity: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            docs = batch.column(0)
            for lo, ids, bounds in encoder.encode_column(batch.column(1)):
                row, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    cuts = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                    for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        row.append(lo + i)
                        piece.append(j)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[x:y].tobytes()))
                        parts += [own[x:y].astype(np.int32)] if with_ids else []
                columns = [docs.take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (piece, start, length, crc)]]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=["doc", "piece", "start", "length", "crc", "ids"][:len(columns)])
    return rows


def _place_rows(places: Places):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "number"))
            sequence, offset = places.find(length, number)
            yield pa.record_batch([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id",
         with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens (up to 2 ** 20).

    A document is its text's ids and END_ID. One longer than ``capacity`` is cut into pieces of that length, of
    which the first may be shorter. Returns one row per piece: ``key``, piece (from 0), start (the document's ids
    before it), length, ids_crc32, sequence_id, offset (its place in the sequence, without gaps from 0) and, if wanted, ids.
    Null texts are empty and have END_ID alone; null keys and rows that repeat a key are packed like any others; an
    empty table gives no rows; other columns are not read. Stores the pieces and their numbering, so jobs run when
    it is called; only the number of pieces of each length goes to the driver.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(_piece_rows(tokenizer or default_tokenizer(), capacity, with_ids), _PIECES + ", ids array<int>" * with_ids)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():   # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    places = Places(plan(counts, capacity))
    # a unique number orders the pieces of a length, so even one length or key with most of the rows spans many ranges
    slim = pieces.select("uid", "length", F.lit(1).alias("one")) if with_ids else pieces.withColumn("one", F.lit(1))
    numbered = running_totals(slim, ["length"], ["uid"], {"number": "one"}).drop("one")
    placed = numbered.mapInArrow(_place_rows(places), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
                                 + ", sequence_id bigint, offset bigint")
    if with_ids:
        placed = pieces.join(placed.select("uid", "sequence_id", "offset").hint("shuffle_hash"), "uid")
    out = [F.col("doc").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"]
    return placed.select(*out, *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
