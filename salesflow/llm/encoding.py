"""Encoding of text columns through their distinct pieces, for tokenizers that never reach over a single space.

A text is cut before every single space that stands between two words. Byte-level and sentence-piece vocabularies
hold no token with a space behind another character, so each piece has the same ids alone as in its text. Every
distinct piece of a slice is encoded once: new pieces go to the tokenizer in joined runs, whose ids are dealt back by
their lengths in bytes, and a worker remembers pieces between slices and tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from salesflow.llm.textops import slices

SLICE_BYTES = 16 << 20    # text whose distinct pieces are looked up together
RUN_BYTES = 1 << 16       # new pieces that the tokenizer gets as one text
RUNS = 8                  # runs, or that many bytes of other pieces, that it gets at a time: its results are large
CACHED_PIECES = 500_000
# bytes that surely end or begin a character that is no white space, also beyond ASCII; other places are not cut
_ENDS_WORD = np.arange(256) > 0x20
_ENDS_WORD[[0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_BEGINS_WORD = np.arange(256) > 0x20
_BEGINS_WORD[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def bounds_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def binary_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


def spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices first, first + 1, ... (``size`` of them) of all spans in a row, and the bounds of the spans."""
    upto = np.append(0, np.cumsum(size))
    return np.repeat(first - upto[:-1], size) + np.arange(upto[-1]), upto


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, entries: list[bytes]):
        column = pa.array(entries, pa.large_binary())
        self.data, offsets = bounds_of(column)
        self.first, self.size = offsets[:-1], np.diff(offsets)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        return self.data[spans(self.first[ids], self.size[ids])[0]]


def byte_level(path: str, special: bool = True) -> tuple[Callable[[list[bytes]], list[list[int]]], Vocabulary]:
    """Encoder of runs and vocabulary of a byte-level BPE file of the tokenizers library.

    With ``special`` false the strings of special tokens inside a text are plain text.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # the tasks are the parallelism
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]   # bytes that the file writes as themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    entries = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    table = [entries.get(i, b"") for i in range(max(entries) + 1)]
    return lambda runs: [e.ids for e in tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)], Vocabulary(table)


def sentence_pieces(path: str) -> tuple[Callable[[list[bytes]], list[list[int]]], Vocabulary]:
    """The same for a sentencepiece model that puts a space before every text: runs begin with that space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda runs: model.encode([r[1:].decode() for r in runs], num_threads=1), Vocabulary(entries)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts at ``offsets`` begin."""
    opens = np.zeros(len(data), bool)
    if len(data) > 2:
        np.logical_and(_ENDS_WORD[data[:-2]], _BEGINS_WORD[data[2:]], out=opens[1:-1])
        opens[1:-1] &= data[1:-1] == 0x20
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        opens[inner - 1] = False     # a space at the end of a text
    opens[offsets[offsets < len(data)]] = True
    return np.flatnonzero(opens)


@dataclass
class Pieces:
    """A slice of a text column: rows lo to hi, its distinct pieces, and for each row the pieces that it holds in order."""

    lo: int
    hi: int
    distinct: pa.Array
    at: np.ndarray        # number of the distinct piece, for every piece in the slice
    rows: np.ndarray      # bounds of the rows in ``at``


def pieces_of(column: pa.Array, limit: int = 0) -> Iterator[Pieces]:
    """The pieces of a column, slice by slice; null is an empty text, and a text is never split between slices."""
    for lo, hi, data, offsets in slices(column, limit or SLICE_BYTES):
        begins = cuts(data, offsets)
        found = binary_of(data, np.append(begins, len(data))).dictionary_encode()
        yield Pieces(lo, hi, found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(begins, offsets))


class PieceEncoder:
    """Encodes distinct pieces and remembers up to CACHED_PIECES of them."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], vocabulary: Vocabulary):
        self.encode, self.vocabulary = encode, vocabulary
        self.known = pa.array([], pa.large_binary())
        self.ends, self.store = np.zeros(1, np.int64), np.zeros(0, np.uint32)   # ids of piece k: store[ends[k]:ends[k + 1]]

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        counts, ids, lo = [], [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < RUNS * RUN_BYTES:
                size, hi = size + len(texts[hi]), hi + 1
            for one in self.encode(texts[lo:hi]):
                counts.append(len(one))
                ids.append(np.array(one, np.uint32))
            lo = hi
        return np.array(counts, np.int64), np.concatenate([np.zeros(0, np.uint32), *ids])

    def _runs(self, data: np.ndarray, bounds: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """First and end piece of every run, and its ids."""
        for lo in range(0, len(heads) - 1, RUNS):
            hi = min(lo + RUNS, len(heads) - 1)
            got = self.encode([data[x:y].tobytes() for x, y in zip(bounds[lo:hi], bounds[lo + 1:hi + 1])])
            yield from zip(heads[lo:hi], heads[lo + 1:hi + 1], (np.array(one, np.uint32) for one in got))

    def _fresh(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces in another order, the number of ids of each, and all ids."""
        data, offsets = bounds_of(pieces)
        first, last = offsets[:-1], offsets[1:] - 1
        long = last > first
        joins = long & (data[first] == 0x20) & _BEGINS_WORD[data[np.where(long, first + 1, first)]] & _ENDS_WORD[data[last]]
        pieces = pa.concat_arrays([pieces.filter(pa.array(joins)), pieces.filter(pa.array(~joins))])
        data, offsets = bounds_of(pieces)
        n = int(joins.sum())
        # a run ends with the first piece beyond RUN_BYTES
        run = (offsets[1:n + 1] - offsets[0] - 1) // RUN_BYTES
        heads = np.append(np.flatnonzero(np.diff(run, prepend=-1)), n) if n else np.zeros(1, np.int64)
        counts, ids = [], []
        for a, b, run_ids in self._runs(data, offsets[heads], heads):
            upto, wanted = np.cumsum(self.vocabulary.size[run_ids]), offsets[a + 1:b + 1] - offsets[a]
            place = np.minimum(np.searchsorted(upto, wanted), max(len(upto) - 1, 0))
            if len(upto) and np.array_equal(upto[place], wanted):
                counts.append(np.diff(place + 1, prepend=0))
                ids.append(run_ids)
            else:   # a piece that the tokenizer does not spell back
                some, each = self._plain([data[x:y].tobytes() for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])])
                counts.append(some)
                ids.append(each)
        some, each = self._plain(pieces.slice(n).to_pylist())
        return pieces, np.concatenate([*counts, some]), np.concatenate([*ids, each])

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces: where their ids begin in a store, how many they are, and the store."""
        slot = pc.index_in(pieces, value_set=self.known).cast(pa.int64())
        new = slot.is_null()
        known, ends, store = self.known, self.ends, self.store
        fresh = pieces.filter(new)
        if len(fresh):
            fresh, counts, ids = self._fresh(fresh)
            ends = np.concatenate([ends, ends[-1] + np.cumsum(counts)])
            store = np.concatenate([store, ids])
            slot = pc.coalesce(slot, pc.add(pc.index_in(pieces, value_set=fresh).cast(pa.int64()), len(known)))
            if len(known) + len(fresh) <= CACHED_PIECES:
                self.known, self.ends, self.store = pa.concat_arrays([known, fresh]), ends, store
        slot = slot.to_numpy(zero_copy_only=False)
        return ends[slot], ends[slot + 1] - ends[slot], store

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column: first row, the ids of all its rows, and the bounds of the rows in them."""
        for s in pieces_of(column):
            first, size, store = self.look_up(s.distinct)
            index, upto = spans(first[s.at], size[s.at])
            yield s.lo, store[index], upto[s.rows]


@lru_cache(maxsize=4)
def encoder_for(path: str, special: bool = True) -> PieceEncoder:
    """The encoder of a Python worker, for a byte-level JSON file or a sentencepiece model; it outlives the task."""
    return PieceEncoder(*(byte_level(path, special) if path.endswith(".json") else sentence_pieces(path)))
