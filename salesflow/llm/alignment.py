"""Alignment of two tokenizers' tokens by the bytes that they cover.

The pipeline runs on Arrow arrays. Token lists are flattened beside their parent indices; a segmented cumulative sum of
token lengths gives every token's end; an outer hash join of both sides on (document, end) gives all ends, and the next
token of each side at an end is the one that covers the bytes before it, so every row is a link and rows with both sides
are cuts. Both tokenizers end a token before every single space between two words, so the documents of the pipeline are
the distinct pieces between those cuts (see ``encoding``), each aligned once per block of texts. Distinct id pairs per text
are counted with ``Table.group_by``; Spark merges the counts of all blocks and sends each block the totals of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.encoding import PieceEncoder, bounds_of, encoder_for, pieces_of, spans
from salesflow.llm.storage import packed, unpacked
from salesflow.llm.tables import table
from salesflow.llm.textops import slices
from salesflow.session import materialize

BLOCK_BYTES = 4 << 20   # text whose pairs are counted together
CHUNK_PIECES = 1 << 16   # pieces that are aligned, or whose links are expanded, together
_END_BITS = 32
_STRING = lambda s: pa.scalar(s, pa.large_string())
_BLOCK = ("a array<int>, b array<int>, docs array<bigint>, links binary, link_rows binary, keys array<bigint>, n_a array<bigint>, "
          "n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, at binary, at_rows binary")
_RESULT = ["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of every row of a flat array."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[rows])


def _tokens(pieces: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the pieces, the bounds of the pieces in them, and which pieces the ids spell back."""
    first, size, store = encoder.look_up(pieces)
    index, rows = spans(first, size)
    ids, words = store[index], encoder.vocabulary
    data, offsets = bounds_of(pieces)
    ok = _sums(words.size[ids], rows) == np.diff(offsets)
    mine = np.repeat(ok, size)
    place, bounds = spans(offsets[:-1][ok], np.diff(offsets)[ok])
    differs = words.spell(ids[mine]) != data[place]
    ok[np.flatnonzero(ok)] = _sums(differs, bounds) == 0
    return ids, rows, ok


def _ends(ids: np.ndarray, rows: np.ndarray, sizes: pa.Array) -> tuple[pa.Array, pa.Table]:
    """The flat ids, and a table of document-end keys with the place of the token that ends there."""
    lists = pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), pa.array(ids.astype(np.int32)))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(pa.array(rows[:-1], pa.int64()))
    end = pc.subtract(total, before.take(parent))
    key = pc.bit_wise_or(pc.shift_left(parent, _END_BITS), end)
    return flat, pa.table({"key": key, "at": pa.array(np.arange(len(flat)))})


@dataclass
class Aligned:
    """Links (a, b) and groups of a list of documents, flat, with the bounds of the documents."""

    a: np.ndarray
    b: np.ndarray
    rows: np.ndarray          # of the links
    n_groups: np.ndarray
    groups: pa.Array          # 'a1,a2|b1;a3|b2,b3' for each document


def align(ids_a: np.ndarray, rows_a: np.ndarray, ids_b: np.ndarray, rows_b: np.ndarray, size_a: pa.Array, size_b: pa.Array) -> Aligned:
    """Align two token lists of each document; both sides of a document spell the same bytes."""
    flat_a, ends_a = _ends(ids_a, rows_a, size_a)
    flat_b, ends_b = _ends(ids_b, rows_b, size_b)
    both = ends_a.join(ends_b, "key", join_type="full outer", right_suffix="_b", use_threads=False).sort_by("key").combine_chunks()
    cut = pc.and_(pc.is_valid(both["at"]), pc.is_valid(both["at_b"])).to_numpy()
    at_a, at_b = (pc.fill_null_backward(both[c]).to_numpy() for c in ("at", "at_b"))
    parent = pc.shift_right(both["key"], _END_BITS).to_numpy()
    documents = np.arange(len(rows_a))
    in_group = []
    for flat, at in ((flat_a, at_a), (flat_b, at_b)):
        bounds = pa.array(np.append(0, at[cut] + 1), pa.int64())
        in_group.append(pc.binary_join(pa.LargeListArray.from_arrays(bounds, flat.cast(pa.large_string())), _STRING(",")))
    group_rows = np.searchsorted(parent[cut], documents)
    joined = pc.binary_join_element_wise(*in_group, _STRING("|"))
    groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(group_rows, pa.int64()), joined), _STRING(";"))
    return Aligned(flat_a.to_numpy()[at_a], flat_b.to_numpy()[at_b], np.searchsorted(parent, documents), np.diff(group_rows), groups)


def joined(parts: list[Aligned]) -> Aligned:
    """The parts of a list of documents as one."""
    if not parts:
        none = np.zeros(0, np.int64)
        return Aligned(none, none, np.zeros(1, np.int64), none, pa.array([], pa.large_string()))
    before = np.append(0, np.cumsum([p.rows[-1] for p in parts]))
    rows = [p.rows[:-1] + n for p, n in zip(parts, before)]
    return Aligned(np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]), np.append(np.concatenate(rows), before[-1]),
                   np.concatenate([p.n_groups for p in parts]), pa.concat_arrays([p.groups for p in parts]))


def _pair_counts(doc: np.ndarray, piece: np.ndarray, links: np.ndarray, rows: np.ndarray) -> pa.Table:
    """In how many documents each pair is: ``pair``, ``count_all``; (doc, piece) says which pieces a document holds."""
    held = pa.table({"doc": doc, "piece": piece}).group_by(["doc", "piece"], use_threads=False).aggregate([])
    piece = held["piece"].to_numpy()
    index, bounds = spans(rows[piece], np.diff(rows)[piece])
    pairs = pa.table({"doc": np.repeat(held["doc"].to_numpy(), np.diff(bounds)), "pair": links[index]})
    pairs = pairs.group_by(["doc", "pair"], use_threads=False).aggregate([])
    return pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")])


def _chunks(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_PIECES pieces; a longer text is one of its own."""
    lo = 0
    while lo < len(rows) - 1:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + CHUNK_PIECES, side="right")) - 1)
        yield lo, hi
        lo = hi


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _blob(numbers: np.ndarray) -> pa.Array:
    return pa.array([packed(numbers)], pa.binary())


def _block_rows(path_a: str, path_b: str, with_groups: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_a, encoder_b = encoder_for(path_a, special=False), encoder_for(path_b)
        size_a, size_b = (pa.array(e.vocabulary.size, pa.int64()) for e in (encoder_a, encoder_b))
        width = len(encoder_b.vocabulary.size)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1), BLOCK_BYTES):
                text = pc.fill_null(batch.column(1).slice(lo, hi - lo).cast(pa.large_string()), "")
                spaced = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(_STRING(""), text, _STRING(" ")))
                s, = pieces_of(spaced, 2 * BLOCK_BYTES + pc.max(pc.binary_length(spaced)).as_py())
                ids_a, rows_a, ok_a = _tokens(s.distinct, encoder_a)
                ids_b, rows_b, ok_b = _tokens(s.distinct, encoder_b)
                ok = ok_a & ok_b
                n_a, n_b = (np.where(ok, np.diff(r), 0) for r in (rows_a, rows_b))
                ids_a, ids_b = ids_a[np.repeat(ok, np.diff(rows_a))], ids_b[np.repeat(ok, np.diff(rows_b))]
                rows_a, rows_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
                found = joined([align(ids_a[rows_a[x]:rows_a[y]], rows_a[x:y + 1] - rows_a[x], ids_b[rows_b[x]:rows_b[y]], rows_b[x:y + 1] - rows_b[x],
                                      size_a, size_b) for x, y in _chunks(np.arange(len(ok) + 1))])
                pair, links = np.unique(found.a.astype(np.int64) * width + found.b, return_inverse=True)
                held = np.diff(s.rows)
                good = _sums(~ok[s.at], s.rows) == 0
                at, at_rows = s.at[np.repeat(good, held)], np.append(0, np.cumsum(np.where(good, held, 0)))
                docs, shown = np.zeros(len(pair), np.int64), []
                for x, y in _chunks(at_rows):
                    part, rows_in = at[at_rows[x]:at_rows[y]], at_rows[x:y + 1] - at_rows[x]
                    counts = _pair_counts(np.repeat(np.arange(y - x), np.diff(rows_in)), part, links, found.rows)
                    docs[counts["pair"].to_numpy()] += counts["count_all"].to_numpy()
                    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(rows_in, pa.int64()), found.groups.take(pa.array(part))), _STRING(";"))
                    shown += texts.to_pylist() if with_groups else [hashlib.sha256(g).hexdigest() if g else "" for g in texts.cast(pa.large_binary()).to_pylist()]
                seen = np.flatnonzero(docs)   # pairs of rejected texts alone are not
                number = np.full(len(pair), -1, np.int32)
                number[seen] = np.arange(len(seen))
                pa.default_memory_pool().release_unused()
                whole = pa.int64()
                yield pa.record_batch([
                    _list((pair[seen] // width).astype(np.int32), pa.int32()), _list((pair[seen] % width).astype(np.int32), pa.int32()),
                    _list(docs[seen], whole), _blob(number[links]), _blob(found.rows),
                    _list(batch.column(0).slice(lo, hi - lo).to_pylist(), whole),
                    *[_list(_sums(x[at], at_rows), whole) for x in (n_a, n_b, found.n_groups, np.diff(found.rows))],
                    _list(shown, pa.string()), _blob(at.astype(np.int32)), _blob(at_rows),
                ], names=[c.split()[0] for c in _BLOCK.split(", ")])
    return rows


def _settle(block: pa.Table, totals: pa.Table) -> pa.Table:
    """The rows of a block's documents, from the corpus-wide counts of the block's pairs."""
    row = {c: block[c][0] for c in block.column_names}
    links, link_rows, at, at_rows = (unpacked(row[c].as_py(), t) for c, t in (("links", np.int32), ("link_rows", np.int64), ("at", np.int32), ("at_rows", np.int64)))
    # one more entry, which links of rejected texts alone (-1) point to
    docs, best = np.zeros(totals.num_rows + 1, np.int64), np.zeros(totals.num_rows + 1, np.int64)
    number = totals["number"].to_numpy()
    docs[number], best[number] = totals["docs"].to_numpy(), totals["best"].to_numpy(zero_copy_only=False)
    columns = [row[c].values for c in ("keys", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(_sums(_sums(x[links], link_rows)[at], at_rows)) for x in (best, docs)]
    return pa.table([*columns, row["groups"].values], names=_RESULT)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, docs, best) for every linked id pair: in how many texts it is, and whether no pair of ``a`` is in more."""
    pairs = blocks.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    most = totals.groupBy(F.col("a").alias("of")).agg(F.max("docs").alias("most"))
    return totals.join(most, F.col("a") == F.col("of")).select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", with_groups: bool = True) -> DataFrame:
    """The stored alignment of all texts, one row per block of about BLOCK_BYTES of text. Runs a job when called."""
    rows = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return materialize(rows.mapInArrow(_block_rows(path_a, path_b, with_groups), _BLOCK).withColumn("block", F.monotonically_increasing_id()))


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", key: str = "doc_id",
                     with_groups: bool = True) -> DataFrame:
    """Align a byte-level BPE vocabulary (A, of a space and the text) with a sentencepiece one (B, which adds the space).

    Returns per row: ``key``, n_a and n_b (tokens), n_groups (stretches between offsets where both sides end a token), n_links
    (A-B occurrences whose bytes overlap), n_best (links whose pair is in as many texts as any pair of its A id), count_sum (over the
    links, the number of texts that hold their pair) and groups ('a1,a2|b1;a3|b2,b3'; or its SHA-256 without ``with_groups``).
    Null and empty texts, and those that one side does not spell back, have no tokens: zeros and ''. Every row counts as a text of its
    own, also when it repeats another; null keys are kept; an empty table gives no rows; other columns are not read. Runs a job when
    called. A block goes through the two tokenizers once; what is shuffled is its distinct pairs and its list of piece numbers.
    """
    import public_tokenizers

    blocks = aligned_blocks(docs, path_a or public_tokenizers.path("byte_bpe_50k.json"),
                            path_b or public_tokenizers.path("piece_bpe_32k.model"), text, key, with_groups)
    own = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("number", "p")).select("block", "number", "p.*")
    back = own.join(pair_counts(blocks).hint("shuffle_hash"), ["a", "b"]).select("block", "number", "docs", "best")
    parts = blocks.select(F.col("block").alias("part"), *[c.split()[0] for c in _BLOCK.split(", ")][3:])
    found = parts.groupBy("part").cogroup(back.groupBy("block")).applyInArrow(
        _settle, ", ".join(f"{c} {'string' if c == 'groups' else 'bigint'}" for c in _RESULT))
    return found.withColumnRenamed("doc", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), with_groups=False).withColumnRenamed("groups", "groups_sha256")
