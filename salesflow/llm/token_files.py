"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

File format (little-endian), one file per range of documents:

    magic 'DACS', version u32, number of ids u64, number of levels u32, ids per rank entry u32,
    then for each level: number of chunks u64, chunks (u8 each), continuation bitmap (bit set: the id goes on
    at the next level; least significant bit first), rank directory (u64 per RANK ids: set bits before them).

The low 8 bits of an id are in level 0, the next 8 in level 1, and so on. The chunk of the id at place i of a
level is chunk i; if its bit is set, its place at the next level is the number of set bits before i, which the
directory and at most RANK bits give. So any id is read by at most a few short reads, without decoding a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.encoding import encoder_for
from salesflow.llm.storage import new_name, open_store
from salesflow.llm.tables import table
from salesflow.session import materialize, scratch

RANK = 1024
FILE_IDS = 1 << 22       # ids after which a new file is begun
END_ID = 0
_HEAD = struct.Struct("<4sIQII")
_PLACES = "doc bigint, file string, part bigint, nth bigint, first bigint, n bigint"


def write_codes(ids: np.ndarray, out) -> None:
    """Write ids in the format above to a binary file object."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK), dtype=np.int64))[:-1]]) if len(more) else np.zeros(0)
        levels.append((len(rest), (rest & 255).astype(np.uint8), bits, ranks.astype("<u8")))
        rest = rest[more] >> 8
        if not len(rest):
            break
    out.write(_HEAD.pack(b"DACS", 1, len(ids), len(levels), RANK))
    for n, chunks, bits, ranks in levels:
        out.write(struct.pack("<Q", n) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())


class CodeFile:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        _, _, self.n, count, self.step = _HEAD.unpack(self._read(0, _HEAD.size))
        at, self.levels = _HEAD.size, []
        for _ in range(count):
            n, = struct.unpack("<Q", self._read(at, 8))
            chunks, bits, ranks = at + 8, at + 8 + n, at + 8 + n + (n + 7) // 8
            self.levels.append((n, chunks, bits, ranks))
            at = ranks + 8 * -(-n // self.step)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids at places first .. first + n - 1."""
        out, slots, shift = np.zeros(n, np.uint32), None, 0
        for _, chunks, bits, ranks in self.levels:
            if n == 0:
                break
            values = np.frombuffer(self._read(chunks + first, n), np.uint8).astype(np.uint32) << np.uint32(shift)
            if slots is None:
                out[:] = values
            else:
                out[slots] |= values
            base = first // self.step * self.step
            flags = np.unpackbits(np.frombuffer(self._read(bits + base // 8, (first + n - base + 7) // 8), np.uint8), bitorder="little")
            before, = struct.unpack("<Q", self._read(ranks + 8 * (base // self.step), 8))
            more = flags[first - base:first - base + n].astype(bool)
            slots = np.flatnonzero(more) if slots is None else slots[more]
            first, n, shift = before + int(flags[:first - base].sum()), len(slots), shift + 8
        return out


def _write_rows(folder: str, tokenizer: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        held: list[np.ndarray] = []
        index: list[tuple] = []
        size, nth, end = 0, 0, np.array([END_ID], np.uint32)

        def flush() -> pa.RecordBatch:
            name = new_name("ids", ".dac")
            with store.open_output_stream(f"{path}/{name}") as out:
                write_codes(np.concatenate(held), out)
            doc, part, n, first = zip(*index)
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array([name] * len(doc)), pa.array(part, pa.int64()),
                                    pa.array(range(nth - len(doc), nth), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                                   names=["doc", "file", "part", "nth", "first", "n"])

        for batch in batches:
            docs, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, ids, bounds in encoder.encode_column(batch.column(2)):
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), lo):
                    index.append((docs[i], parts[i], int(b - a) + 1, size))
                    held += [ids[a:b], end]
                    size, nth = size + int(b - a) + 1, nth + 1
                    if size >= FILE_IDS:
                        yield flush()
                        held, index, size = [], [], 0
        if held:
            yield flush()
    return rows


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", order: list[Column] | None = None) -> DataFrame:
    """Encode every text, append END_ID, and write the ids in ascending order of ``key`` (or ``order``) to ``folder``.

    Returns the stored index, one row per input row: doc (the key), file, first (place in the file), n (ids) and start
    (ids of all rows before it). Null texts are empty and have the end id alone; null keys come first;
    rows that repeat a key follow each other in the order of their texts' hashes. Only files that the index
    names count: a task that ran twice leaves a file that nothing points to. Runs jobs when called.
    """
    columns = [c.alias(f"order_{i}") for i, c in enumerate(order or [F.col(key)])]
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"), *columns,
                       F.xxhash64(F.col(text)).alias("text_hash"))
    by = [*[f"order_{i}" for i in range(len(columns))], "text_hash"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = ordered.select("doc", F.spark_partition_id().cast("bigint").alias("part"), "text")
    index = materialize(ordered.mapInArrow(_write_rows(folder, tokenizer), _PLACES))
    # the partitions are ranges of keys in ascending order; a few totals per partition give its start
    totals = index.groupBy("part").agg(F.sum("n").alias("ids"))
    starts = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("nth")) - F.col("n")
    placed = index.withColumn("inner_start", inner).join(starts, "part")
    return placed.select("doc", "file", "first", "n", (F.col("part_start") + F.col("inner_start")).alias("start"))


def _read_rows(folder: str, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        now, codes = None, None
        for batch in batches:
            files, first, n = (batch.column(c).to_pylist() for c in (1, 2, 3))
            crc, ids = [], []
            for name, a, k in zip(files, first, n):
                if name != now:
                    codes, now = CodeFile(store.open_input_file(f"{path}/{name}")), name
                got = codes.ids(a, k)
                crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                if with_ids:
                    ids.append(got.astype(np.int64))
            columns = [*batch.columns, pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.record_batch(columns, names=["doc", "file", "first", "n", "start", "crc", "ids"][:len(columns)])
    return rows


def read_tokens(index: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The indexed rows as read from the files: doc, file, first, n, start, crc (of the ids) and, if wanted, ids.

    The index may be filtered: only the ids of its rows are read.
    """
    near = index.select("doc", "file", "first", "n", "start").repartition("file").sortWithinPartitions("file", "first")
    return near.mapInArrow(_read_rows(folder, with_ids), "doc bigint, file string, first bigint, n bigint, start bigint, crc bigint"
                           + ", ids array<bigint>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame, tokenizer: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Write the token files of ``docs`` and describe each document from what is read back."""
    folder = scratch(docs.sparkSession).new("ids")
    index = write_tokens(docs, folder, tokenizer or default_tokenizer(), order=order)
    return read_tokens(index, folder, with_ids=False).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
