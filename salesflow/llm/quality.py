"""Quality rules: word and line counts, and bands of zstandard compression ratios.

A text that repeats itself compresses better than others of its length, noise compresses worse. The ratio depends on
the length, so every half octave of bytes has its own band, fitted on the ratios of the whole corpus. The whole
text and its fixed chunks are judged, so a stretch of noise or repetition in a long text counts too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.tables import table
from salesflow.llm.textops import SPACE, gram_hash, inside, mixed, range_hash, slices, words
from salesflow.session import materialize

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


CHUNK = 1024
LEVEL = 3
BAD_CHUNKS = 0.34       # share of chunks outside their band that fails a text
REACH = 3.0             # quartile ranges that a band reaches beyond the quartiles
LEAST_TEXTS = 100       # texts from which a length gets a band of its own
LEAST_BYTES = 256       # shorter texts say too little
_STEP = 200.0           # ratios are counted in steps of half a percent


def size_class(size: Column) -> Column:
    """The length of a text in half octaves of bytes."""
    return F.floor(2 * F.log2(size.cast("double"))).cast("int")


@dataclass(frozen=True)
class Bands:
    """Least and most bytes / compressed bytes for each size class.

    A class that is not listed takes the next listed one below it (or the first); texts and chunks below LEAST_BYTES are not judged.
    The default is for running text of any language; ``fit_bands`` finds narrower ones.
    """

    limits: tuple[tuple[int, float, float], ...] = ((16, 1.1, 4.0), (18, 1.25, 4.0), (20, 1.4, 4.0), (22, 1.6, 4.0), (24, 1.75, 3.8), (28, 1.9, 3.8))

    def outside(self, size: Column, ratio: Column) -> Column:
        """Whether a ratio is outside the band of its length; false where it is not judged."""
        first, *rest = sorted(self.limits)
        least, most = F.lit(first[1]), F.lit(first[2])
        number = size_class(size)
        for k, low, high in rest:
            least, most = F.when(number >= k, low).otherwise(least), F.when(number >= k, high).otherwise(most)
        return F.coalesce((size >= LEAST_BYTES) & ((ratio < least) | (ratio > most)), F.lit(False))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _repeats(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in their row, and which have an equal one before them."""
    _, first, back, n = np.unique(mixed(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                  return_index=True, return_inverse=True, return_counts=True)
    return n[back] > 1, first[back] != np.arange(len(h))


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    start, end, first = words(data, offsets)
    hashed = range_hash(data)
    rows = np.arange(len(offsets) - 1)
    row_of_word = np.repeat(rows, np.diff(first))
    repeated = np.zeros(len(start), bool)
    grams = gram_hash(hashed(start, end), 3)
    at = np.flatnonzero(inside(first, 3, len(start))[:len(grams)])
    again = at[_repeats(grams[at], row_of_word[at])[0]]
    for j in range(3):
        repeated[again + j] = True
    breaks = np.flatnonzero(data == 10)
    place = np.concatenate([breaks + 1, offsets[:-1]])
    opens_row = np.repeat([0, 1], [len(breaks), len(rows)])
    row_of_line = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, rows])
    order = np.lexsort((row_of_line, opens_row, place))
    line_start, row_of_line, opens_row = place[order], row_of_line[order], opens_row[order]
    line_end = np.append(line_start[1:] - (opens_row[1:] == 0), len(data))
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, row_of_line = line_start[filled], line_end[filled], row_of_line[filled]
    later = _repeats(hashed(line_start, line_end), row_of_line)[1]
    return {
        "n_words": np.diff(first),
        "word_chars": _per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(row_of_line[later], minlength=len(rows)).astype(np.int64),
        "n_repeat_words": _per_row(repeated, first),
    }


def _chunk_bounds(size: int) -> list[tuple[int, int]]:
    """Fixed chunks of a text; a rest below a quarter of a chunk belongs to the last one."""
    ends = [*range(CHUNK, size - CHUNK // 4, CHUNK), size]
    return list(zip([0, *ends[:-1]], ends))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            got = _counts(data, offsets)
            packed = data.tobytes()
            ratio, chunks = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = packed[a:b]
                ratio.append(len(text) / len(packer.compress(text)) if text else None)
                parts = _chunk_bounds(len(text)) if len(text) > CHUNK else []
                chunks.append([{"size": y - x, "ratio": (y - x) / len(packer.compress(text[x:y]))} for x, y in parts] or (
                    [{"size": len(text), "ratio": ratio[-1]}] if text else []))
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), *[pa.array(v, pa.int64()) for v in got.values()], pa.array(np.diff(offsets)),
                 pa.array(ratio, pa.float64()), pa.array(chunks, pa.list_(pa.struct([("size", pa.int64()), ("ratio", pa.float64())])))],
                names=["key", *got, "n_bytes", "ratio", "chunks"])


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, size and compression ratios of every row: the whole text's, and those of its chunks (a short text is one chunk).

    Null and empty texts have zero counts, no ratio and no chunks. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        _measure, f"key {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                  "n_bytes bigint, ratio double, chunks array<struct<size:bigint,ratio:double>>")
    return out.withColumnRenamed("key", key)


def fit_bands(measured: DataFrame, reach: float = REACH, least_texts: int = LEAST_TEXTS) -> Bands:
    """Bands from the ratios of all texts: ``reach`` quartile ranges beyond the quartiles of each size class.

    Junk of up to a quarter of a class on either side does not move them. Classes of fewer texts keep the default's band.
    Ratios are counted in steps of half a percent, so what goes to the driver is bounded whatever the number of texts.
    """
    step = F.round(F.ln("ratio") * _STEP).cast("int")
    rows = measured.where(F.col("n_bytes") >= LEAST_BYTES).groupBy(size_class(F.col("n_bytes")).alias("k"), step.alias("step")).agg(F.count(F.lit(1)).alias("w")).collect()
    found = {}
    for k in sorted({r.k for r in rows}):
        steps, counts = zip(*sorted((r.step, r.w) for r in rows if r.k == k))
        upto = np.cumsum(counts)
        if upto[-1] >= least_texts:
            low, high = (steps[int(np.searchsorted(upto, q * upto[-1]))] / _STEP for q in (0.25, 0.75))
            width = max(high - low, 0.02) * reach
            found[k] = (k, math.exp(low - width), math.exp(high + width))
    if not found:
        return Bands()
    default = {k: (k, low, high) for k, low, high in Bands().limits}
    # below and above the fitted classes the default goes on
    return Bands(tuple(sorted(({k: v for k, v in default.items() if k < min(found) or k > max(found)} | found).values())))


def judge(measured: DataFrame, bands: Bands) -> DataFrame:
    """``measured`` with n_chunks, bad_chunks, base_failed, in_band and kept.

    A text is out of band when its ratio is, or more than BAD_CHUNKS of its chunks are. Base rules: fewer than 50 words, or
    more than half of the words in repeated windows. Null and empty texts fail the base rules and are in band.
    """
    bad = F.size(F.filter("chunks", lambda c: bands.outside(c["size"], c["ratio"])))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumns({"n_chunks": F.size("chunks").cast("bigint"), "bad_chunks": bad.cast("bigint"), "base_failed": failed})
    out = out.withColumn("in_band", ~bands.outside(F.col("n_bytes"), F.col("ratio")) & (F.col("bad_chunks") <= F.lit(BAD_CHUNKS) * F.col("n_chunks")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("chunks")


def compression_bands(docs: DataFrame, bands: Bands | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Word counts, compression ratios and the verdict for every row.

    Returns ``key``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, ratio, n_chunks, bad_chunks, base_failed,
    in_band and kept. Without ``bands`` they are fitted on all rows, whose measures are stored once for it. Repeated
    rows are judged one by one; an empty table gives no rows; other columns are not read.
    """
    measured = measure(docs, text, key)
    if bands is None:
        measured = materialize(measured)
        bands = fit_bands(measured)
    return judge(measured, bands)


def rejected_shares(judged: DataFrame) -> DataFrame:
    """By size class: texts, and how many of them the base rules and (of the others) the bands reject."""
    return judged.groupBy(size_class(F.col("n_bytes")).alias("size_class")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("base_failed").alias("n_base_failed"),
        F.count_if(~F.col("base_failed") & ~F.col("in_band")).alias("n_out_of_band"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))
