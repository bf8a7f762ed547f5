"""Files in the shared folder, from inside Arrow tasks: any store that pyarrow can open by URI."""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.session import scratch


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or as an absolute path."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def new_name(prefix: str, suffix: str) -> str:
    """A name of this attempt alone: a task that runs again writes another file, and only the index of
    the attempt that succeeded names its files."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def packed(numbers: np.ndarray) -> bytes:
    """An array of numbers as little-endian bytes, compressed."""
    return zstandard.compress(numbers.astype(numbers.dtype.newbyteorder("<")).tobytes(), 1)


def unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.dtype(kind).newbyteorder("<"))


def stored_blocks(rows: DataFrame, by: str, size: int) -> tuple[str, list[str]]:
    """Store a query set in files of about ``size`` rows, all rows of a ``by`` in one file; the folder and the file names.

    Tasks read the files one at a time (``read_block``), so a set of any size meets all rows in one pass and bounded memory.
    """
    blocks = rows.count() // size + 1
    folder = scratch(rows.sparkSession).new("blocks")
    rows.repartition(blocks, by).write.parquet(folder)
    names = rows.sparkSession.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_name")).distinct()
    return folder, sorted(r[0] for r in names.collect())


@lru_cache(maxsize=2)
def read_block(folder: str, name: str) -> pa.Table:
    """One file of ``stored_blocks``, kept by the worker while it is in use."""
    store, path = open_store(folder)
    return pq.read_table(f"{path}/{name}", filesystem=store)
