"""WARC archives: an index of records first, then coalesced sorted byte-range reads of the selected records."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.storage import new_name, open_store
from salesflow.llm.tables import table
from salesflow.session import materialize, scratch

LEAST_REVISIT = 1000      # smaller payloads are always stored in full
FILE_BYTES = 64 << 20     # archive size after which a new one is begun
GAP_BYTES = 64 << 10      # unwanted bytes between two records that are read along
READ_BYTES = 8 << 20      # most bytes of one read
CHUNK_BYTES = 32 << 20    # bytes of an archive that one group of reads covers
SALTS = 16

_INDEX = "file string, offset bigint, length bigint, id bigint, url string, digest string, kind string, refers_to bigint"
_RECORDS = "file string, offset bigint, id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _record(name: str, date: str, page: int | None, url: str | None, kind: str, refers: dict | None, payload: bytes, digest: str) -> bytes:
    def line(uri: str) -> str:
        return uri.replace("\r", "%0D").replace("\n", "%0A")

    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers['id']}"]
        if refers["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {line(refers['url'])}")
        payload = b""
    text = "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)   # every record is a gzip member of its own
    return packer.compress(text + payload + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and content of one record from its gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:]))
    return fields, rest[:int(fields["content-length"])]


def _write_rows(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name, out, at = None, None, 0
        index: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*index)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if out is None:
                    name, at = new_name("pages", ".warc.gz"), 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                kind = "response" if refers is None else "revisit"
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")   # files of an attempt have names of their own
                data = _record(str(record), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), page, url, kind, refers, payload, digest)
                out.write(data)
                index.append((name, at, len(data), page, url, digest, kind, refers and refers["id"]))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
                    yield batch_of()
                    index = []
        if out is not None:
            out.close()
        if index:
            yield batch_of()
    return rows


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row and return the stored index: file, offset, length, id, url, digest, kind, refers_to.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, one with the largest ``key`` is a response and the
    rows with smaller keys are revisits that refer to it; rows that repeat the largest key are responses too, and so
    is a row without a key. Null html is an empty payload. Only files that the index names count: a task that ran
    twice leaves a file that nothing points to. Runs jobs when called.

    Only digests of payloads that occur again are joined back; their counts are combined before the shuffle.
    """
    text = F.coalesce(F.col(html), F.lit("")).cast("string")
    digest = F.when(F.octet_length(text) >= LEAST_REVISIT, F.sha1(text.cast("binary")))
    again = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), digest.alias("payload")).where("payload is not null")
    again = again.groupBy("payload").agg(F.max(F.struct("id", "url")).alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # one page may be most of the rows: its copies are dealt over SALTS partitions, the few keepers are repeated as often
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # payloads without a digest get a key of their own, so that they don't meet in one partition
    same = F.coalesce(digest, F.concat(F.lit("-"), F.xxhash64(F.col(key), F.col(url)).cast("string")))
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
                        same.alias("payload")).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(again, ["payload", "salt"], "left")
    refers = F.when(F.col("id") < F.col("keeper.id"), F.col("keeper"))
    return materialize(joined.select("id", "url", "html", refers.alias("refers_to")).mapInArrow(_write_rows(folder), _INDEX))


def _read_rows(folder: str, with_payload: bool):
    def decode(data: bytes) -> tuple:
        fields, payload = parse_record(data)
        page, kind, refers = fields.get("x-page-id"), fields["warc-type"], fields.get("x-refers-to-page-id")
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if fields["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError(f"record {page}: payload and digest differ")
        else:
            size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"][len("sha1:"):]
        return (page and int(page), fields.get("warc-target-uri"), kind, refers and int(refers), size, digest,
                payload if with_payload and kind == "response" else None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        now, source = None, None
        for batch in batches:
            files = batch.column(0).to_pylist()
            offset, length = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            out, i = [], 0
            while i < len(files):
                j = i + 1   # extend the read while the next record is near and the read stays short
                while (j < len(files) and files[j] == files[i] and offset[j] - offset[j - 1] - length[j - 1] <= GAP_BYTES
                       and offset[j] + length[j] - offset[i] <= READ_BYTES):
                    j += 1
                if files[i] != now:
                    source, now = store.open_input_file(f"{path}/{files[i]}"), files[i]
                base = int(offset[i])
                data = source.read_at(int(offset[j - 1] + length[j - 1]) - base, base)
                out += [decode(data[offset[k] - base:offset[k] - base + length[k]]) for k in range(i, j)]
                i = j
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  names=[c.split()[0] for c in _RECORDS.split(", ")])
    return rows


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of an index, which may be filtered first: id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for revisits, or if not wanted).

    The selected records are dealt out by stretches of CHUNK_BYTES of an archive and sorted by offset; neighbours
    are fetched in one read. Responses are checked against their digest.
    """
    wanted = index.select("file", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / CHUNK_BYTES))
    wanted = wanted.repartition("file", "chunk").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return wanted.mapInArrow(_read_rows(folder, with_payload), _RECORDS).drop("file", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark).new("warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    out = read_records(index, folder, with_payload=False)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, STRLEN(COALESCE(html, '')) AS n, SHA1(COALESCE(html, '')) AS digest FROM pages),
k AS (SELECT digest, MAX(page_id) AS keeper FROM p WHERE n >= {LEAST_REVISIT} GROUP BY digest)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""
