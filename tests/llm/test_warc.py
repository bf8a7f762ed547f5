"""WARC archives: round trip, revisits, partial reads."""

import gzip
import hashlib
import re

from pyspark.sql import functions as F

from salesflow.llm.warc import parse_record, read_records, write_archives

BIG = "é" * 600


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", BIG, "x"), (7, "http://a/7", BIG, "y"), (3, None, BIG, "z"), (4, "http://a/4", "small", "z"), (5, "http://a/5", "small", None),
            (6, "u\r\nX: y", None, "n"), (8, "http://a/8", "", "n"), (7, "http://a/7", BIG, "y"), (None, "http://a/n", BIG, "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    folder = str(tmp_path / "warc")
    index = write_archives(df, folder)
    got = {(r.id, r.record_type): r for r in read_records(index, folder).collect()}
    assert index.count() == len(rows)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got[7, "response"].payload == BIG.encode() and got[7, "response"].refers_to is None
    for k in (1, 3):
        r = got[k, "revisit"]
        assert (r.refers_to, r.payload_bytes, r.payload_digest, r.payload) == (7, 1200, sha(BIG), None)
    assert got[4, "response"].payload == got[5, "response"].payload == b"small"
    assert got[6, "response"].payload_bytes == got[8, "response"].payload_bytes == 0 and got[6, "response"].payload_digest == sha("")
    assert got[None, "response"].payload == BIG.encode() and got[3, "revisit"].url is None
    one = read_records(index.where(F.col("id") == 4), folder).collect()
    assert [r.payload for r in one] == [b"small"]


def test_archives_are_plain_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in [*range(20), 7]], "page_id bigint, url string, html string")
    folder = tmp_path / "warc"
    index = write_archives(df, str(folder)).collect()
    names = set()
    for f in {r.file for r in index}:
        data = (folder / f).read_bytes()
        mine = sorted((r.offset, r.length, r.id) for r in index if r.file == f)
        assert sum(n for _, n, _ in mine) == len(data)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(mine)
        for at, n, k in mine:
            fields, body = parse_record(data[at:at + n])
            names.add(fields["warc-record-id"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
            assert fields["warc-target-uri"] == f"http://a/{k}" and body == f"page {k} ".encode() * 50
    assert len(names) == len(index) == 21   # also for the page that is there twice


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = str(tmp_path / "warc")
    assert read_records(write_archives(df, folder), folder).collect() == []
