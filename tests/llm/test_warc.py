"""Archives: round trip, splits at every byte, roles of equal payloads, broken files."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.llm import warc
from reelmill.session import fresh_path
from tests.conftest import SF

PAGES = [(1, "http://a/", "<p>same</p>"), (7, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://c/ x\r\ny", None), (5, "http://d/", ""),
         (6, "http://e/", "é𝄞" * 50_000), (None, "http://f/", "<p>same</p>"), (None, "http://g/", "alone"), (8, "http://h/", "twice"), (8, "http://h/", "twice"),
         (9, "http://i/", "x")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "f", "d") for p in PAGES], "page_id long, url string, html string, salt int, file string, digest string")


def plain(rows, min_bytes=0):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        top = max(ids, default=None)
        revisit = len(body) >= min_bytes and top is not None and page_id != top
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((str(page_id), len(body), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def rows_of(records):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_rows(records).collect()), key=str)


@pytest.mark.parametrize("split", [97, 4096, warc.SPLIT])
def test_round_trip(spark, pages, split):
    files = warc.write_archives(pages, fresh_path(spark, "warc"))
    records = warc.read_archives(files, split).cache()
    assert rows_of(records) == plain(PAGES)
    bodies = [r.payload.decode() for r in records.filter("record_type = 'response'").collect()]
    copies = {(1, "<p>same</p>"), (3, "<p>same</p>"), (None, "<p>same</p>"), (4, None)}
    assert sorted(bodies) == sorted((h or "") for p, _, h in PAGES if (p, h) not in copies)
    assert {r.target_uri for r in records.collect()} >= {"http://c/%20x%0D%0Ay", None}
    assert records.filter("payload IS NOT NULL AND record_type = 'revisit'").isEmpty()


def test_all_pages_and_many_copies(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    hot = spark.range(100_000, 103_000).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.lit("<p>hot</p>").alias("html"))
    both = pages.unionByName(hot)
    files = warc.write_archives(both, fresh_path(spark, "warc"), file_bytes=20_000)
    assert files.count() > 4
    assert rows_of(warc.read_archives(files, 10_000, False)) == plain([tuple(r) for r in both.collect()])


def test_small_payloads_are_responses(spark, pages):
    files = warc.write_archives(pages, fresh_path(spark, "warc"), min_bytes=8)
    assert rows_of(warc.read_archives(files)) == plain(PAGES, 8)
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))).collect() == []


def test_files_are_plain_warc(spark, pages):
    for r in warc.write_archives(pages.filter("page_id = 6"), fresh_path(spark, "warc")).collect():
        text = gzip.open(r.file.removeprefix("file:")).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Type: response") == 1 and r.n == 1


def test_string_ids(spark):
    rows = [("a/b é>", "u", "x"), ("z", "u", "x")]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), fresh_path(spark, "warc"))
    got = warc.page_rows(warc.read_archives(files), "string").collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [("a/b é>", "z"), ("z", None)]


def test_every_split_owns_each_record_once():
    members = [warc.page_record(str(i), "http://u/", bytes([65 + i]) * 50 * i, None, False) for i in range(6)]
    noise = b"\x1f\x8b\x08\x00junk" + gzip.compress(b"no record") + b"\x1f\x8b\x1f\x8b\x08"
    data = members[0] + noise + b"".join(members[1:]) + noise
    starts = [data.index(m) for m in members]
    file = pa.BufferReader(data)
    assert [at for at, _ in warc.owned(file, 0, len(data))] == starts
    for cut in range(len(data) + 1):
        parts = [[at for at, _ in warc.owned(file, a, b)] for a, b in ((0, cut), (cut, len(data)))]
        assert parts == [[s for s in starts if s < cut], [s for s in starts if s >= cut]]


def test_magic_across_blocks(monkeypatch):
    monkeypatch.setattr(warc, "_PIECE", 512)
    member = warc.page_record("1", None, b"x", None, False)
    for gap in range(1, 1100, 7):
        file = pa.BufferReader(b"\x1f" * gap + member)
        source = warc._Bytes(file, 512)
        assert source.find(0, 2000) == gap
        assert [at for at, _ in warc.owned(file, 0, gap + 1)] == [gap]


def test_broken_member_is_an_error():
    member = warc.page_record("1", None, bytes(range(256)) * 2000, None, False)
    with pytest.raises(ValueError, match="broken member"):
        list(warc.owned(pa.BufferReader(member[:-20]), 0, len(member)))
    changed = member[:-8] + bytes([member[-8] ^ 1]) + member[-7:]  # its checksum
    with pytest.raises(ValueError, match="broken member"):
        list(warc.owned(pa.BufferReader(changed), 0, len(member)))
