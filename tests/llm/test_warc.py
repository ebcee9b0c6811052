import hashlib
import io
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import warc
from sightline.llm.common import shared_dir


def expected(rows):
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            least[b] = min(i, least.get(b, i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = least.get(b) if i is not None and len(b) >= 100 else None
        visit = first is not None and first < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if visit else "response", first if visit else None, u, None if visit else (h or "")))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, r.payload) for r in warc.round_trip(df, **kw).collect()), key=str)


BIG = 2**53 + 1
ROWS = [
    (1, "http://a/", "x" * 100), (2, "http://b/", "x" * 100), (3, None, "x" * 99), (4, "u\r\nInjected: 1\r\n\r\n%0D", "x" * 99), (5, "", None), (6, "é", ""), (None, "n", "x" * 100),
    (7, "c", "é" * 50), (8, "d", "é" * 50), (BIG, "e", "x" * 100), (BIG + 1, "f", "y" * 500_000), (2, "http://b/", "x" * 100), (1, "again", "x" * 100), (9, "g", "\r\n\r\nWARC/1.1\r\n" * 20),
]


def test_odd_pages(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string")
    assert got(df) == expected(ROWS)
    assert got(df, roll_bytes=1000) == expected(ROWS)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_heavy_payload(spark):
    rows = [(i, f"u{i}", "same " * 40 if i % 3 else f"own {i} " * 30) for i in range(900, 0, -1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(df) == expected(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(df) == expected([(r.page_id, r.url, r.html) for r in df.collect()])


def records(n=60):
    return [f"record {i} of text that is alike in every one of them, {i * 37 % 11}\n".encode() * 40 for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=30), st.integers(1, 64))
def test_any_records_in_any_chunks(items, chunk):
    assert list(warc.iter_records(io.BytesIO(warc.archive_bytes(items)), chunk)) == items


def test_dictionary_leads_and_is_needed():
    data = warc.archive_bytes(records())
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE_DICTIONARY
    assert list(warc.iter_records(io.BytesIO(data))) == records()
    with pytest.raises(warc.WarcError):
        list(warc.iter_records(io.BytesIO(data[8 + size :])))
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    stored = struct.pack("<II", magic, len(plain)) + plain + data[8 + size :]
    assert list(warc.iter_records(io.BytesIO(stored))) == records()


@pytest.mark.parametrize("cut", [5, 40, -1, -9])
def test_cut_archives_fail(cut):
    with pytest.raises(warc.WarcError):
        list(warc.iter_records(io.BytesIO(warc.archive_bytes(records())[:cut])))


GOOD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n"


def test_headers_and_lengths_are_checked():
    assert warc._parsed(GOOD)["payload"] == "abc"
    for bad in (GOOD.replace(b"WARC/1.1", b"WARC/9"), GOOD.replace(b"Length: 8", b"Length: 9"), GOOD.replace(b"Length: 8", b"Length: x"), GOOD.replace(b"WARC-Date: 2020\r\n", b""), GOOD.replace(b"WARC-Type:", b"WARC-Type"), GOOD[:-1], GOOD.replace(b"\r\n\r\n", b"\r\n"), GOOD.replace(b"Content-Length", b"WARC-Payload-Digest: sha256:00\r\nContent-Length")):
        with pytest.raises(warc.WarcError):
            warc._parsed(bad)


def test_manifest_count_is_checked(spark):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/w"
    manifest = warc.write_archives(warc.planned(df), folder)
    assert manifest.agg({"records": "sum"}).first()[0] == 3
    with pytest.raises(Exception, match="expected"):
        warc.read_archives(manifest.selectExpr("archive", "archive_bytes", "records + 1 AS records"), folder).collect()


def test_records_of_unbounded_length_fail():
    data = warc.archive_bytes([b"x" * 5000, b"y"])
    with pytest.raises(warc.WarcError, match="more than 4000 bytes"):
        list(warc.iter_records(io.BytesIO(data), most=4000))


def test_files_are_archives_and_repeated_rows_have_ids_of_their_own(spark):
    """Read as plain bytes: a skippable frame with the dictionary, if any, then a frame for each record."""
    pages = spark.createDataFrame([(1, "http://a.org/", "x" * 200)] * 5, "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/warc"
    manifest = warc.write_archives(warc.planned(pages), folder)
    ids = [line for r in manifest.collect() for record in warc.iter_records(open(r.archive, "rb")) for line in record.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 5


def test_more_partitions_than_tasks(spark):
    """A task that runs through several partitions writes files of their own for each."""
    rows = spark.range(700).selectExpr("id AS key", "'http://a.org/' AS url", "repeat('x', 150) AS payload", "150L AS payload_bytes", "sha2(repeat('x', 150), 256) AS payload_digest", "'response' AS record_type", "CAST(NULL AS LONG) AS refers_to").repartition(100)
    folder = f"{shared_dir(spark)}/warc"
    back = warc.read_archives(warc.write_archives(rows, folder), folder)
    assert sorted(r.page_id for r in back.collect()) == list(range(700))
