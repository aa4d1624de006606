import hashlib
import io
import struct

import pytest
import zstandard

from quillon.llm import warc


def archive(records):
    out = io.BytesIO()
    warc.write_archive(out, iter(records[2:]), records[:2])
    return out.getvalue()


def record(i, payload, refers=None):
    return warc.record_bytes(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), refers, "2000-01-01T00:00:00Z")


def test_layout_and_round_trip():
    payloads = [b"", b"a\r\n\r\nb", b"\x00\xff" * 5000] + [b"<p>%d</p>" % i * 50 for i in range(300)]
    raw = archive([record(i, p) for i, p in enumerate(payloads)])
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.SKIPPABLE and size > 0
    assert struct.unpack("<I", raw[8 + size : 12 + size])[0] == warc.FRAME
    read = list(warc.read_archive(io.BytesIO(raw)))
    assert [r.payload for r in read] == payloads and [warc.page_of(r.headers["WARC-Record-ID"]) for r in read] == list(range(len(payloads)))
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert warc.parse_record(one).payload == b""  # a frame is a record


def test_compressed_dictionary():
    raw = archive([record(i, b"text %d " % i * 40) for i in range(300)])
    size = struct.unpack("<I", raw[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(raw[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + raw[8 + size :]
    assert sum(1 for _ in warc.read_archive(io.BytesIO(again))) == 300


@pytest.mark.parametrize("damage", [lambda r: r[:-3], lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8"), lambda r: r.replace(b"payload", b"pAyload"), lambda r: r.replace(b"WARC-Date", b"WARC-Dat"), lambda r: r.replace(b"\r\n\r\n", b"\r\n", 1)])
def test_bad_records_are_errors(damage):
    good = record(1, b"payload")
    assert warc.parse_record(good).payload == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(damage(good))


@pytest.mark.parametrize("cut", [3, 20, -5])
def test_cut_archives_are_errors(cut):
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(archive([record(1, b"a" * 100), record(2, b"b")])[:cut])))


@pytest.mark.parametrize("common", [500, 1])
def test_tables(spark, monkeypatch, common):
    monkeypatch.setattr(warc, "COMMON_AT_LEAST", common)
    monkeypatch.setattr(warc, "COMMON", 10**9)
    long, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a\r\nb", long), (5, None, long), (3, "u", long), (4, "u", other), (6, "u", "short"), (7, "u", "short"), (8, "u", None), (None, "u", other), (9, "u", "y" * 3_000_000), (5, None, long)]
    pages = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "page_id long, url string, html string, digest string, first int, shared int")
    got = warc.read_archives(warc.write_archives(warc.plan_revisits(pages))).collect()
    told = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)

    def expected(page, html):
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        repeated = sum(h == html for *_, h in rows) > 1 and len(data) >= 1000
        visit = repeated and page != max(same)
        return page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", max(same) if visit else None

    assert told == sorted((expected(p, h) for p, _, h in rows), key=str)
    assert all(bytes(r.payload) == b"" if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    assert {r.url for r in got if r.page_id == 1} == {"http://a%0D%0Ab"} and {r.url for r in got if r.page_id == 5} == {None}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(pages))).count() == 0


def test_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 50) AS html")
    manifest = warc.write_archives(warc.plan_revisits(pages))
    assert manifest.count() >= 8 and warc.read_archives(manifest).count() == 50
