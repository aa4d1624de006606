"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: each task writes archives of a bounded number of records; the dictionary is trained on the archive's first
records. Files are named by a random id and listed in a manifest, which is a written table: a task that is run
again writes other files, and only those in the manifest are read. Files go to the shared folder through
Arrow's file systems (local paths, HDFS and object stores).

Reading: a file is streamed; the dictionary is loaded from the skippable frame, each frame is decoded to one record,
and the version line, the required headers, the block length and (of responses) the payload length and digest are
checked. A record that fails a check is an error, not a skipped row.

Records with equal payloads of at least MIN_REVISIT bytes are written once: the one with the largest page id is the
response, the others are revisits that refer to it and carry HTTP headers only.

Defined results: a null payload is empty; a null url has no WARC-Target-URI; rows with a null id are written with the
id `null`; repeated rows with the largest id are all responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import tasks, values
from quillon.sources.scratch import materialize, new_path

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
URN = "urn:x-page:"

MIN_REVISIT = 1000
#: Common payloads are those of more than 1 / COMMON of all pages, so there are COMMON at most.
COMMON, COMMON_AT_LEAST = 10_000, 500
RECORDS, ARCHIVE_BYTES = 4096, 64 << 20
DICTIONARY, TRAIN_RECORDS = 32 << 10, 256
READ_AT_ONCE = 1 << 20


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, digest: the payload's SHA-1 in hex. With refers_to it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A').strip()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"\r\n".join([VERSION, *(x.encode() for x in lines), b"", block]) + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.strip()] = value.strip()
    return out


def parse_record(raw: bytes) -> Record:
    """The record of one decoded frame, its headers, lengths and digest checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = _headers(lines)
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {headers['Content-Length']}")
    if headers["WARC-Type"] not in ("response", "revisit"):
        return Record(headers, payload=rest[:-4])
    top, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    http = _headers(top.split(b"\r\n")[1:])
    if headers["WARC-Type"] == "response":
        if len(payload) != int(http["Content-Length"]):
            raise ValueError(f"the payload has {len(payload)} bytes, its header says {http['Content-Length']}")
        if hashlib.sha1(payload).hexdigest() != payload_digest(headers):
            raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
    elif payload or "WARC-Refers-To" not in headers or headers.get("WARC-Profile") != PROFILE:
        raise ValueError(f"not a revisit of an identical payload: {headers['WARC-Record-ID']}")
    return Record(headers, http, payload)


def payload_digest(headers: dict[str, str]) -> str:
    kind, _, value = headers["WARC-Payload-Digest"].partition(":")
    if kind != "sha1":
        raise ValueError(f"unknown digest: {kind}")
    return base64.b32decode(value).hex()


def page_of(uri: str | None) -> int | None:
    if uri is None:
        return None
    if not uri.startswith(f"<{URN}") or not uri.endswith(">"):
        raise ValueError(f"unknown record id: {uri}")
    return None if (n := uri[len(URN) + 1 : -1]) == "null" else int(n)


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from an archive's first records; their raw beginnings where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        raw = b"".join(s[:2048] for s in samples[: DICTIONARY // 2048]) or VERSION + b"\r\nWARC-Type: response"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes], head: list[bytes]) -> None:
    """head: the first records, which the dictionary is trained on; records: the others."""
    dictionary = train(head)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for part in (head, records):
        for record in part:
            out.write(packer.compress(record))


def read_archive(source) -> Iterator[Record]:
    """The records of a stream; only a frame and a read's worth of bytes are held."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("no dictionary in a leading skippable frame")
    raw = source.read(size := struct.unpack("<I", head[4:])[0])
    if len(raw) != size:
        raise ValueError("the dictionary is cut short")
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    left = source.read(READ_AT_ONCE)
    while left:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not left:
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else source.read(READ_AT_ONCE)
        left = left or source.read(READ_AT_ONCE)
        yield parse_record(b"".join(parts))


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses).

    Digests are counted after partial aggregation. Those of more than 1 / COMMON of all pages, COMMON at most, are
    broadcast, so their pages stay where they are; other pages that may be revisits meet the row of their digest, and
    short ones are spread by a hash of the row.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    long = F.octet_length("payload") >= least
    shared = materialize(rows.where(long).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-payloads")
    bound = max(COMMON_AT_LEAST, pages.count() // COMMON)
    common = F.broadcast(shared.where(F.col("n") > bound).select(F.col("digest").alias("common"), F.col("first").alias("common_first")))
    rest = shared.where(F.col("n") <= bound).select(F.col("digest").alias("shared"), "first")
    marked = rows.join(common, (F.col("digest") == F.col("common")) & long, "left")
    spread = F.concat(F.lit("-"), F.xxhash64("page_id", "url", F.spark_partition_id(), F.monotonically_increasing_id()).cast("string"))
    keyed = marked.withColumn("key", F.when(long & F.col("common").isNull(), F.col("digest")).otherwise(spread))
    joined = keyed.join(rest, F.col("key") == F.col("shared"), "left").withColumn("to", F.coalesce("common_first", "first"))
    refers_to = F.when(F.col("to").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("to"), F.lit(False)), F.col("to"))
    return joined.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def write_archives(planned: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of plan_revisits; returns the manifest: path, records."""
    folder = folder or new_path(planned.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = arrow_fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        names, counts = [], []

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, digest, refers in zip(*(values(c) for c in batch.columns)):
                    yield record_bytes(page, url, payload.encode("utf-8", "replace"), digest, refers, date)

        def some(first: bytes, count: list[int]) -> Iterator[bytes]:
            size, record = 0, first
            while record is not None:
                count[0], size = count[0] + 1, size + len(record)
                yield record
                record = next(source, None) if count[0] < RECORDS and size < ARCHIVE_BYTES else None

        source = records()
        while (first := next(source, None)) is not None:
            path, count = f"{base}/{uuid.uuid4().hex}.warc.zst", [0]
            chosen = some(first, count)
            head = [r for _, r in zip(range(TRAIN_RECORDS), chosen)]
            with files.open_output_stream(path, compression=None) as out:
                write_archive(out, chosen, head)
            names.append(f"{folder}/{path.rpartition('/')[2]}")
            counts.append(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialize(planned.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, on demand, payload, of all archives."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told in zip(values(batch.column(0)), values(batch.column(1))):
                files, inside = arrow_fs.FileSystem.from_uri(path)
                rows, n = [], 0
                with files.open_input_stream(inside, compression=None) as source:
                    for r in read_archive(source):
                        h, n = r.headers, n + 1
                        rows.append((page_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), int(r.http["Content-Length"]), payload_digest(h), r.kind, page_of(h.get("WARC-Refers-To")), r.payload if payloads else None))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                if n != told:
                    raise ValueError(f"{path} has {n} records, its manifest says {told}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("path", "records").repartition(tasks(manifest.sparkSession)).mapInArrow(run, schema)
