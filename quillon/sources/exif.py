"""Capture metadata of image files: EXIF of JPEG and TIFF, dimensions of PNG, and a writer of such headers.

Defined results: what a file doesn't hold, or holds damaged, is null; the orientation is then 1. Nothing is ever raised for
a file's content. A capture time without an offset is read as UTC.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.maintenance import file_format

#: Bytes of a JPEG file that hold its header.
HEAD = 1 << 20
FIELDS = "width int, height int, orientation int, taken_at long, offset_min int, make string, model string, serial string, lens string, focal double, aperture double, shutter double, iso int, gps_lat double, gps_lon double, gps_time long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_COLUMNS = {name: _ARROW[kind] for name, kind in (f.split() for f in FIELDS.split(", "))}

# Tags of the format, bytes a value of each kind, JPEG markers.
WIDTH, HEIGHT, MAKE, MODEL, ORIENTATION, EXIF, GPS = 0x0100, 0x0101, 0x010F, 0x0110, 0x0112, 0x8769, 0x8825
EXPOSURE, APERTURE, ISO, TAKEN, OFFSET, FOCAL, SUBSECOND, SERIAL, LENS = 0x829A, 0x829D, 0x8827, 0x9003, 0x9011, 0x920A, 0x9291, 0xA431, 0xA434
LAT_REF, LAT, LON_REF, LON, GPS_TIME, GPS_DATE = 1, 2, 3, 4, 7, 0x1D
BYTE, ASCII, SHORT, LONG, RATIONAL, SIGNED_LONG, SIGNED_RATIONAL = 1, 2, 3, 4, 5, 9, 10
KINDS = {BYTE: "B", SHORT: "H", LONG: "I", RATIONAL: "II", SIGNED_LONG: "i", SIGNED_RATIONAL: "ii"}
APP1, SCAN, FRAMES = 0xE1, 0xDA, {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


class _Directories:
    """The tag directories of a TIFF block."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.order = raw, {b"II": "<", b"MM": ">"}.get(raw[:2], "")
        known = self.order and len(raw) >= 8 and self._read("H", 2) == (42,)
        self.first = self.at(self._read("I", 4)[0]) if known else {}

    def _read(self, kinds: str, at: int) -> tuple:
        return struct.unpack_from(self.order + kinds, self.raw, at)

    def at(self, place: Any) -> dict[int, Any]:
        """Values by tag: a text, or a list of numbers. Entries that reach beyond the block are left out."""
        found: dict[int, Any] = {}
        if not isinstance(place, int) or place + 2 > len(self.raw):
            return found
        (entries,) = self._read("H", place)
        for at in range(place + 2, min(place + 2 + 12 * entries, len(self.raw) - 11), 12):
            tag, kind, count = self._read("HHI", at)
            layout = KINDS.get(kind, "B")
            size = struct.calcsize("<" + layout) * count
            begin = at + 8 if size <= 4 else self._read("I", at + 8)[0]
            if begin + size > len(self.raw):
                continue
            if kind == ASCII:
                found[tag] = self.raw[begin : begin + size].split(b"\0")[0].decode("utf-8", "replace").strip() or None
                continue
            values = self._read(layout * count, begin)
            found[tag] = [a / b if b else None for a, b in zip(values[::2], values[1::2])] if len(layout) == 2 else list(values)
        return found


def _one(tags: dict[int, Any], tag: int) -> Any:
    value = tags.get(tag)
    return value[0] if isinstance(value, list) and value else None


def _text(tags: dict[int, Any], tag: int) -> str | None:
    value = tags.get(tag)
    return value if isinstance(value, str) else None


def _offset(text: str | None) -> int | None:
    try:
        return (-1 if text[0] == "-" else 1) * (int(text[1:3]) * 60 + int(text[4:6])) if text and text[0] in "+-" and text[3] == ":" else None
    except (ValueError, IndexError):
        return None


def _millis(day: str | None, layout: str) -> int | None:
    try:
        return None if day is None else (datetime.strptime(day, layout).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
    except ValueError:
        return None


def _degrees(tags: dict[int, Any], value: int, ref: int, negative: str) -> float | None:
    parts = tags.get(value)
    if not isinstance(parts, list) or len(parts) < 3 or None in parts[:3]:
        return None
    size = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -size if (_text(tags, ref) or "").upper() == negative else size


def _of_tiff(raw: bytes) -> dict[str, Any]:
    block = _Directories(raw)
    first = block.first
    shot, place = block.at(_one(first, EXIF)), block.at(_one(first, GPS))
    offset, taken = _offset(_text(shot, OFFSET)), _millis(_text(shot, TAKEN), "%Y:%m:%d %H:%M:%S")
    if taken is not None:
        fraction = _text(shot, SUBSECOND) or ""
        taken += (int(fraction[:3].ljust(3, "0")) if fraction.isascii() and fraction.isdigit() else 0) - 60_000 * (offset or 0)
    clock, day = place.get(GPS_TIME), _millis(_text(place, GPS_DATE), "%Y:%m:%d")
    fixed = day is not None and isinstance(clock, list) and len(clock) >= 3 and None not in clock[:3]
    return {
        "width": _one(first, WIDTH), "height": _one(first, HEIGHT), "orientation": _one(first, ORIENTATION), "taken_at": taken, "offset_min": offset,
        "make": _text(first, MAKE), "model": _text(first, MODEL), "serial": _text(shot, SERIAL), "lens": _text(shot, LENS), "focal": _one(shot, FOCAL),
        "aperture": _one(shot, APERTURE), "shutter": _one(shot, EXPOSURE), "iso": _one(shot, ISO), "gps_lat": _degrees(place, LAT, LAT_REF, "S"),
        "gps_lon": _degrees(place, LON, LON_REF, "W"), "gps_time": day + round(1000 * (clock[0] * 3600 + clock[1] * 60 + clock[2])) if fixed else None,
    }


def _of_jpeg(raw: bytes) -> dict[str, Any]:
    found: dict[str, Any] = {}
    size: dict[str, Any] = {}
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != SCAN:
        marker, length = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + length]
        if marker == APP1 and body[:6] == b"Exif\0\0" and not found:
            found = _of_tiff(body[6:])
        elif marker in FRAMES and len(body) >= 5:
            size = {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big")}
        at += 2 + length
    return found | {"width": None, "height": None} | size


def metadata(raw: bytes | None) -> dict[str, Any]:
    """The FIELDS of a file by its leading bytes."""
    raw = raw or b""
    try:
        if raw[:2] == b"\xff\xd8":
            found = _of_jpeg(raw)
        elif raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
            found = dict(zip(("width", "height"), struct.unpack(">II", raw[16:24])))
        else:
            found = _of_tiff(raw)
    except struct.error:
        found = {}
    turned = found.get("orientation")
    whole = {k: v for k, v in found.items() if not (pa.types.is_integer(_COLUMNS[k]) and v is not None and not -(1 << 31) <= v < 1 << 31 and _COLUMNS[k] == pa.int32())}
    return {k: whole.get(k) for k in _COLUMNS} | {"orientation": turned if turned in range(1, 9) else 1}


def with_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """files with their FIELDS in place of the content."""
    at, rest = files.columns.index(content), [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [metadata(raw) for raw in b.column(at).to_pylist()]
            made = [pa.array([f[k] for f in found], kind) for k, kind in _COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], *made], [*rest, *_COLUMNS])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content)
    return files.mapInArrow(run, f"{kept}, {FIELDS}" if kept else FIELDS)


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """path, format and the FIELDS of the JPEG, TIFF, PNG and raw files under root. Of a JPEG or PNG only the head leaves the JVM."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = file_format(F.element_at(F.split("path", "/"), -1))
    known = files.select("path", kind.alias("format"), "content").where("format IN ('jpeg', 'png', 'tiff', 'raw')")
    return with_metadata(known.withColumn("content", F.when(F.col("format").isin("jpeg", "png"), F.substring("content", 1, HEAD)).otherwise(F.col("content"))))


def _directory(entries: list[tuple[int, int, int, bytes]], start: int) -> bytes:
    """A little-endian directory at start with the values that don't fit into their entries behind it."""
    head, tail = struct.pack("<H", len(entries)), b""
    behind = start + 2 + 12 * len(entries) + 4
    for tag, kind, count, data in sorted(entries):
        head += struct.pack("<HHI", tag, kind, count) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", behind + len(tail)))
        tail += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
    return head + b"\0\0\0\0" + tail


def _sexagesimal(value: float) -> bytes:
    whole = round(abs(value) * 3_600_000_000)
    return struct.pack("<6I", whole // 3_600_000_000, 1, whole // 60_000_000 % 60, 1, whole % 60_000_000, 1_000_000)


def jpeg_header(f: dict[str, Any]) -> bytes:
    """A JPEG file without image data that holds the given FIELDS (gps_time, serial and make are not written)."""
    text = lambda tag, v: [] if v is None else [(tag, ASCII, len(v.encode()) + 1, v.encode() + b"\0")]
    short = lambda tag, v: [] if v is None else [(tag, SHORT, 1, struct.pack("<H", v))]
    ratio = lambda tag, v: [] if v is None else [(tag, RATIONAL, 1, struct.pack("<II", round(v * 1_000_000), 1_000_000))]
    shot = [*text(LENS, f.get("lens")), *ratio(FOCAL, f.get("focal")), *ratio(APERTURE, f.get("aperture")), *ratio(EXPOSURE, f.get("shutter")), *short(ISO, f.get("iso"))]
    if f.get("taken_at") is not None:
        local = datetime(1970, 1, 1) + timedelta(milliseconds=f["taken_at"], minutes=f.get("offset_min") or 0)
        shot += text(TAKEN, f"{local:%Y:%m:%d %H:%M:%S}") + text(SUBSECOND, f"{local.microsecond // 1000:03d}")
    if f.get("offset_min") is not None:
        shot += text(OFFSET, f"{'-' if f['offset_min'] < 0 else '+'}{abs(f['offset_min']) // 60:02d}:{abs(f['offset_min']) % 60:02d}")
    place = []
    for tag, ref, names, v in ((LAT, LAT_REF, "NS", f.get("gps_lat")), (LON, LON_REF, "EW", f.get("gps_lon"))):
        place += [] if v is None else [*text(ref, names[v < 0]), (tag, RATIONAL, 3, _sexagesimal(v))]
    top = [*text(MODEL, f.get("model")), *short(ORIENTATION, f.get("orientation"))]
    pointers = lambda a, b: [*top, (EXIF, LONG, 1, struct.pack("<I", a)), (GPS, LONG, 1, struct.pack("<I", b))]
    second = 8 + len(_directory(pointers(0, 0), 8))
    third = second + len(_directory(shot, second))
    block = b"Exif\0\0II*\0\x08\0\0\0" + _directory(pointers(second, third), 8) + _directory(shot, second) + _directory(place, third)
    frame = b"\x08" + struct.pack(">HH", f["height"], f["width"]) + b"\x01\x01\x11\x00" if f.get("width") and f.get("height") else b""
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(APP1, block) + (segment(0xC0, frame) if frame else b"") + b"\xff\xd9"


def with_headers(rows: DataFrame, out: str = "content") -> DataFrame:
    """rows with a JPEG header that holds those of their columns that are FIELDS: files for tests and synthetic catalogs."""
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([jpeg_header(r) for r in b.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{held}, `{out}` binary")
