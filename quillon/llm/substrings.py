"""Substring dedup by content-defined chunking.

1. A gear rolling hash over the last 16 bytes marks places to cut, at the ends of words (characters of scripts without
   spaces count as words), and at the end of any character once UNSPACED bytes have no white space. A cut depends on
   the bytes around it alone, so a passage is cut alike wherever it stands and insertions before it shift nothing.
   Texts are chunked once, into a written table.
2. Chunks are counted by half of their 128-bit digest, pre-aggregated before the shuffle; only chunks seen more than
   once go on, joined back by digest. Digests with more than 1 / COMMON of all chunks, COMMON at most, are broadcast
   first, and their places are dealt out in as many parts as keep each under that share, so they never meet in one
   task. Each place is compared with the smallest place of its whole digest.
3. Per document, stretches of neighbouring chunks that all stand at an earlier place too are repeats if they have at
   least MIN_WORDS words, be it one chunk or many. The earliest copy of every chunk stays, as do shorter stretches.

A document is an id and the 128-bit MD5 of its text; places are ordered by (id, MD5, first byte). Defined results: null
and empty texts have no chunks and stay; rows with a null id come before all others, and each text among them is a
document of its own; rows repeated with equal id and text are one document and fare alike; texts of any length are
chunked whole, block by block; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import values
from quillon.sources.scratch import materialize

WINDOW, CUT_BITS = 16, 2
SHORTEST, LONGEST = 12, 160
UNSPACED = 48
MIN_WORDS = 20
BLOCK = 4 << 20
#: Common digests are those with more than 1 / COMMON of all chunks, so there are COMMON at most.
COMMON, COMMON_AT_LEAST = 10_000, 500
_DOCUMENT = ["id", "k1", "k2"]


def _gear(seed: int = 42) -> np.ndarray:
    """256 random words by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Second bytes of scripts without spaces: Thai, Lao and Tibetan after E0, Burmese and Khmer after E1.
AFTER_E0, AFTER_E1 = np.isin(np.arange(256), range(0xB8, 0xC0)), np.isin(np.arange(256), [0x80, 0x81, 0x82, 0x9E, 0x9F])
#: Characters of scripts without spaces (kana and Han besides), and ideographic and full-width punctuation.
_CHARACTER = re.compile(rb"\xE0[\xB8-\xBF].|\xE1[\x80-\x82\x9E\x9F].|\xE3[\x81-\xBF].|[\xE4-\xE9]..|\xEF[\xA4-\xAB].|\xF0[\xA0-\xBF]..", re.DOTALL)
_MARK = re.compile(rb"\xE3\x80.|\xEF\xBC.", re.DOTALL)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes that end at each place: each doubling adds the half before, shifted."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def n_words(chunk: bytes) -> int:
    """Words between white space; characters of scripts without spaces are words."""
    if chunk.isascii():
        return len(chunk.split())
    rest, characters = _CHARACTER.subn(b" ", chunk)
    return characters + len(_MARK.sub(b" ", rest).split())


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks."""
    found = []
    for at in range(0, len(data), BLOCK):
        low = max(0, at - UNSPACED)
        part = data[low : at + BLOCK + 1]
        marked = (gear_hash(part) >> np.uint32(WINDOW - 1)) & np.uint32((1 << CUT_BITS) - 1) == 0
        word_end = SPACES[part]
        place, last = np.arange(len(part)), np.r_[(part[1:] & 0xC0) != 0x80, True]
        long = place - np.maximum.accumulate(np.where(word_end, place, -1)) >= UNSPACED
        word_end = word_end | (long & last)
        after, wide = np.r_[part[1:], np.uint8(0)], part >= 0xE3
        wide |= ((part == 0xE0) & AFTER_E0[after]) | ((part == 0xE1) & AFTER_E1[after])
        if wide.any():  # three or four bytes: ends two or three bytes on, before a new character
            word_end = word_end | (np.r_[False, False, wide[:-2]] & last) | (np.r_[False, False, False, part[:-3] >= 0xF0] & last)
        ends = np.flatnonzero(marked & word_end) + 1 + low
        found.append(ends[(ends > at) & (ends <= at + BLOCK)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes | np.ndarray, places: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one text."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
    ends, last, size = [], 0, len(raw)
    for c in [*(cut_places(raw) if places is None else places).tolist(), size]:
        while c - last > LONGEST:
            last = _forced_end(raw, last)
            ends.append(last)
        if c - last >= SHORTEST and c < size:
            ends.append(c)
            last = c
    if size > last:
        ends.append(size)
    return ends


def _forced_end(raw: np.ndarray, start: int) -> int:
    """Where to cut if nothing is marked up to LONGEST: the word end with the least hash, the last of equals, so that
    text which repeats itself is cut at one phase; without word ends, the end of a character by the same rule."""
    low = start + SHORTEST
    part = raw[low - WINDOW if low >= WINDOW else 0 : start + LONGEST]
    skip = low - max(0, low - WINDOW)
    ends = np.flatnonzero(SPACES[part][skip:])
    if not len(ends):
        ends = np.flatnonzero((raw[low + 1 : start + LONGEST + 1] & 0xC0) != 0x80)
    if len(ends):
        hashes = gear_hash(part)[skip:][ends]
        return low + int(ends[len(ends) - 1 - hashes[::-1].argmin()]) + 1
    end = start + LONGEST
    while raw[end] & 0xC0 == 0x80 and end > start + 1:
        end -= 1
    return end


def _half(text_col: str, at: int) -> Column:
    """Sixteen hexadecimal digits of the MD5 of a text's bytes, as a long."""
    return F.conv(F.substring(F.md5(F.col(text_col).cast("binary")), at, 16), 16, -10).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1 and k2 (the MD5 of the text's bytes) and text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), _half(text_col, 1).alias("k1"), _half(text_col, 17).alias("k2"), F.col(text_col).alias("text"))


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d1, d2 (digest), id, k1, k2 (document), start (first byte), extent (bytes << 12 | words): a row per chunk."""
    names = ["d1", "d2", *_DOCUMENT, "start", "extent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_128_digest
        for batch in batches:
            for part in _parts(batch):
                digests, sizes, starts, extents = [], [], [], []
                for text in part.column(3).to_pylist():
                    data, start = (text or "").encode("utf-8", "replace"), 0
                    ends = chunk_ends(data) if data else []
                    for end in ends:
                        chunk = data[start:end]
                        digests.append(digest_of(chunk))
                        starts.append(start)
                        extents.append(len(chunk) << 12 | min(4095, n_words(chunk)))
                        start = end
                    sizes.append(len(ends))
                both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                document = [part.column(i).take(owner) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *document, pa.array(starts, pa.int64()), pa.array(extents, pa.int32())], names)

    return _keyed(docs, id_col, text_col).mapInArrow(run, "d1 long, d2 long, id long, k1 long, k2 long, start long, extent int")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK bytes of text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)))
        yield batch.slice(at, upto - at)
        at = upto


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated stretches: id, k1, k2, start_byte, end_byte, n_words, first_ids (documents with the earliest copies)."""
    chunks = materialize(chunk_rows(docs, id_col, text_col), "chunks")
    bound = max(COMMON_AT_LEAST, chunks.count() // COMMON)
    again = materialize(chunks.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1", F.ceil(F.col("n") / bound).cast("int").alias("g")), "repeated-digests")
    common = F.broadcast(again.where("g > 1"))
    place, parts = F.struct(*_DOCUMENT, "start"), F.coalesce("g", F.lit(1))
    part = F.pmod(F.xxhash64(*_DOCUMENT, "start"), parts).cast("int").alias("part")
    dealt_out = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    shared = materialize(chunks.join(common, "d1", "left").select(*chunks.columns, part).join(again.select("d1", dealt_out), ["d1", "part"]), "shared-chunks")
    first = shared.groupBy("d1", "d2").agg(F.min(place).alias("first")).join(common, "d1", "left").select("d1", "d2", "first", dealt_out)
    found = shared.join(first, ["d1", "d2", "part"]).where(place != F.col("first")).select(*_DOCUMENT, "start", "extent", F.col("first.id").alias("first_id"))
    # Rows repeated whole have the same places: once is enough.
    once = found.groupBy(*_DOCUMENT, "start").agg(F.min("extent").alias("extent"), F.min("first_id").alias("first_id"))
    dealt = once.repartition(*_DOCUMENT).sortWithinPartitions(*_DOCUMENT, "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            starts = _runs(table)
            yield _stretches(table, starts, min_words)
            held = table.slice(starts[-1]) if len(starts) else None  # the last run may go on
        if held is not None:
            yield _stretches(held, np.array([0, held.num_rows]), min_words)

    return dealt.mapInArrow(run, "id long, k1 long, k2 long, start_byte long, end_byte long, n_words long, first_ids array<long>")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _runs(table: pa.Table) -> np.ndarray:
    """Where runs of neighbouring chunks of one document begin, in sorted rows id, k1, k2, start, extent, first_id."""
    new = np.ones(table.num_rows, bool)
    start = _column(table, "start")
    new[1:] = start[1:] != start[:-1] + (_column(table, "extent")[:-1] >> 12)
    unnamed, named = table.column("id").is_null().to_numpy(), table.column("id").fill_null(0).to_numpy()
    for x in (unnamed, named, _column(table, "k1"), _column(table, "k2")):
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _stretches(table: pa.Table, starts: np.ndarray, min_words: int) -> pa.RecordBatch:
    """The runs between starts that have enough words; what follows the last start is left out."""
    extent, at = _column(table, "extent").astype(np.int64), _column(table, "start")
    begin, end = starts[:-1], starts[1:]
    words = np.add.reduceat(extent[: starts[-1]] & 4095, begin) if len(begin) else np.empty(0, np.int64)
    enough = words >= min_words
    begin, end, words = begin[enough], end[enough], words[enough]
    first = table.column("first_id")
    firsts = [sorted(set(first.slice(a, b - a).to_pylist()), key=lambda x: (x is not None, x)) for a, b in zip(begin.tolist(), end.tolist())]
    document = [table.column(c).combine_chunks().take(pa.array(begin)) for c in _DOCUMENT]
    columns = [pa.array(c, pa.int64()) for c in (at[begin], at[end - 1] + (extent[end - 1] >> 12), words)]
    return pa.RecordBatch.from_arrays([*document, *columns, pa.array(firsts, pa.list_(pa.int64()))], [*_DOCUMENT, "start_byte", "end_byte", "n_words", "first_ids"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated stretch cut out of its text, and the length column set anew for texts that changed.

    All rows and columns stay; a text that was repeated whole becomes empty.
    """
    found = repeats(docs, id_col, text_col, min_words).groupBy(*_DOCUMENT).agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("cuts"))
    # Own names for the caller's columns, whatever they are called.
    own = [f"c{i}" for i in range(len(docs.columns))]
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    size_at = docs.columns.index(length_col) if length_col in docs.columns else -1
    plain = docs.toDF(*own)
    keyed = plain.withColumns({"id": F.col(own[id_at]).cast("long"), "k1": _half(own[at], 1), "k2": _half(own[at], 17)})
    joined = keyed.join(found.withColumnsRenamed({c: f"f_{c}" for c in _DOCUMENT}), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("k1") == F.col("f_k1")) & (F.col("k2") == F.col("f_k2")), "left").select(*own, "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, columns = batch.column(batch.num_columns - 1), list(batch.columns[:-1])
            if cuts.null_count < batch.num_rows:
                texts = [cut(t, c) if c else t for t, c in zip(values(columns[at]), values(cuts))]
                if size_at >= 0:
                    sizes = [len(t or "") if c else n for t, c, n in zip(texts, values(cuts), values(columns[size_at]))]
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, own)

    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)


def cut(text: str | None, cuts: list[dict[str, int]]) -> str:
    """A text without some stretches of its UTF-8 bytes."""
    data, kept, at = (text or "").encode("utf-8", "replace"), [], 0
    for start, end in sorted((c["start_byte"], c["end_byte"]) for c in cuts):
        kept.append(data[at:start])
        at = max(at, end)
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")
