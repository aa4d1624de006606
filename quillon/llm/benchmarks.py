"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Items and texts are sequences of words (runs of letters and digits, lower-cased). The CGK random walk embeds a
sequence so that a small edit distance becomes a small Hamming distance: a pointer moves through the words, one word
is written per step, and a random bit of that word and step says whether the pointer moves on. Two sequences that
differ by an edit fall into step again soon after it, so most steps write the same words.

Locality-sensitive hashing samples some steps of a walk into one key. Windows are as long as the item, however long it
is. A walk that has met many edits rarely falls into step again within a few words, so an item is embedded from each
of its words: a copy meets the index wherever one stretch of it is in step. Walks are added until copies with as many
random edits as are allowed are found with a chance of RECALL at each of LENGTHS (`walks_for`, measured on random
words). Texts are embedded from every word; all walks of a batch advance together, a step being a few array operations.
Candidates are verified by the exact edit distance of the whole item to the best matching stretch of the text; at
most a share `edits` of its words may differ, rounded down. Items too short for one edit are found exactly, by the
hashes of all stretches of their lengths.

An index is broadcast after a check of its measured size; items beyond INDEX_BYTES are indexed and searched in further
passes over the texts, so no item is dropped and no task holds more than one index.

Defined results: null and empty texts and items have no words and match nothing; items repeated under several ids are
each reported; texts of any length are searched whole; the columns of filtered tables are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import values

EDITS = 0.2
#: The recall of copies with all allowed edits that walks are added for, item lengths and copies it is measured on, and
#: walks at most.
RECALL, LENGTHS, COPIES, WALKS = 0.97, (5, 7, 10, 15, 20, 30, 50), 200, 12
#: Tables of each walk, sampled steps in a key.
TABLES, SAMPLED = 2, 6
#: Steps that keys are sampled from, and the longest items that are keyed so: in a short item an edit leaves no long
#: stretch in step, so it is keyed on fewer steps too.
STEPS = {14: None, 8: 15, 4: 7}
#: Bytes of an index; a longer item is one alone.
INDEX_BYTES = 64 << 20
WORDS_AT_ONCE = 1 << 16
FILTER_SHARE = 9

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Hasher(dict):
    """64-bit hashes of words; remembers the recent ones."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return got


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    """Independent 64-bit values of word codes, for one walk."""
    z = codes + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def samples(steps: int, walk: int) -> list[list[int]]:
    """Sampled steps of a walk's tables; the first walks and tables stay the same if more are added."""
    r = np.random.default_rng([steps, walk])
    return [sorted(r.choice(steps, min(SAMPLED, steps), replace=False).tolist()) for _ in range(TABLES)]


class Index:
    """Keys of item windows in all tables."""

    def __init__(self, items: list[tuple[int, list[str]]], edits: float = EDITS, walks: int | None = None) -> None:
        self.edits, self.walks = edits, walks_for(edits) if walks is None else walks
        self.windows = [(item, words) for item, words in items if int(edits * len(words)) > 0]
        self.masks: dict[tuple[int, bool], dict[str, int]] = {}
        self.bags: dict[int, frozenset[str]] = {}
        hasher = _Hasher()
        sizes = np.array([len(w) for _, w in self.windows], np.int64)
        codes = np.fromiter((hasher[x] for _, w in self.windows for x in w), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        #: (walk, steps) -> [(sampled steps, filter, sorted keys, their windows, their offsets)].
        self.tables: dict[tuple[int, int], list[tuple]] = {}
        for steps, longest in STEPS.items():
            keyed = sizes <= longest if longest else np.ones(len(sizes), bool)
            if not keyed.any():
                break
            for walk in range(self.walks):
                written, pointer = _walk(codes, np.arange(len(codes)), ends[owner], walk, steps, None)
                inside = (pointer < ends[owner]) & keyed[owner]
                for sampled in samples(steps, walk):
                    key = _keys_of([written[s] for s in sampled])[inside]
                    order = np.argsort(key, kind="stable")
                    self.tables.setdefault((walk, steps), []).append((sampled, _filter(key), key[order], owner[inside][order].astype(np.int32), offset[inside][order].astype(np.int32)))
        #: Of items that must be met exactly, by length: sorted hashes of all their words, and the items.
        self.exact: dict[int, tuple[np.ndarray, list[tuple[int, list[str]]]]] = {}
        for n in {len(w) for _, w in items if w and not int(edits * len(w))}:
            short = [(item, w) for item, w in items if len(w) == n]
            key = np.array([int(_keys_of([np.array([hasher[x]], np.uint64) for x in w])[0]) for _, w in short], np.uint64)
            order = np.argsort(key, kind="stable")
            self.exact[n] = key[order], [short[i] for i in order.tolist()]

    def nbytes(self) -> int:
        """What the index holds, its words being counted as Python strings."""
        tables = sum(x[1][0].nbytes + sum(a.nbytes for a in x[2:]) for t in self.tables.values() for x in t)
        short = [w for _, part in self.exact.values() for _, w in part]
        return tables + sum(200 + 8 * len(w) + sum(49 + 4 * len(x) for x in w) for w in [*(w for _, w in self.windows), *short])

    def mask(self, n: int, backwards: bool) -> dict[str, int]:
        """The places of each word in window n; kept for recent windows."""
        if (n, backwards) not in self.masks:
            if len(self.masks) >= 2000:
                self.masks.clear()
            self.masks[n, backwards] = _masks(self.windows[n][1][:: -1 if backwards else 1])
        return self.masks[n, backwards]

    def bag(self, n: int) -> frozenset[str]:
        """The different words of window n; kept for recent windows."""
        if n not in self.bags:
            if len(self.bags) >= 2000:
                self.bags.clear()
            self.bags[n] = frozenset(self.windows[n][1])
        return self.bags[n]

    def whole(self, texts: list[list[str]], codes: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The first exact match of each text and item that allows for no edits, as search() yields them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        for n, (keys, items) in self.exact.items():
            places = np.flatnonzero(np.arange(len(codes)) + n <= ends[owner])
            key = _keys_of([codes[places + i] for i in range(n)])
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            done = set()
            for k in np.flatnonzero(high > low).tolist():
                text = int(owner[places[k]])
                at = int(places[k] - (ends - sizes)[text])
                for item, words in items[low[k] : high[k]]:
                    if (text, item) not in done and texts[text][at : at + n] == words:
                        done.add((text, item))
                        yield text, item, at, at + n, 0

    def candidates(self, codes: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of (place, window, offset) that meet in a table; limit: the end of the text of each place."""
        places = np.arange(len(codes))
        for (walk, steps), tables in self.tables.items():
            written, _ = _walk(codes, places, limit, walk, steps, {s for t in tables for s in t[0]})
            for sampled, (bits, shift), keys, windows, offsets in tables:
                if not len(keys):
                    continue
                key = _keys_of([written[s] for s in sampled])
                slot = key >> shift
                place = np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                low, high = np.searchsorted(keys, key[place], "left"), np.searchsorted(keys, key[place], "right")
                n = high - low
                which = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                yield np.repeat(place, n), windows[which], offsets[which]

    def search(self, texts: list[list[str]], hasher: _Hasher) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, end word, edits) of verified matches, the best of each text and item."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.fromiter(map(hasher.__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
        if not len(codes):
            return
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        yield from self.whole(texts, codes, ends, owner)
        if not self.windows:
            return
        found = [np.stack([owner[p], w, p - (ends - sizes)[owner[p]] - o]) for p, w, o in self.candidates(codes, ends[owner])]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done = (-1, -1, 0)
        for text, n, at in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
            item, window = self.windows[n]
            most = int(self.edits * len(window))
            if done[:2] == (text, n) and at - done[2] <= most // 2:
                continue  # the stretch that was looked at last has room for this start too
            done = text, n, at
            match = self.nearest(n, texts[text], max(0, at - most), at + len(window) + 2 * most, most)
            if match and (match[2], match[0]) < (best[text, item][2], best[text, item][0]) if (text, item) in best else match:
                best[text, item] = match
        for (text, item), (start, end, edits) in best.items():
            yield text, item, start, end, edits

    def nearest(self, n: int, text: list[str], low: int, high: int, most: int) -> tuple[int, int, int] | None:
        """First word, end word and edit distance of the stretch of text[low:high] that is nearest to window n, if at most
        `most` words differ."""
        window, part = self.windows[n][1], text[low:high]
        size, absent = len(window), self.bag(n).difference(part)
        if len(absent) > most or sum(map(window.count, absent)) > most:
            return None  # each of these words costs an edit
        costs = list(_edits(self.mask(n, False), size, part, 0))
        cost = min(costs, default=most + 1)
        if cost > most:
            return None
        end = costs.index(cost) + 1
        back = list(_edits(self.mask(n, True), size, part[:end][::-1], 1))
        return low + end - (back.index(min(back)) + 1), low + end, cost


def _masks(window: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(window):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _edits(masks: dict[str, int], size: int, text: list[str], anchored: int) -> Iterator[int]:
    """After each word of text, the edit distance of the window to the nearest stretch that ends there (anchored 0), or
    to the whole text up to there (anchored 1), by bit-parallel dynamic programming."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, cost = full, 0, size
    for word in text:
        equal = masks.get(word, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, low = minus | (full & ~(across | plus)), plus & across
        cost += bool(up & top) - bool(low & top)
        up, low = (up << 1 | anchored) & full, low << 1 & full
        plus, minus = low | (full & ~(down | up)), up & down
        yield cost


def _walk(codes: np.ndarray, at: np.ndarray, limit: np.ndarray, walk: int, steps: int, wanted: set[int] | None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Words written at the wanted steps by walks from places `at`, and where the walks write last. A walk that has
    passed its limit writes nothing that can meet a key."""
    words = _mixed(codes, walk + 1)
    pointer, out, one = at.astype(np.int64), {}, np.uint64(1)
    for step in range(steps):
        here = words.take(pointer, mode="clip")  # past the end, the last word
        if wanted is None or step in wanted:
            out[step] = np.where(pointer < limit, here, np.uint64(step)) if step == steps - 1 or wanted is None else here
        if step + 1 < steps:
            pointer += ((here >> np.uint64(step)) & one).astype(np.int64)
    return out, pointer


def _filter(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Which leading bits some key has, and how far to shift a key for them."""
    bits = min(26, max(12, len(keys).bit_length() + FILTER_SHARE))
    shift = np.uint64(64 - bits)
    held = np.zeros(1 << (bits - 3), np.uint8)
    slot = keys >> shift
    np.bitwise_or.at(held, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return held, shift


_WALKS: dict[float, int] = {}


def walks_for(edits: float) -> int:
    """The walks whose tables find copies with all allowed edits with a chance of RECALL at each of LENGTHS, measured on
    random words; WALKS at most."""
    if edits not in _WALKS:
        r, lists = np.random.default_rng(11), {}
        for length in LENGTHS:
            lists[length] = [], []
            for _ in range(COPIES):
                item = [f"w{x}" for x in r.integers(0, 5000, length)]
                copy = list(item)
                for _ in range(int(edits * length)):
                    p, kind = int(r.integers(0, len(copy))), int(r.integers(0, 3))
                    copy[p : p + (kind != 2)] = [] if kind == 0 else [f"w{r.integers(5000, 10_000)}"]
                lists[length][0].append(item)
                lists[length][1].append([f"w{x}" for x in r.integers(10_000, 15_000, 10)] + copy + ["end"])
        walks = 1
        for length, (items, copies) in lists.items():
            while walks < WALKS and _met(items, copies, edits, walks) < RECALL:
                walks += 1
        _WALKS[edits] = walks
    return _WALKS[edits]


def _met(items: list[list[str]], copies: list[list[str]], edits: float, walks: int) -> float:
    """The share of copies that meet their item in a table."""
    index, hasher = Index(list(enumerate(items)), edits, walks), _Hasher()
    sizes = np.array([len(c) for c in copies], np.int64)
    owner, ends = np.repeat(np.arange(len(copies)), sizes), np.cumsum(sizes)
    codes = np.fromiter(map(hasher.__getitem__, chain.from_iterable(copies)), np.uint64, int(sizes.sum()))
    met = {int(owner[p]) for places, windows, _ in index.candidates(codes, ends[owner]) for p, w in zip(places, windows) if owner[p] == w}
    exact = {text for text, item, *_ in index.whole(copies, codes, ends, owner) if text == item}
    return len(met | exact) / len(copies)


def _keys_of(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda k, p: (k ^ p) * np.uint64(0xC2B2AE3D27D4EB4F) + (k >> np.uint64(31)), parts, np.full(len(parts[0]), 0x27D4EB2F165667C5, np.uint64))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """Matches: id_col, item_col, start_word, end_word, n_edits; the best of each document row and item."""
    return _search(docs, items, [id_col], id_col, text_col, item_col, item_text_col, edits)


def _indexes(items: DataFrame, item_col: str, item_text_col: str, edits: float) -> Iterator[Index]:
    """Indexes of all items, of INDEX_BYTES each as measured; the driver holds one at a time."""
    walks = walks_for(edits)

    def built(part: list[tuple[int, list[str]]]) -> Iterator[Index]:
        index = Index(part, edits, walks)
        if len(part) < 2 or index.nbytes() <= INDEX_BYTES:
            yield index
        else:
            del index
            yield from built(part[: len(part) // 2])
            yield from built(part[len(part) // 2 :])

    # A word's share of an index is some keys of 16 bytes, their filters and the word itself.
    most, part, held, some = INDEX_BYTES // (30 * TABLES * walks + 60), [], 0, False
    rows = items.select(F.col(item_col).cast("long"), item_text_col).where(F.col(item_text_col).isNotNull()).distinct().orderBy(item_col, item_text_col)
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if part and held + len(words) > most:
            yield from built(part)
            part, held, some = [], 0, True
        part.append((item, words))
        held += len(words)
    if part or not some:
        yield from built(part)


def _batches(texts: Iterator[str | None]) -> Iterator[list[list[str]]]:
    held, n = [], 0
    for t in texts:
        held.append(words_of(t))
        n += len(held[-1])
        if n >= WORDS_AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _search(docs: DataFrame, items: DataFrame, kept: list[str], id_col: str, text_col: str, item_col: str, item_text_col: str, edits: float) -> DataFrame:
    found = []
    for index in _indexes(items, item_col, item_text_col, edits):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            for batch in batches:
                at = 0
                for texts in _batches(values(batch.column(1))):
                    rows = list(shipped.value.search(texts, hasher))
                    ids = batch.column(0).take(pa.array([at + r[0] for r in rows], pa.int64()))
                    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "item", "start_word", "end_word", "n_edits"])
                    at += len(texts)

        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found.append(source.mapInArrow(run, "id long, item long, start_word long, end_word long, n_edits long"))
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    at = docs.columns.index(text_col)
    for index in _indexes(items, item_col, item_text_col, edits):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            for batch in batches:
                clean, done = np.ones(batch.num_rows, bool), 0
                for texts in _batches(values(batch.column(at))):
                    for text, *_ in shipped.value.search(texts, hasher):
                        clean[done + text] = False
                    done += len(texts)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
