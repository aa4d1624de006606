"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

Each position of the text is a lattice state whose backpointer names the piece that ends there. For a unigram
model the survivor at a state is the path with the highest score. For a BPE model the survivor is the path whose
neighbouring pieces are all stable, meaning that the merge rule keeps each pair apart; every prefix has exactly
one, so the lattice finds the very ids that merging would. Only a window of the longest piece is kept alive:
as soon as the backpointer paths of all states that a later piece could still start from meet in one boundary,
the ids up to it are committed and the lattice before it is dropped. Memory is therefore bounded however long a
text is. All ids come from this lattice: where a piece never holds an inner word mark, paths always meet where a word
begins, and the ids that the lattice gave between two such boundaries are remembered for the next time they occur.

Decoding joins pieces, turns word marks into spaces, decodes byte pieces as UTF-8 and takes off the dummy prefix.

The model's normalizer is read: the dummy prefix and the removal of extra white space are done; a model that maps
characters, doesn't escape white space or marks it behind words is refused with a ValueError rather than encoded wrongly.
User-defined pieces of a BPE model are found first, the longest at each place, and paths meet at both of their ends; a
unigram model with such pieces is refused too.

Defined results: a null or empty text has no ids; characters outside the vocabulary become byte pieces; a literal
U+2581 is encoded as a space, as the public library does, and so is the one character that doesn't round-trip.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.batches import values

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
_SPACES = re.compile(" {2,}")
_RUNS = re.compile(rf"{MARK}+[^{MARK}]*").findall
#: An unknown character of a unigram model scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bounds of what a process remembers: ids between boundaries for recent texts of so many characters at most, and pairs
#: of pieces known to be stable or not.
REMEMBERED, REMEMBERED_LENGTH, PAIRS = 240_000, 48, 400_000


class _Memory(dict):
    """Packed ids of recent units: at least the last `most` of them, at most twice as many."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


class Model:
    """A SentencePiece model's vocabulary and the encoder over it."""

    # Fixed values of the model format: field numbers and piece types.
    PIECES, TRAINER, NORMALIZER, MODEL_TYPE, PIECE, SCORE, TYPE, MARK_BEHIND = 1, 2, 3, 3, 1, 2, 3, 24
    CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, raw: bytes) -> None:
        self.kind, self.pieces, self.scores, kinds = UNIGRAM, [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == self.PIECES:
                part = dict(_fields(value))
                self.pieces.append(part[self.PIECE].decode())
                self.scores.append(float(np.frombuffer(part.get(self.SCORE, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(part.get(self.TYPE, self.NORMAL))
            elif number == self.TRAINER:
                trainer = dict(_fields(value))
            elif number == self.NORMALIZER:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(self.MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(self.CHARACTER_MAP) or not normalizer.get(self.ESCAPE_SPACES, 1) or trainer.get(self.MARK_BEHIND, 0):
            raise ValueError("a model of another kind, that maps characters, leaves spaces as they are or marks them behind words")
        self.dummy, self.trims = bool(normalizer.get(self.DUMMY_PREFIX, 1)), bool(normalizer.get(self.REMOVE_SPACES, 1))
        self._prepare(kinds)

    def _prepare(self, kinds: list[int]) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == self.NORMAL}
        self.users = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == self.USER}
        if self.users and self.kind == UNIGRAM:
            raise ValueError("a unigram model with user-defined pieces")
        self.user_parts = re.compile("(" + "|".join(map(re.escape, sorted(self.users, key=len, reverse=True))) + ")") if self.users else None
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == self.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, k in enumerate(kinds) if k == self.UNKNOWN), 0)
        self.silent = {i for i, k in enumerate(kinds) if k == self.CONTROL}
        self.longest = max(map(len, self.ids), default=1)
        #: The trie of pieces: character -> [id or -1 where it is only a prefix, the node's own characters].
        self.root: dict[str, list] = {}
        for p, i in self.ids.items():
            node = [-1, self.root]
            for c in p:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        self.alone = {p for p in self.ids if len(p) == 1}
        worst = min((self.scores[i] for i, k in enumerate(kinds) if k == self.NORMAL), default=0.0)
        self.unknown_score = worst - UNKNOWN_PENALTY
        #: Neighbouring characters within any piece: where two others meet, all paths meet.
        self.inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.lines_apart = not any("\n" in p for p in self.ids)
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        #: By the piece before (-1: a boundary), whether merging leaves a piece as it is there.
        self.stable: dict[int, dict[int, bool]] = {-1: {}} | {i: {} for i in self.ids.values()}
        self.stable[-3] = self.stable[-1]
        self.pairs = 0
        self.bare, self.marked = _Memory(self._unit, REMEMBERED // 3), _Memory(lambda word: self._unit(MARK + word))
        self.high = {i for b, i in self.bytes.items() if b >= 128}
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 128 else ""
        for i in self.silent:
            self.shown[i] = ""

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours first, leftmost on ties."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_stable(self, before: int, token: int) -> bool:
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 0
            for held in self.stable.values():
                held.clear()
        parts = [self.pieces[k] for k in (before, token) if k >= 0]
        ok = self.stable[before][token] = self._merged("".join(parts)) == parts
        return ok

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Lists of committed ids; chars: strings that make up the (marked) text."""
        root, stable, scores, unigram = self.root, self.stable, self.scores, self.kind == UNIGRAM
        # The window: its text; of each of its positions the piece that ends there, where that begins, and the score.
        text, token, begin, score, here, low, alone = "", [-1], [0], [0.0], -1, float("-inf"), self.alone
        open_pieces: list[tuple[int, dict]] = []  # beginnings of pieces that may go on, the earliest first
        for chunk in chars:
            text += chunk
            for c in chunk:
                here += 1
                best, since, top, still = -2, here, low, []
                open_pieces.append((here, root))
                for start, kids in open_pieces:
                    node = kids.get(c)
                    if node is None:
                        continue
                    t, kids = node
                    if kids:
                        still.append((start, kids))
                    if t < 0:
                        continue
                    if unigram:
                        if score[start] + scores[t] > top:
                            best, since, top = t, start, score[start] + scores[t]
                    elif best == -2:
                        before = token[start]
                        ok = stable[before].get(t)
                        if ok or (ok is None and self._is_stable(before, t)):
                            best, since = t, start
                open_pieces = still
                if best == -2 or unigram:
                    if c in alone:
                        if best == -2:
                            raise ValueError(f"no stable path to {text[: here + 1][-40:]!r}")
                    elif best == -2 or score[here] + self.unknown_score > top:  # a character without a piece is one
                        best, since, top = -3, here, score[here if unigram else 0] + self.unknown_score
                    if unigram:
                        score.append(top)
                token.append(best)
                begin.append(since)
            meet = self._meeting(len(text), open_pieces, begin)
            if meet:
                yield self._walk(text, token, begin, meet)
                text, token, begin = text[meet:], token[meet:], [max(0, x - meet) for x in begin[meet:]]
                score = [x - score[meet] for x in score[meet:]] if unigram else score
                open_pieces = [(start - meet, kids) for start, kids in open_pieces]
                here -= meet
        if text:
            yield self._walk(text, token, begin, len(text))

    @staticmethod
    def _meeting(size: int, open_pieces: list[tuple[int, dict]], begin: list[int]) -> int:
        """The last boundary that the paths of all states run through from which a piece could still go on."""
        if not open_pieces:
            return size
        alive = {size, *(start for start, _ in open_pieces)}
        while len(alive) > 1:
            alive.remove(last := max(alive))
            alive.add(begin[last])
        return alive.pop()

    def _walk(self, text: str, token: list[int], begin: list[int], end: int) -> list[int]:
        """The ids of the path to a position."""
        out: list[int] = []
        while end:
            if token[end] >= 0:
                out.append(token[end])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[begin[end] : end].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            end = begin[end]
        out.reverse()
        return out

    def _unit(self, unit: str) -> bytes:
        """Packed ids of the text between two boundaries where all paths meet."""
        cut = len(unit)
        while cut > 1 and (unit[cut - 2], unit[cut - 1]) not in self.inside:
            cut -= 1
        if cut < len(unit):
            return b"".join([self.bare[unit[:cut]], *map(self.bare.__getitem__, unit[cut:])])
        step = 4 * self.longest
        return array("I", chain.from_iterable(self.stream(unit[at : at + step] for at in range(0, len(unit), step)))).tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as unsigned 32-bit words."""
        text = (text or "").replace(MARK, " ")
        if self.trims:
            text = _SPACES.sub(" ", text.strip(" "))
        if not text:
            return b""
        if self.users or not self.words_apart:
            return self._in_parts((MARK if self.dummy else "") + text.replace(" ", MARK))
        out: list[bytes] = []
        for n, line in enumerate(text.split("\n") if self.lines_apart else [text]):
            if n:
                out.append(self.bare["\n"])
            # A word mark stands before the text and for every space.
            words = line.split(" ")
            if n == 0 and self.dummy:
                words.insert(0, "")
            if words[0]:
                out.append(self.bare[words[0]])
            if "" in words[1:]:  # several marks in a row belong to one unit
                out += map(self.bare.__getitem__, _RUNS("".join(MARK + w for w in words[1:])))
            else:
                out += map(self.marked.__getitem__, words[1:])
        return b"".join(out)

    def _in_parts(self, marked: str) -> bytes:
        """The same where user-defined pieces end paths, or where pieces hold several words."""
        out: list[bytes] = []
        for n, part in enumerate(self.user_parts.split(marked) if self.user_parts else [marked]):
            out.append(array("I", [self.users[part]]).tobytes() if n % 2 else self.bare[part] if part else b"")
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.uint32).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        if self.high.isdisjoint(ids):  # a byte under 128 is a character of its own wherever it stands
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                parts.append(raw.decode("utf-8", "replace") + self.shown[i])
                raw.clear()
            text = "".join(parts) + raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_LOADED: dict[int, Model] = {}


def load(raw: bytes) -> Model:
    """The model, kept by the process so that tasks share what it remembers."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model(raw)
    return _LOADED[key]


def with_token_ids(docs: DataFrame, model_path: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs with token_ids array<int>, n_tokens and round_trip (the ids decode to the text) in place of any columns of
    those names.

    The driver reads the model file (its size is that of a vocabulary) and ships it to the tasks.
    """
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.drop("token_ids", "n_tokens", "round_trip")
    at, names = source.columns.index(text_col), [*source.columns, "token_ids", "n_tokens", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shipped.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows, sizes, same = [], [0], []
                for text in values(part.column(at)):
                    ids = np.frombuffer(model.packed(text), np.uint32)
                    rows.append(ids.astype(np.int32))
                    sizes.append(len(ids))
                    same.append(model.decode(ids.tolist()) == (text or ""))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.array(sizes[1:], np.int64)), pa.array(same, pa.bool_())], names)

    added = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *added.fields]))


def encode_texts(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, token_ids, n_tokens, round_trip, a row for each input row."""
    return with_token_ids(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")), model_path, "_text").drop("_text")


def decode_texts(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and text, a row for each input row; null ids decode to an empty text."""
    with open(model_path, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or ()) for x in values(batch.column(1))], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
