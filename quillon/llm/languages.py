"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a bounded, documented sample of its labelled rows recognises every substring of
their whole texts. A document is parsed from left to right into the longest phrases that each automaton knows; the
phrase count, times the logarithm of the automaton's text length and by the document's length, estimates the cross
entropy, and the language with the least wins. An automaton is a hash table of transitions, so all segments of a batch
advance by one letter with a few array operations; a text is cut into segments of SEGMENT letters for that, each parsed
whole.

The sample of a language is drawn by a hash of the id: rows until they hold ENOUGH letters, SAMPLE rows at most, each with
its whole text; documents of more than LONG letters are drawn after the others, the shortest first. So a language learns
from ENOUGH letters and one text more at most, however many languages there are.

Letters are lower-cased; runs of anything else become one space. Defined results: a null text, or one without a
letter, is `und` with score 0; ties go to the language that sorts first; without usable training rows every text is
`und`; repeated rows are predicted each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.labelled import fold

MODULUS, HELD_OUT = 4, 2
#: Rows of a language to learn from, at most; letters that are enough; letters of a document that is drawn late.
SAMPLE, ENOUGH, LONG = 200, 60_000, 20_000
UNDETERMINED = "und"
#: Symbols: 0 is a space, then the commonest letters, then any other letter.
SYMBOLS = 64
OTHER = SYMBOLS - 1
SEGMENT, AT_ONCE = 256, 8192
SHARPNESS = 60.0

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of every code point: the letters that are commonest in texts have their own."""
    table = np.where(_letters(), OTHER, 0).astype(np.uint8)
    seen: Counter = Counter()
    for t in texts:
        seen.update(t.lower())
    common = sorted((c for c in seen if table[ord(c)]), key=lambda c: (-seen[c], c))[: OTHER - 1]
    for i, c in enumerate(common, 1):
        table[ord(c)] = i
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text's symbols, with runs of spaces made one."""
    codes = table[code_points(text)]
    return codes[~((codes == 0) & np.r_[True, codes[:-1] == 0])] if len(codes) else codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of codes, the root first."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Transitions:
    """An automaton as a hash table with linear probing, at most half full: twelve bytes a slot."""

    def __init__(self, nexts: list[dict[int, int]]) -> None:
        states = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
        symbols = np.fromiter((c for x in nexts for c in x), np.int64, len(states))
        to = np.fromiter((t for x in nexts for t in x.values()), np.int32, len(states))
        bits = max(4, (2 * len(to)).bit_length())
        self.shift, self.keys, self.to = np.uint64(64 - bits), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        #: Where the next phrase stands after its first symbol; one that the text lacks is a phrase of its own, from a
        #: state that nothing goes on from.
        self.first = np.full(SYMBOLS, len(nexts), np.int32)
        self.first[list(nexts[0])] = list(nexts[0].values())
        todo = states * SYMBOLS + symbols + 1
        slot = self._slot(todo)
        while len(todo):
            _, chosen = np.unique(slot, return_index=True)
            chosen = chosen[self.keys[slot[chosen]] == 0]
            self.keys[slot[chosen]], self.to[slot[chosen]] = todo[chosen], to[chosen]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, to, slot = todo[rest], to[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended before the symbol."""
        wanted = state.astype(np.int64) * SYMBOLS + symbol + 1
        slot = self._slot(wanted)
        held = self.keys[slot]
        to, ended = self.to[slot], held != wanted
        again = np.flatnonzero(ended & (held != 0))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[again]]
            hit = held == wanted[again]
            to[again[hit]] = self.to[slot[again[hit]]]
            ended[again[hit]] = False
            again = again[~hit & (held != 0)]
        to[ended] = self.first[symbol[ended]]
        return to, ended


class Identifier:
    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.table = alphabet([texts[n] for n in self.names])
        self.automata, self.bits = [], []
        for n in self.names:
            codes = symbols(texts[n], self.table)
            self.automata.append(Transitions(suffix_automaton(codes.tolist())))
            self.bits.append(np.log2(max(2, len(codes))))

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """[document, language] counts of phrases."""
        owner = np.repeat(np.arange(len(codes)), [-(-len(c) // SEGMENT) for c in codes])
        out = np.zeros((len(codes), len(self.names)), np.int64)
        pieces = [c[i : i + SEGMENT] for c in codes for i in range(0, len(c), SEGMENT)]
        for at in range(0, len(pieces), AT_ONCE):
            part = sorted(range(at, min(at + AT_ONCE, len(pieces))), key=lambda i: -len(pieces[i]))
            lengths = np.array([len(pieces[i]) for i in part])
            grid = np.zeros((len(part), int(lengths[0])), np.uint8)
            for row, i in enumerate(part):
                grid[row, : len(pieces[i])] = pieces[i]
            steps = np.ascontiguousarray(grid.T).astype(np.int64)
            live = np.searchsorted(-lengths, -np.arange(1, len(steps) + 1), side="right")
            for k, automaton in enumerate(self.automata):
                state, count = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
                for codes_at, n in zip(steps, live):
                    state[:n], ended = automaton.step(state[:n], codes_at[:n])
                    count[:n] += ended
                np.add.at(out[:, k], owner[part], count + 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [symbols(t or "", self.table) for t in texts]
        if not self.names:
            return [(UNDETERMINED, 0.0)] * len(texts)
        bits = self.phrases(codes) * np.array(self.bits)
        out = []
        for c, b in zip(codes, bits):
            if not c.any():
                out.append((UNDETERMINED, 0.0))
                continue
            entropy = b / len(c)
            best = int(entropy.argmin())
            relative = (entropy - entropy[best]) / max(entropy[best], 1e-9)
            out.append((self.names[best], float(1.0 / np.exp(-SHARPNESS / 10 * relative).sum())))
        return out


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE, enough: int = ENOUGH) -> dict[str, str]:
    """Per language, the whole texts of its sample outside the held-out fold, joined by line ends."""
    text = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text <> ''").where(fold("id", MODULUS) != HELD_OUT)
    keyed = text.withColumn("hash", F.xxhash64("text"))
    rows = keyed.groupBy("lang", "id", "hash").agg(F.max(F.length("text")).alias("n"))
    late = F.when(F.col("n") > LONG, F.col("n")).otherwise(0)
    order = Window.partitionBy("lang").orderBy("late", F.xxhash64("id"), "id", "hash")
    chosen = rows.withColumn("late", late).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    drawn = chosen.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < enough)
    keys = ["lang", "id", "hash"]
    got = keyed.join(F.broadcast(drawn.select(*keys, "k")), keys).dropDuplicates(keys).select("lang", "k", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, a row for each input row. The driver builds the automata of the training texts and
    broadcasts them: some 50 bytes a letter of the sample."""
    shipped = docs.sparkSession.sparkContext.broadcast(Identifier(texts))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                told = found.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([y for _, y in told], pa.float64())], ["id", "lang_pred", "score"])

    return source.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
