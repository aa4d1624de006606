"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

Learning (from a bounded, documented sample of labelled documents):
1. Candidate terms are whole words and word stems (prefixes) that occur in toxic documents and hardly in clean ones.
2. A term is kept if it stands in many different contexts (pairs of neighbouring words) of toxic documents, so
   words that merely come along in copies of one toxic document are not kept; of nested terms one is.
3. Each term gets the share of toxic documents among those that hold it exactly, by how many matches of any term
   the document has, and among those that hold it only misspelled. Documents whose matches all stand in quotations, or
   in abuse, are held against the others with as many matches: the two kinds of context get factors from that.

Scoring: the lexicon is a trie, stems being accepted whatever follows. Levenshtein automata of all terms are run
at once as their intersection with the trie, made deterministic state by state as words are met, so a word costs
one look-up per letter until no term is in reach. Each match is then weighed by its context window: quotation
marks around it and words of reporting speak for quotation; address in the second person and exclamations speak
for abuse; the heavier side settles the kind, and its factor applies. A document's score is the chance of its worst match.
The automaton forgets its states when it has STATES, so a long task's memory is bounded.

Defined results: null and empty texts have the base score of documents without a match; long texts are matched
whole; without usable labels the lexicon is empty and every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import values
from quillon.llm.labelled import training_sample

#: Labelled documents to learn from, at most.
SAMPLE = 20_000
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
STEMS = range(4, 9)
WINDOW = 6
COUNTS = 4
#: The different contexts in toxic documents that a kept term needs.
LEAST_CONTEXTS = 8
#: States that an automaton remembers, at most.
STATES = 50_000
PLAIN, QUOTED, ABUSE = 0, 1, 2

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
# Signs of a quotation and of abuse in a context window.
REPORTING = frozenset("said says say wrote writes quote quoted quotes quoting called calls term word phrase reported alleged sagte schrieb zitat disait dit citation dijo escribió cita".split())
ADDRESS = frozenset("you your youre yours yourself u ur du dein deine dich dir tu toi ton ta tes vous votre tú ti vos usted".split())
QUOTES = frozenset("\"“”„«»‘’‹›`")


def terms_of(text: str) -> set[str]:
    """Words, and stems as prefix*, of a text."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def edits_allowed(term: str) -> int:
    n = len(term.rstrip("*"))
    return 0 if n < 4 else 1 if n < 9 else 2


@dataclass
class Entry:
    term: str
    #: Chance of abuse by the number of exact matches in the document: 1, 2, up to COUNTS or more.
    exact: list[float]
    fuzzy: float


@dataclass
class Lexicon:
    entries: list[Entry] = field(default_factory=list)
    base: float = 0.0
    #: Factors of a match in plain text, in a quotation and in abuse.
    factors: tuple[float, float, float] = (1.0, 1.0, 1.0)


class Automaton:
    """The Levenshtein automata of all terms within their trie, made deterministic lazily."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        self.allowed = [edits_allowed(t) for t in terms]
        self.reach = [0]
        for k, term in enumerate(terms):
            at, stem = 0, term.endswith("*")
            self.reach[0] = max(self.reach[0], self.allowed[k])
            for c in term.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], self.allowed[k])
            self.ends[at].append((k, stem))
        self._forget()

    def _forget(self) -> None:
        #: A state: (trie node, edits) pairs, and the (term, edits) of stems that are accepted for good.
        self.numbers: dict[tuple[frozenset, frozenset], int] = {}
        self.states: list[tuple[frozenset, frozenset]] = []
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.step: list[dict[str, int]] = []
        self.dead: set[int] = set()
        self.start = self._number({(0, 0)}, frozenset())

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With letters of terms left out, and no pair that another at the same node betters."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _number(self, pairs: set[tuple[int, int]], kept: frozenset) -> int:
        live = self._closed(pairs)
        stems = dict(kept)
        whole: dict[int, int] = {}
        for node, e in live:
            for k, stem in self.ends[node]:
                if e <= self.allowed[k]:
                    to = stems if stem else whole
                    to[k] = min(e, to.get(k, 99))
        key = live, frozenset(stems.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            if not live:
                self.dead.add(len(self.states))
            self.states.append(key)
            self.step.append({})
            self.found.append(tuple(sorted((whole | stems).items())))
        return self.numbers[key]

    def _next(self, state: int, c: str) -> int:
        live, stems = self.states[state]
        pairs = set()
        for node, e in live:
            child = self.children[node].get(c)
            if child is not None:
                pairs.add((child, e))
            pairs.add((node, e + 1))
            pairs.update((x, e + 1) for x in self.children[node].values())
        to = self.step[state][c] = self._number(pairs, stems)
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of all terms that the word matches."""
        if len(self.states) >= STATES:
            self._forget()
        state = self.start
        for c in word:
            to = self.step[state].get(c)
            if to is None:
                to = self._next(state, c)
            state = to
            if state in self.dead:
                break  # no term is in reach any more
        return self.found[state]


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = Automaton([e.term for e in lexicon.entries])

    def matches(self, text: str | None) -> list[tuple[int, str, int, int, int]]:
        """Place, surface, term, edits and kind of context of every match in a whole text."""
        if not text or not self.lexicon.entries:
            return []
        low = text.lower()
        match = self.automaton.match
        hits = {w: m for w in set(_WORD.findall(low)) if (m := match(w))}
        if not hits:
            return []
        tokens, out = _TOKEN.findall(low), []
        for i, w in enumerate(tokens):
            for term, edits in hits.get(w, ()):
                out.append((i, w, term, edits, self._kind(tokens, i)))
        return out

    @staticmethod
    def _kind(tokens: list[str], i: int) -> int:
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        quote = 2.0 * (any(t in QUOTES for t in before) and any(t in QUOTES for t in after)) + any(t in REPORTING for t in before + after)
        abuse = 1.0 * any(t in ADDRESS for t in before + after) + 0.5 * ("!" in after)
        return QUOTED if quote > abuse else ABUSE if abuse > quote else PLAIN

    def score(self, text: str | None) -> float:
        return self.score_of(self.matches(text))

    def score_of(self, found: list[tuple[int, str, int, int, int]]) -> float:
        lex = self.lexicon
        n = min(exact_matches(found), COUNTS)
        chances = [lex.base]
        for _, _, term, edits, kind in found:
            e = lex.entries[term]
            chances.append((e.fuzzy if edits else e.exact[n - 1]) * lex.factors[kind])
        return min(max(chances), 1.0)


def exact_matches(found: list[tuple[int, str, int, int, int]]) -> int:
    return len({i for i, _, _, edits, _ in found if not edits})


def _choose(contexts: dict[str, int], clean: dict[str, int]) -> list[str]:
    """Terms with enough contexts; of nested ones that with the most, on ties the longest."""
    kept: list[str] = []
    worth = {t: n - 3 * clean.get(t, 0) for t, n in contexts.items()}
    for term in sorted(worth, key=lambda t: (-worth[t], -len(t.rstrip("*")), t)):
        if worth[term] < LEAST_CONTEXTS:
            break
        bare = term.rstrip("*")
        if not any((k.endswith("*") and bare.startswith(k[:-1])) or (term.endswith("*") and k.startswith(bare)) for k in kept):
            kept.append(term)
    return kept


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE) -> Lexicon:
    """Fit a lexicon on at most `most` labelled documents outside the held-out fold.

    The driver gets the candidate terms, which `most` bounds, with their counts.
    """
    sample = training_sample(docs, labels, label_col, MODULUS, HELD_OUT, most)
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1):
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], ["term", "toxic", "clean"])

        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(values(batch.column(0)), values(batch.column(1))):
                for t in terms_of(text):
                    seen.setdefault(t, [0, 0])[label] += 1
                if len(seen) > 50_000:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    counted = sample.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # At most half of the documents that hold a term may be clean: a single match may be harmless.
    good = counted.where(F.col("toxic") >= LEAST_CONTEXTS).where(F.col("clean") <= F.col("toxic"))
    rows = good.orderBy("term").collect()
    number = {r.term: i for i, r in enumerate(rows)}
    shipped = docs.sparkSession.sparkContext.broadcast(number)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of toxic documents with the contexts that they stand in, each pair once a batch."""
        number = shipped.value
        for batch in batches:
            found = set()
            for text in values(batch.column(0)):
                words = ["", *_WORD.findall(text.lower()), ""]
                for before, w, after in zip(words, words[1:], words[2:]):
                    for t in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                        if t in number:
                            found.add((number[t], zlib.crc32(f"{before} {after}".encode("utf-8", "replace"))))
            terms, contexts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(contexts, pa.int64())], ["term", "context"])

    held = sample.where("label = 1").select("text").mapInArrow(hold, "term int, context long")
    contexts = {rows[r.term].term: r.n for r in held.groupBy("term").agg(F.count_distinct("context").alias("n")).collect()}
    kept = _choose(contexts, {r.term: r.clean for r in rows})
    return _weigh(sample, kept)


def _weigh(sample: DataFrame, kept: list[str]) -> Lexicon:
    """The shares of toxic documents by term and kind of match, and by context."""
    plain = Scorer(Lexicon([Entry(t, [1.0] * COUNTS, 1.0) for t in kept]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(values(batch.column(0)), values(batch.column(1))):
                found = plain.matches(text)
                exact = {t for _, _, t, e, _ in found if not e}
                n = min(exact_matches(found), COUNTS)
                seen.update((str(n), t, label) for t in exact)
                if not exact:
                    seen.update(("fuzzy", t, label) for t in {t for _, _, t, _, _ in found})
                    seen["none", -1, label] += not found
                else:
                    kinds = {kind for *_, e, kind in found if not e}
                    seen[f"kind{kinds.pop() if len(kinds) == 1 else PLAIN}", n, label] += 1
        columns = list(zip(*((k, t, lab, n) for (k, t, lab), n in seen.items()))) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["kind", "term", "label", "n"])

    told = sample.select("text", "label").mapInArrow(tell, "kind string, term int, label int, n long").groupBy("kind", "term", "label").agg(F.sum("n").alias("n")).collect()
    n = {(r.kind, r.term, r.label): r.n for r in told}

    def share(kind: str, term: int, toxic_prior: float, prior: float) -> float:
        t, c = n.get((kind, term, 1), 0), n.get((kind, term, 0), 0)
        return (t + toxic_prior) / (t + c + prior)

    def by_count(term: int) -> list[float]:
        whole = sum(n.get((str(k), term, 1), 0) for k in range(1, COUNTS + 1)) + 0.9, sum(n.get((str(k), term, 0), 0) for k in range(1, COUNTS + 1)) + 0.1
        mean = whole[0] / sum(whole)
        return [share(str(k), term, mean, 1) for k in range(1, COUNTS + 1)]

    # A kind of context counts like any other with as many matches until enough labelled ones show otherwise.
    kinds, counts = (PLAIN, QUOTED, ABUSE), range(1, COUNTS + 1)

    def documents(kind: int, k: int, label: int) -> int:
        return n.get((f"kind{kind}", k, label), 0)

    def factor(kind: int) -> float:
        others = [x for x in kinds if x != kind]
        expected = caught = 0.0
        for k in counts:
            toxic, clean = (sum(documents(x, k, label) for x in others) for label in (1, 0))
            expected += (documents(kind, k, 1) + documents(kind, k, 0)) * (toxic + 0.9) / (toxic + clean + 1)
            caught += documents(kind, k, 1)
        return (caught + 3) / (expected + 3)

    factors = 1.0, min(1.0, factor(QUOTED)), max(1.0, factor(ABUSE))
    return Lexicon([Entry(t, by_count(k), share("fuzzy", k, 1, 2)) for k, t in enumerate(kept)], share("none", -1, 0, 1), factors)


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score and terms (array of matched surfaces), a row for each input row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            scores, surfaces = [], []
            for text in values(batch.column(1)):
                found = scorer.matches(text)
                scores.append(scorer.score_of(found))
                surfaces.append(sorted({s for _, s, *_ in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(surfaces, pa.list_(pa.string()))], ["id", "score", "terms"])

    return source.mapInArrow(run, "id long, score double, terms array<string>").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, in one pass over the texts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in values(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
