import random

import pytest

from quillon.llm import toxicity as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "worthless", "scum", "lowe*", "disgusting*", "cat"]
    r, automaton = random.Random(4), t.Automaton(terms)
    for _ in range(4000):
        word = list(r.choice(terms).rstrip("*") + r.choice(["", "", "xy", "ness"]))
        for _ in range(r.randrange(4)):
            p = r.randrange(len(word) + 1)
            word[p : p + r.randrange(2)] = r.choice(["", "o", "t", "l"])
        word = "".join(word)
        expected = {}
        for k, term in enumerate(terms):
            stem = term.rstrip("*")
            best = min((distance(stem, word[:n]) for n in range(len(word) + 1))) if term.endswith("*") else distance(stem, word)
            if best <= t.edits_allowed(term):
                expected[k] = best
        assert dict(automaton.match(word)) == expected, word


def test_the_automaton_forgets(monkeypatch):
    monkeypatch.setattr(t, "STATES", 300)
    r, automaton = random.Random(4), t.Automaton(["idiot", "worthless", "lowe*"])
    words = ["".join(r.choice("abcdeilorstwh") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    fresh = {w: t.Automaton(["idiot", "worthless", "lowe*"]).match(w) for w in words[:200]}
    most = 0
    for w in words * 2:
        found = automaton.match(w)
        most = max(most, len(automaton.states))
        assert w not in fresh or found == fresh[w]
    assert most <= 300 + 20


def test_factors_of_contexts(make_docs, spark, prose):
    """Matches in quotations that are labelled clean weigh less, those in abuse no less than others."""
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 30).split()
        kind = i % 12
        term = ["zorgon"] if kind < 8 else ['he said "', "zorgon", '"'] if kind == 8 else ["you", "zorgon", "!"] if kind == 9 else []
        words[10:10] = term
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 7 or kind == 9)))
    plain, quoted, abuse = t.learn(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).factors
    assert plain == 1.0 and quoted < 0.5 and abuse > 1.1


def plain_score(lexicon, text):
    """The chance of the worst match, with edit distances to every term."""
    import re

    low = (text or "").lower()
    hits = []
    tokens = re.findall(r"\w+|[^\w\s]", low)
    for i, w in enumerate(tokens):
        if not re.fullmatch(r"\w+", w):
            continue
        for k, e in enumerate(lexicon.entries):
            stem = e.term.rstrip("*")
            best = min(distance(stem, w[:n]) for n in range(len(w) + 1)) if e.term.endswith("*") else distance(stem, w)
            if best <= t.edits_allowed(e.term):
                hits.append((i, k, best, t.Scorer._kind(tokens, i)))
    n = min(len({i for i, _, e, _ in hits if not e}), t.COUNTS)
    chances = [lexicon.base] + [(lexicon.entries[k].fuzzy if e else lexicon.entries[k].exact[n - 1]) * lexicon.factors[kind] for _, k, e, kind in hits]
    return min(1.0, max(chances))


def test_contexts():
    lexicon = t.Lexicon([t.Entry("idiot", [0.9] * t.COUNTS, 0.6)], 0.01, (0.5, 0.2, 1.1))
    scorer = t.Scorer(lexicon)
    assert scorer.score("you are an idiot!") == pytest.approx(0.99)
    assert scorer.score("the idiot went home") == pytest.approx(0.45)
    assert scorer.score('he was called "idiot" by the press, the report said') == pytest.approx(0.18)
    assert scorer.score("what an idoit, idot") == pytest.approx(0.3)
    assert scorer.score("nothing here") == pytest.approx(0.01) == scorer.score("") == scorer.score(None)


@pytest.fixture(scope="module")
def corpus(spark, prose):
    r, rows, labels = random.Random(1), [], []
    for i in range(400):
        text, toxic = prose(i % 150, 60), i % 5 == 0
        words = text.split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zorgon", "blemfit", "krastul" + r.choice(["en", "o", "ify"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    copies = [(1000 + k, rows[0][1]) for k in range(80)]
    labels += [(i, 1) for i, _ in copies] + [(1, None), (2, 0), (2, 0), (None, 1)]
    return rows + copies, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_the_lexicon_and_not_words_of_copies(make_docs, corpus):
    rows, labels = corpus
    lexicon = t.learn(make_docs(rows), labels)
    assert {e.term for e in lexicon.entries} >= {"zorgon", "blemfit"}
    assert any(e.term.startswith("krast") and e.term.endswith("*") for e in lexicon.entries)
    assert not {e.term for e in lexicon.entries} & set(rows[1][1].split())


def test_scores_and_filter(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs([*rows, (5000, None), (5001, ""), (5002, "ordinary " * 30_000 + "zorgon blemfit zorgon"), (7, rows[7][1])]).selectExpr("*", "1 AS score", "2 AS toxic")
    lexicon = t.learn(docs, labels)
    scores = {r.doc_id: r.score for r in t.score_texts(docs, lexicon).collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert {i for i, s in scores.items() if s >= t.THRESHOLD} - {5002} == {i for i in scores if i in toxic}
    assert scores[5002] >= t.THRESHOLD and scores[5000] == scores[5001] < t.THRESHOLD
    kept = t.reject_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(s < t.THRESHOLD for s in scores.values()) + 1


def test_scores_equal_brute_force(make_docs, corpus):
    rows, labels = corpus
    docs = make_docs(rows[:200] + [(9000, None), (9001, ""), (9002, "you krastulol zrogon!")])
    lexicon = t.learn(make_docs(rows), labels)
    got = {r.doc_id: r.score for r in t.score_texts(docs, lexicon).collect()}
    assert got == {r.doc_id: pytest.approx(plain_score(lexicon, r.text)) for r in docs.collect()}


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = t.learn(make_docs(["you idiot"]), none)
    assert [r.score for r in t.score_texts(make_docs(["you idiot", None]), lexicon).collect()] == [0.0, 0.0]
    assert t.score_texts(make_docs([]), lexicon).count() == 0
