import random

import numpy as np
import pytest

from quillon.llm import languages as g


def plain_phrases(text, sample):
    """Greedy longest phrases of text that occur in sample; a symbol that doesn't occur is a phrase."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_automaton_parses_into_longest_phrases():
    r = random.Random(5)
    for _ in range(60):
        sample = bytes(r.choice([1, 2, 3]) for _ in range(r.randint(1, 80)))
        text = bytes(r.choice([1, 2, 3, 3, 4]) for _ in range(r.randint(1, 60)))
        automaton = g.Transitions(g.suffix_automaton(list(sample)))
        state, phrases = np.zeros(1, np.int32), 0
        for c in text:
            state, ended = automaton.step(state, np.array([c]))
            phrases += int(ended[0])
        # The root has no phrase: the first symbol ends none unless the sample lacks it.
        phrases -= text[0] not in sample
        assert phrases + 1 == plain_phrases(text, sample)


def test_phrases_of_segments_add_up():
    found = g.Identifier({"a": "abcabcabd " * 30, "b": "xyzzyxzz " * 30})
    codes = [g.symbols("abcabd abcab " * 60, found.table), g.symbols("xyzzy", found.table), np.empty(0, np.uint8)]
    counts = found.phrases(codes)
    assert counts[0, 0] < counts[0, 1] and counts[1, 1] < counts[1, 0] and (counts[2] == 0).all()


WORDS = {"en": "the of and tion ing her ent with that", "de": "der die und ung lich keit sch ein", "xx": "qa zu wibo lemu tari"}


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(3), []
    for i in range(240):
        lang = ("en", "de", "xx")[i % 3]
        stems = WORDS[lang].split()
        rows.append((i, " ".join(r.choice(stems) + r.choice(stems) for _ in range(40)), lang))
    return rows


def test_held_out_accuracy(spark, corpus):
    rows = [*corpus, (500, None, "en"), (501, "12 34 !", "en"), (502, "", None), (503, corpus[0][1] * 300, None), (None, corpus[1][1], None), (3, corpus[3][1], "en"), (504, "a", None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, lang_pred int")
    found = g.identify(docs, g.training_texts(docs)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in corpus)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "en"
    assert got[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in found)


def test_the_held_out_fold_is_not_learned_from(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    lied = docs.selectExpr("doc_id", "text", f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % {g.MODULUS} = {g.HELD_OUT} THEN 'lie' ELSE lang END AS lang")
    assert g.training_texts(docs) == g.training_texts(lied)


def test_query_equals_brute_force(spark, corpus):
    """Predictions of the table from plain greedy phrases over the same samples; whole texts, held-out flags and columns."""
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in corpus] + [(900, corpus[2][1] * 30, None, "s", 0), (901, "?", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    samples = g.training_texts(docs)
    found = g.Identifier(samples)
    known = {n: bytes(g.symbols(t, found.table)) for n, t in samples.items()}
    got = {r.doc_id: r.lang_pred for r in g.identify(docs, samples).collect()}
    for r in docs.collect():
        codes = bytes(g.symbols(r.text, found.table))
        if not any(codes):
            assert got[r.doc_id] == "und"
            continue
        cost = {n: sum(plain_phrases(codes[a : a + g.SEGMENT], k) for a in range(0, len(codes), g.SEGMENT)) * np.log2(len(k)) for n, k in known.items()}
        assert got[r.doc_id] == min(sorted(cost), key=cost.get)


def test_a_language_learns_from_whole_rows(spark):
    """Long documents are learned whole where there are no others, and more languages take nothing from one."""
    long = "wibo lemu " * 9000
    rows = [(1, long, "xx"), (4, long + "tail", "xx"), (5, "kurz und gut", "de")] + [(10 + i, f"text{i} " * 9, f"l{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = {r.doc_id for r in docs.where(f"crc32(cast(cast(doc_id AS string) AS binary)) % {g.MODULUS} = {g.HELD_OUT}").collect()}
    texts = g.training_texts(docs)
    whole = {i: t for i, t, _ in rows if i not in held_out}
    assert texts["xx"] in {whole[i] for i in (1, 4) if i in whole} or texts["xx"] == "\n".join(whole[i] for i in (1, 4))
    assert len(texts["xx"]) >= len(long)
    few = g.training_texts(docs.where("lang IN ('xx', 'de')"))
    assert all(texts[k] == few[k] for k in few)


def test_repeated_rows_are_drawn_once(spark):
    docs = spark.createDataFrame([(1, "aaa", "xx")] * 50 + [(1, "bbb", "xx"), (3, "ccc", "xx")], "doc_id long, text string, lang string")
    assert sorted(g.training_texts(docs)["xx"].split("\n")) == ["aaa", "bbb", "ccc"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in g.identify(docs, g.training_texts(docs)).collect()] == [(1, "und", 0.0)]
    assert g.identify(docs.limit(0), {"en": "abc"}).count() == 0
