import os
import random
import struct

import pytest

from quillon.llm import sentencepieces as s


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """A protocol buffer message of (number, bytes or int or float)."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        else:
            out += varint(number << 3) + varint(value)
    return out


def small_model(kind, users=(), dummy=1, trims=0, character_map=b"", words=("the", "▁the", "ing", "▁in", "in", "th", "he", "▁t", "▁a", "an", "and", "▁and", "▁▁", "er", "her", "aa", "aaa")):
    """A model by hand: control pieces, bytes, user-defined pieces, some words and their letters."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(u, 0.0, 4) for u in users]
    words = [w for w in words if w not in users]
    pieces += [(w, -1.0 - k / 8 if kind == s.BPE else -3.0 - len(w) / 9 - k / 7, 1) for k, w in enumerate(sorted(words, key=len))]
    letters = sorted({c for w in words for c in w} | set("xyz") | {s.MARK})
    pieces += [(c, -100.0 - k if kind == s.BPE else -6.0 - k / 5, 1) for k, c in enumerate(letters) if c not in words]
    parts = [(1, message((1, p.encode()), (2, score), (3, t))) for p, score, t in pieces]
    return message(*parts, (2, message((3, kind), (35, 1))), (3, message((1, b"identity"), (2, character_map), (3, dummy), (4, trims), (5, 1))))


@pytest.fixture(scope="module")
def raw():
    """The public vocabulary, or one by hand where there is none."""
    if not os.path.exists(s.MODEL):
        return small_model(s.BPE)
    with open(s.MODEL, "rb") as f:
        return f.read()


@pytest.mark.parametrize("kind", [s.BPE, s.UNIGRAM])
@pytest.mark.parametrize("options", [{}, {"dummy": 0}, {"trims": 1}, {"users": ("[SEP]", "[SE", "▁and", "he")}])
def test_small_models_equal_the_public_library(kind, options):
    import sentencepiece

    raw = small_model(kind, **options)
    if kind == s.UNIGRAM and "users" in options:
        with pytest.raises(ValueError):
            s.Model(raw)
        return
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), s.Model(raw)
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["the", "in", "and", "her", " ", "  ", "a", "x", "[SEP]", "é", "g", "n"]) for _ in range(r.randrange(25)))
        ids = library.encode(text)
        if kind == s.UNIGRAM and model.encode(text) != ids:  # a tie may fall either way
            assert sum(model.scores[i] for i in model.encode(text)) == pytest.approx(sum(model.scores[i] for i in ids), abs=1e-3)
            continue
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids) or "\u2047" in library.decode(ids)


def test_models_that_map_characters_are_refused():
    with pytest.raises(ValueError):
        s.Model(small_model(s.BPE, character_map=b"something"))


def test_all_ids_come_from_committed_windows(raw, monkeypatch):
    """Whatever a text is made of, its ids are those that the streaming lattice commits."""
    model, committed = s.Model(raw), []
    plain = s.Model.stream

    def counted(self, chars):
        for part in plain(self, chars):
            committed.append(part)
            yield part

    monkeypatch.setattr(s.Model, "stream", counted)
    for text in ["the inner and the outer", "aaaa" * 500, "one\ntwo  three", "é"]:
        model.bare.clear(), model.marked.clear(), committed.clear()
        ids = model.encode(text)
        assert sum(map(len, committed)) >= len(set(ids)) > 0 and set(ids) == {i for part in committed for i in part}
    assert s.Model(raw).encode("the the the") == s.Model(raw).encode("the the") + s.Model(raw).encode("the the")[-1:]
    monkeypatch.setattr(s.Model, "stream", lambda self, chars: iter(()))
    assert s.Model(raw).encode("the inner and the outer\n" + "x" * 900) == []


def texts(n):
    r = random.Random(8)
    pieces = ["the", " ", "  ", "\n", "\t", "né", "梦", "😀", "<s>", "<0x0A>", "hello", "ing", ".", ",", "0", "99", "Thntble", "xyzzy", "aaaa"]
    return ["", " ", "a"] + ["".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(n)]


def test_ids_equal_the_public_library(raw):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), s.Model(raw)
    for t in texts(400):
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == t or "▁" in t
        marked = s.MARK + t.replace(" ", s.MARK) if t else ""
        assert [i for part in model.stream(marked[k : k + 7] for k in range(0, len(marked), 7)) for i in part] == ids


def test_window_stays_bounded(raw):
    """Ids are committed while a text without spaces goes on and on."""
    model = s.Model(raw)
    given = committed = most = 0

    def chars():
        nonlocal given
        for _ in range(400):
            given += 16
            yield "internationalise"

    for part in model.stream(chars()):
        committed += sum(len(model.pieces[i]) for i in part)
        most = max(most, given - committed)
    assert committed == 6400 and most <= 4 * model.longest


def best_path(model, text):
    """Highest score of any segmentation, by a whole table."""
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + model.longest) + 1):
            k = model.ids.get(text[i:j])
            score = model.scores[k] if k is not None else model.unknown_score if j == i + 1 else float("-inf")
            best[j] = max(best[j], best[i] + score)
    return best[-1]


def test_unigram_viterbi_is_optimal(raw):
    model = s.Model(raw)
    model.kind = s.UNIGRAM
    r = random.Random(1)
    for _ in range(60):
        text = s.MARK + "".join(r.choice("theingandorst梦q" + s.MARK) for _ in range(80))
        ids = [i for part in model.stream(text[k : k + 9] for k in range(0, 81, 9)) for i in part]
        score, at = 0.0, 0
        while at < len(ids):
            if ids[at] in model.byte_of:
                at += 3  # the one unknown character here has three bytes
                score += model.unknown_score
            else:
                score += model.scores[ids[at]]
                at += 1
        assert score == pytest.approx(best_path(model, text)) or "梦" in model.ids


def test_tables(spark, make_docs, raw, tmp_path):
    path = tmp_path / "piece.model"
    path.write_bytes(raw)
    docs = make_docs(["Hello  world\n", None, "", "x" * 100_000, "né 梦 ▁"]).selectExpr("*", "1 AS n_tokens")
    got = {r.doc_id: r for r in s.with_token_ids(docs, str(path)).collect()}
    assert [got[i].round_trip for i in range(5)] == [True, True, True, True, False]
    assert got[1].token_ids == [] == got[2].token_ids and got[0].n_tokens == len(got[0].token_ids)
    back = {r.doc_id: r.text for r in s.decode_texts(s.encode_texts(docs, str(path)), str(path)).collect()}
    assert back[0] == "Hello  world\n" and back[1] == "" and back[4] == "né 梦  "
    assert s.encode_texts(docs.limit(0), str(path)).count() == 0
