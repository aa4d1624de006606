import struct

import numpy as np
import pytest
from llm_helpers import stretches

from quillon.llm import substrings as s


def slow_gear(data):
    out = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - s.WINDOW + 1) : i + 1]:
            h = (h * 2 + int(s.GEAR[b])) % 2**32
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one(prose):
    data = prose(4, 60).encode()
    assert s.gear_hash(np.frombuffer(data, np.uint8)).tolist() == slow_gear(data)


@pytest.mark.parametrize("text", ["", "a", "x" * 5000, "la " * 900, "日本語の文章です。" * 300, "né à l'été " * 100, "a\nb " * 40])
def test_chunks_cover_the_text_and_respect_characters(text):
    data, start = text.encode(), 0
    for end in s.chunk_ends(data):
        assert 0 < end - start <= s.LONGEST + s.SHORTEST
        data[start:end].decode()
        start = end
    assert start == len(data)


def test_blocks_do_not_change_cuts(prose, monkeypatch):
    data = np.frombuffer(prose(5, 3000).encode(), np.uint8)
    whole = s.cut_places(data).tolist()
    monkeypatch.setattr(s, "BLOCK", 997)
    assert s.cut_places(data).tolist() == whole


def plain(rows):
    """Repeats by one pass over the documents in order."""
    import hashlib

    import xxhash

    def signed_halves(text):
        return struct.unpack(">qq", hashlib.md5((text or "").encode()).digest())

    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed_halves(r[1]))):
        data, start, chunks = (text or "").encode(), 0, []
        for n, end in enumerate(s.chunk_ends(data)):
            chunk = data[start:end]
            key = xxhash.xxh3_64_intdigest(chunk)
            first = seen.setdefault(key, (doc, text, n))
            if first != (doc, text, n):
                chunks.append((n << 40 | start, len(chunk) << 12 | len(chunk.split())))
            start = end
        out[doc, text] = list(stretches(chunks, s.MIN_WORDS))
    return out


def test_repeats_equal_a_plain_pass(spark, make_docs, prose):
    passage = [prose(100 + i, 60, 4000) for i in range(3)]
    rows = [(i, " ".join(x for x in (prose(i, 120, 4000), passage[i % 3], prose(50 + i, 80, 4000)))) for i in range(12)]
    rows += [(50, rows[0][1]), (51, passage[0]), (52, ""), (53, None), (None, passage[1]), (3, rows[3][1]), (60, "word " * 4000)]
    got = {}
    for r in s.repeats(make_docs(rows)).collect():
        got.setdefault(r.id, set()).add((r.start_byte, r.end_byte, r.n_words))
    expected = {}
    for (doc, _), found in plain(set(rows)).items():
        if found:
            expected.setdefault(doc, set()).update(found)
    assert got == expected
    assert all(i in got for i in range(3, 12)) and 0 not in {k for k in got if k == 0} - {0}


def test_common_digests_are_found_alike(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(s, "COMMON_AT_LEAST", 2)
    monkeypatch.setattr(s, "COMMON", 10**9)
    test_repeats_equal_a_plain_pass(spark, make_docs, prose)


def test_null_ids_of_equal_crc32_keep_their_texts(spark, make_docs, prose):
    """Texts among null ids are told apart by more than 32 bits."""
    import zlib

    passage = prose(7, 70, 4000)
    first = passage + " " + prose(8, 30, 4000)
    seen, i = {}, 0
    while True:  # two texts with one crc32
        key = zlib.crc32(str(i).encode())
        if key in seen:
            break
        seen[key], i = str(i), i + 1
    texts = [first, passage, *(x + prose(9 + k, 40, 4000) for k, x in enumerate((seen[key], str(i)))), seen[key], str(i)]
    out = s.without_repeats(make_docs([(None, t) for t in texts])).collect()
    assert {r.doc_id for r in out} == {None} and len(out) == len(texts)
    assert set(texts[2:]) <= {r.text for r in out}


def test_least_long_as_an_id(spark, make_docs, prose):
    passage = prose(7, 70, 4000)
    docs = make_docs([(-(2**63), passage), (None, passage), (-(2**63), prose(1, 60, 4000))])
    out = s.without_repeats(docs).collect()
    assert sorted(((r.doc_id, len(r.text) > 100) for r in out), key=str) == sorted([(None, True), (-(2**63), False), (-(2**63), True)], key=str)


def test_clashing_columns(spark, make_docs, prose):
    docs = make_docs([(1, prose(7, 70, 4000)), (2, prose(7, 70, 4000))]).selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS cuts", "4 AS id", "5 AS k1", "6 AS f_id", "7 AS c0")
    out = s.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert [(r.doc_id, r.text == "", r._id, r._hash, r.cuts, r.id, r.k1, r.f_id, r.c0) for r in out.orderBy("doc_id").collect()] == [(1, False, 1, 2, 3, 4, 5, 6, 7), (2, True, 1, 2, 3, 4, 5, 6, 7)]


def test_starts_beyond_two_to_the_forty():
    import pyarrow as pa

    far = 1 << 50
    table = pa.table({"id": [None, None, 5], "k1": [1, 1, 1], "k2": [2, 2, 2], "start": [far, far + 100, far + 200], "extent": pa.array([100 << 12 | 15] * 3, pa.int32()), "first_id": pa.array([None, 3, 3], pa.int64())})
    table = table.set_column(0, "id", pa.array([None, None, 5], pa.int64()))
    assert s._runs(table).tolist() == [0, 2]
    assert s._stretches(table, np.array([0, 2, 3]), 20).to_pylist() == [{"id": None, "k1": 1, "k2": 2, "start_byte": far, "end_byte": far + 200, "n_words": 30, "first_ids": [None, 3]}]


def test_runs_over_many_batches(spark, make_docs, prose):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        test_repeats_equal_a_plain_pass(spark, make_docs, prose)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_insertions_do_not_shift_chunks(prose):
    text = prose(9, 400, 4000)
    data, moved = text.encode(), ("something put in front " + text).encode()

    def digests(d):
        ends = s.chunk_ends(d)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    assert len(digests(data) & digests(moved)) >= len(digests(data)) - 3


SCRIPTS = {"thai": (0x0E01, 0x0E2E), "lao": (0x0E94, 0x0EA3), "khmer": (0x1780, 0x17A2), "burmese": (0x1000, 0x1021), "han": (0x4E00, 0x9FA0), "ascii": (0x41, 0x5A)}


def unspaced(script, seed, n):
    r = np.random.default_rng(seed)
    return "".join(map(chr, r.integers(SCRIPTS[script][0], SCRIPTS[script][1] + 1, n)))


@pytest.mark.parametrize("script", SCRIPTS)
def test_insertions_do_not_shift_unspaced_chunks(script):
    text = unspaced(script, 1, 1500)
    data, moved = text.encode(), (unspaced(script, 2, 13) + text).encode()
    first, second = ({d[a:b] for d in (x,) for a, b in zip([0, *s.chunk_ends(d)], s.chunk_ends(d))} for x in (data, moved))
    assert len(first & second) >= len(first) - 8


@pytest.mark.parametrize("script, n", [("thai", 100), ("lao", 100), ("khmer", 100), ("burmese", 100), ("han", 60), ("ascii", 700)])
def test_unspaced_passages_are_found(spark, make_docs, script, n):
    passage = unspaced(script, 5, n)
    docs = make_docs([unspaced(script, 10 + i, 90 + 7 * i) + passage + unspaced(script, 30 + i, 90) for i in range(6)])
    found = {r.id: (r.start_byte, r.end_byte) for r in s.repeats(docs).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    width = len(passage.encode()) // n
    assert all((90 + 7 * i) * width <= a and b <= (90 + 7 * i + n + 3) * width and b - a >= n * width // 2 for i, (a, b) in found.items())


def test_characters_of_unspaced_scripts_are_words():
    assert [s.n_words(x.encode()) for x in ("two words", "né à l'été", "日本語の文章", "ภาษาไทย", "한국어 문장", "GPU 計算。", "")] == [2, 3, 6, 7, 2, 3, 0]


def test_cut_texts(spark, make_docs, prose):
    passage = prose(7, 70, 4000)
    docs = make_docs([(1, prose(1, 50, 4000) + "\n" + passage), (2, "Début " + prose(2, 50, 4000) + "\n" + passage + "\n" + prose(3, 50, 4000)), (3, prose(4, 90, 4000)), (4, None), (5, prose(1, 50, 4000) + "\n" + passage)]).selectExpr("*", "7 AS cuts_", "'x' AS id")
    out = {r.doc_id: r for r in s.without_repeats(docs).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert sorted(out) == [1, 2, 3, 4, 5]
    assert out[1] == before[1] and out[3] == before[3] and out[4].text is None
    assert out[2].text.startswith("Début ") and len(out[2].text) < len(before[2].text) - len(passage) // 2 and passage not in out[2].text
    assert out[2].n_chars == len(out[2].text) and out[2].id == "x"
    assert len(out[5].text) < 80


def test_empty(spark, make_docs):
    assert s.repeats(make_docs([])).count() == 0
    assert s.without_repeats(make_docs([])).count() == 0
