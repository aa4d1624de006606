import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import components

from quillon.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAbÉß \t\n\x0b\x1c\x85\xa0éZ")), max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_masks_keep_every_close_pair(radius):
    r = np.random.default_rng(radius)
    masks = simhash.masks(radius)
    for _ in range(300):
        flips = sum(1 << int(b) for b in r.choice(64, radius, replace=False)) if radius else 0
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 9)), replace=False)) for _ in range(150)], np.uint64)
    values = base[r.integers(0, 40, 150)] ^ flips
    vertical = simhash.planes(values[:, None])
    q, b = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(len(vertical)), indexing="ij"))
    near = set()
    for i, block, lanes in zip(*simhash.within(values[:, None], vertical, q, b, radius, list(range(64)))):
        near |= {(int(i), int(block) * 64 + k) for k in range(64) if int(lanes) >> k & 1 and block * 64 + k < 150}
    assert near == {(i, j) for i in range(150) for j in range(150) if int(values[i] ^ values[j]).bit_count() <= radius}


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_make_the_right_components(spark, tile):
    r = np.random.default_rng(2)
    values = r.integers(-(2**63), 2**63, 12, dtype=np.int64)
    made = set(values.tolist())
    for v in values[:8]:
        for _ in range(25):
            for b in r.choice(64, int(r.integers(1, 4)), replace=False):
                v = v ^ np.int64(np.uint64(1 << int(b)).astype(np.int64))
            made.add(int(v))
    prints = sorted(made)
    links = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), 3, tile)
    at = {x: i for i, x in enumerate(prints)}
    found = components(len(prints), [(at[x.a], at[x.b]) for x in links.collect()])
    close = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert found == components(len(prints), close)


def test_groups_and_dedup(spark, make_docs, prose):
    a = prose(1, 300)
    texts = [(5, a), (3, a), (9, a.upper()), (7, prose(2, 200)), (11, ""), (12, None), (2, " \n"), (None, a), (7, prose(2, 200)), (20, "x" * 200_000)]
    docs = make_docs(texts)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (11, 2), (12, 2), (2, 2), (None, 3), (20, 20)], key=str)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 20, 3, 7, None]


def test_one_id_on_unrelated_texts(spark, make_docs, prose):
    docs = make_docs([(1, prose(1, 100)), (1, prose(2, 100)), (1, prose(1, 100)), (2, prose(2, 100))])
    docs = docs.selectExpr("*", "1 AS text_hash", "2 AS kept_id", "3 AS kept_hash")
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, prose(1, 100)), (1, prose(2, 100))])


def test_empty_and_extra_columns(spark, make_docs):
    docs = make_docs([]).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS root")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.simhash_dedup(docs).columns == docs.columns
