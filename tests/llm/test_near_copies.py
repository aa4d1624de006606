import random

import corpus_pipeline
from llm_helpers import components

from quillon.llm import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, target, seed):
    """text with as many words replaced as leave a Jaccard of about target."""
    r, words = random.Random(seed), text.split()
    base = plain_shingles(text)
    while True:
        trial = list(words)
        trial[r.randrange(len(trial))] = f"new{r.randrange(10**6)}"
        if plain_jaccard(base, plain_shingles(" ".join(trial))) < target:
            return " ".join(words)
        words = trial


def test_stage_equals_brute_force_on_edited_copies(spark, make_docs, prose):
    """Copies of Jaccard 0.80 to 0.95, others below, exact ones, short and empty texts."""
    texts = [prose(i, 200 + 9 * i, 3000) for i in range(40)]
    texts += [edited(texts[i], 0.80 + 0.004 * i, i) for i in range(38)]
    texts += [edited(texts[39], 0.7, 1), texts[3].upper(), texts[3], "a b c", "A b  c", "a b d", "", " \n", None]
    sets = [plain_shingles(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if plain_jaccard(sets[a], sets[b]) >= 0.8]
    group = components(len(texts), links)
    kept = corpus_pipeline.near_duplicates(spark, make_docs(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g in enumerate(group) if g == i]
    assert sum(1 for a, b in links if b >= 40) >= 38


def test_chains_and_large_groups(spark, make_docs, prose, monkeypatch):
    """Groups over several tiles, and chains whose ends are no near copies of each other."""
    monkeypatch.setattr(near_copies, "TILE", 7)
    base, texts = prose(1, 300, 3000), []
    for i in range(40):
        texts.append(base)
        base = edited(base, 0.9, i)
    texts += [edited(prose(2, 300, 3000), 0.9, 100 + i) for i in range(40)]
    sets = [plain_shingles(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if plain_jaccard(sets[a], sets[b]) >= 0.8]
    group = components(len(texts), links)
    kept = near_copies.without_near_copies(make_docs(texts))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g in enumerate(group) if g == i]


def test_one_id_on_unrelated_texts(spark, make_docs, prose):
    docs = make_docs([(1, prose(1, 100)), (1, prose(2, 100)), (1, prose(1, 100)), (2, prose(2, 100)), (None, prose(1, 100))])
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, prose(1, 100)), (1, prose(2, 100)), (None, prose(1, 100))], key=str)


def test_tile_links_equal_brute_force(monkeypatch):
    """Links of a tile pair make the components of all its near copies, by single pairs and by matrix products."""
    import numpy as np

    r = np.random.default_rng(5)
    base = [r.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[base[k][r.random(60) < 0.93], r.integers(0, 2**63, 2, dtype=np.uint64)]) for k in r.integers(0, 4, 150)] + [np.empty(0, np.uint64)] * 2
    n = len(sets)
    prints = np.array([near_copies.fingerprint(x) for x in sets], np.uint64)
    label, own = r.integers(0, 100, n) + 1000, r.integers(0, 2, n)
    everyone = np.arange(n)
    for few, columns in ((10**6, 1024), (0, 16)):
        monkeypatch.setattr(near_copies, "FEW", few)
        monkeypatch.setattr(near_copies, "COLUMNS", columns)
        for left, right in ((everyone, everyone), (np.flatnonzero(own == 0), np.flatnonzero(own == 1))):
            known = [(int(u), int(v)) for u in everyone for v in everyone if label[u] == label[v] and u < v]
            near = [(int(u), int(v)) for u in left for v in right if u != v and near_copies.jaccard(sets[u], sets[v]) >= 0.8]
            a, b = near_copies.near_links(prints, label, left, right, near_copies.Sets(sets))
            got = components(n, known + list(zip(a.tolist(), b.tolist())))
            assert got == components(n, known + near) and len(a) < n


def test_extra_columns_and_empty(spark, make_docs, prose):
    docs = make_docs([prose(1, 100), prose(1, 100), None, ""]).selectExpr("*", "1 AS own_node", "2 AS kept_id", "3 AS node", "4 AS KEPT_NODE")
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert near_copies.without_near_copies(docs.limit(0)).count() == 0
