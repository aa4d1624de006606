import numpy as np
import pytest
from llm_helpers import components

from quillon.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = []
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i < j and ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if embeddings.exact_cosine(x, y) >= threshold:
                    links.append((i, j))
    comp = components(len(rows), links)
    n = [sum(i in p for p in links) for i in range(len(rows))]
    return {rows[i][0]: (n[i], min(rows[k][0] for k in range(len(rows)) if comp[k] == comp[i])) for i in range(len(rows))}


def table(rows):
    r = np.random.default_rng(3)
    out = []
    for i in range(rows):
        centre = np.random.default_rng(i % 7).normal(size=16)
        out.append((i, (centre + r.normal(size=16) * r.choice([0.01, 0.1, 0.14, 1.0])).tolist(), i % 3))
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = table(160)
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, [2 * x for x in rows[0][1]], rows[0][2]), (903, rows[0][1], None), (904, None, 1), (905, [0.0] * 16, 1), (906, [None] + [1.0] * 15, 1), (907, [float("nan")] * 16, 1), (908, [1.0, 2.0], 1), (909, [1.0, 2.0], 1), (910, [float("inf")] * 16, 1), (911, [], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    assert found == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_pair_is_lost_between_cells():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8))
    x = np.r_[x, x + r.normal(size=x.shape) * 0.05]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embeddings.kmeans(x, 30)
    cells = embeddings.cells_of(x, centres)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert cells[i][0] in cells[j] or cells[j][0] in cells[i]


def test_repeated_rows_are_one_vector(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [1.0, 0.001], 0, "")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)}


def test_small_samples_null_ids_and_signed_zeros(spark, monkeypatch):
    """Whatever the sample, no link is lost; the sample is bounded in components too."""
    monkeypatch.setattr(embeddings, "VALUES", 80)
    monkeypatch.setattr(embeddings, "TILE", 7)
    rows = table(90) + [(901, [0.0, 1.0], 0), (902, [-0.0, 1.0], 0), (903, [None, 1.0], 0), (904, [1.0, None], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    some = [(None, [1.0, 0.0], 0, ""), (5, [1.0, 0.0], 0, ""), (None, None, 0, "")]
    got = embeddings.near_duplicates(spark.createDataFrame(some, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == [(5, 1, 5, True), (None, 0, None, False), (None, 1, 5, False)]
