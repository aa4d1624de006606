import math
import random

import numpy as np
import pytest

from quillon.llm import quality as q
from quillon.llm.labelled import fold


def plain_ftrl(examples, dim, bias):
    """FTRL-proximal, coordinate by coordinate."""
    z, n, bias_n = [0.0] * dim, [0.0] * dim, 1.0

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for slots, label in examples:
        x = 1 / math.sqrt(len(slots)) if slots else 0.0
        w = {i: weight(i) for i in slots}
        error = 1 / (1 + math.exp(-(bias + sum(w.values()) * x))) - label
        for i in slots:
            g = error * x
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        bias_n += error * error
        bias -= 0.05 * error / math.sqrt(bias_n)
    return [weight(i) for i in range(dim)], bias


def test_updates_by_definition():
    r = random.Random(2)
    examples = [(sorted(r.sample(range(40), r.randrange(0, 9))), r.randrange(2)) for _ in range(300)]
    model = q.Ftrl(40, 0.3)
    for slots, label in examples:
        model.update(np.array(slots, np.int64), label)
    weights, bias = plain_ftrl(examples, 40, 0.3)
    assert model.weights(slice(None)) == pytest.approx(weights) and model.bias == pytest.approx(bias)


def test_features():
    f = q.Features()
    assert len(f.slots(None)) == len(f.slots("")) == 0
    a, b = f.slots("Some words here."), f.slots("Some words here.")
    assert (a == b).all() and (np.diff(a) > 0).all() and a.max() < 1 << q.DIM_BITS
    assert len(set(f.slots("la la la")) - set(f.slots("la li lu"))) > 0


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rows = [(i, prose(i, 80) if i % 4 else prose(i, 40).replace(" ", "%%% ")) for i in range(500)]
    return rows, spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")


def test_held_out_accuracy(make_docs, corpus):
    rows, labels = corpus
    docs = make_docs([*rows, (900, None), (901, ""), (902, "junk%%% " * 20_000), (9, rows[9][1])]).selectExpr("*", "1 AS score", "0 AS quality")
    model = q.learn(docs, labels)
    scored = q.score_texts(docs, model).withColumn("held", fold("doc_id", q.MODULUS) == q.HELD_OUT).collect()
    held = [r for r in scored if r.held and r.doc_id < 500]
    assert len(held) > 50
    assert sum((r.score >= q.THRESHOLD) == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)
    scores = {r.doc_id: r.score for r in scored}
    assert scores[900] == scores[901] and scores[902] < q.THRESHOLD and all(0 <= s <= 1 for s in scores.values())


def test_training_is_repeatable_and_leaves_the_fold_out(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs(rows)
    a, b = q.learn(docs, labels), q.learn(docs.repartition(7), labels)
    assert (a.weights == b.weights).all()
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % {q.MODULUS} = {q.HELD_OUT} THEN 1 - quality ELSE quality END AS quality")
    assert (q.learn(docs, flipped).weights == a.weights).all()


def test_no_labels(spark, make_docs):
    model = q.learn(make_docs(["a b"]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in q.score_texts(make_docs(["a b", None]), model).collect()] == [0.5, 0.5]
    assert q.score_texts(make_docs([]), model).count() == 0
