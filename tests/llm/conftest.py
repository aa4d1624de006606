import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text) pairs, with the columns of the table."""

    def make(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts of words; the same for a seed."""

    def make(seed, words, vocabulary=400):
        r = random.Random(seed)
        made = ["".join(r.choice("abcdefghiklmnoprstuvz") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
        return " ".join(r.choice(made) for _ in range(words))

    return make

