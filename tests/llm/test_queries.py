"""The registered queries on the smallest tables: their columns and flags, and their rows against SQL or brute force."""

import math
import zlib

import duckdb
import pytest
from llm_helpers import components
from test_simhash import plain_fingerprint

from quillon.llm import languages, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, engine, name):
    df = queries.queries()[name](spark, SF)
    cursor = engine.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall()) == sorted(str([r[c] for c in sorted(columns)]) for r in df.collect())


@pytest.mark.parametrize("name, module", [("op2_toxicity", toxicity), ("op9_quality", quality)])
def test_scores_and_flags(spark, name, module):
    df = queries.queries()[name](spark, SF)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.MODULUS == module.HELD_OUT) for r in rows)


def test_quality_scores_equal_brute_force(spark):
    """Scores from the learned weights by a plain sum over the distinct slots of every text."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, features = quality.learn(docs.select("doc_id", "text"), labels), quality.Features()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op9_quality(spark, SF).collect():
        slots = set(features.slots(texts[r.doc_id]).tolist())
        total = model.bias + (math.fsum(float(model.weights[s]) for s in slots) / math.sqrt(len(slots)) if slots else 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))), rel=1e-4)


def test_language_columns(spark):
    rows = queries.op6_language_id(spark, SF).collect()
    known = {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert list(rows[0].asDict()) == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.lang_pred in known | {"und"} and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % languages.MODULUS == languages.HELD_OUT) for r in rows)


def test_fingerprints_and_components_by_definition(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    group = components(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    expected = {docs[i][0]: (f"{prints[i]:016x}", docs[group[i]][0]) for i in range(len(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_near_dedup(spark, SF).collect()} == expected
