import os

import pytest
from llm_helpers import components, stretches

import corpus_pipeline
from quillon.llm import benchmarks, queries, sentencepieces, simhash, substrings, toxicity

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepieces.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    item, passage = prose(500, 30, 3000), prose(501, 70, 3000)
    texts = [prose(i, 120 + i, 3000) for i in range(60)]
    texts[5] = texts[4]
    texts[9] = texts[8] + " once more"
    texts[20] += " " + item
    for i in (31, 32, 33):
        texts[i] = prose(700 + i, 60, 3000) + "\n" + passage + "\n" + prose(800 + i, 60, 3000)
    for i in range(0, 60, 6):
        texts[i] += " zorgon you zorgon"
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(90, None, None, None, None), (91, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "sentencepiece"]


def test_run_equals_brute_force(spark, corpus):
    """The pipeline in plain Python, stage by stage, over the same documents."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    table = spark.read.parquet(f"{corpus}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.learn(table, spark.read.parquet(f"{corpus}/labels.parquet")))
    docs = {i: t for i, t in docs.items() if scorer.score(t) < toxicity.THRESHOLD}
    assert all(i % 6 or i >= 60 for i in docs)

    ids = sorted(docs)
    prints = [simhash.fingerprint(docs[i]) for i in ids]
    group = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    docs = {i: docs[i] for k, i in enumerate(ids) if group[k] == k}
    assert 5 not in docs and 4 in docs

    import xxhash

    seen, cut = {}, {}
    for i in sorted(docs):
        data, start, later = (docs[i] or "").encode(), 0, []
        for n, end in enumerate(substrings.chunk_ends(data)):
            first = seen.setdefault(xxhash.xxh3_64_intdigest(data[start:end]), (i, n))
            if first != (i, n):
                later.append((n << 40 | start, (end - start) << 12 | len(data[start:end].split())))
            start = end
        spans = [{"start_byte": a, "end_byte": b} for a, b, *_ in stretches(later, substrings.MIN_WORDS)]
        cut[i] = substrings.cut(docs[i], spans) if spans else docs[i]
    assert cut[31] == docs[31] and cut[32] != docs[32]
    docs = cut

    item = " ".join(spark.read.parquet(f"{corpus}/benchmark.parquet").first().text.split())
    docs = {i: t for i, t in docs.items() if item not in " ".join(benchmarks.words_of(t))}
    assert 20 not in docs

    with open(sentencepieces.MODEL, "rb") as f:
        model = sentencepieces.Model(f.read())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    assert {i: (r.text, r.token_ids) for i, r in got.items()} == {i: (t, model.encode(t)) for i, t in docs.items()}


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), corpus).count() == 0


def test_every_operator_is_registered():
    found = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(found)
