"""The pipeline against its stages' plain versions, on a small table of each kind of document."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents: good prose, junk, copies, a benchmark passage, secrets."""
    rng = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti") for c in ("n", "m", "la", "ve")]
    text = lambda n: " ".join(rng.choice(words, n))
    good = [(i, ". ".join(text(12) for _ in range(6))) for i in range(120)]
    junk = [(1000 + i, text(60).upper().replace(" ", "!! ")) for i in range(120)]
    leak = text(15)
    more = [(2000, good[0][1]), (2001, good[1][1] + " extra"), (2002, good[5][1][:200] + leak + good[6][1][:200]), (2003, good[7][1][:150] + ' password = "hunter2secret" ' + good[8][1][:150])]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk + more]
    base = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, text(20))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    docs = documents
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
    gone = {name: set(a) - set(b) for name, (a, b) in seen.items()}
    assert len(gone["quality"] & set(range(1000, 1120))) >= 118 and len(gone["quality"] - set(range(1000, 1120))) <= 2
    assert gone["near_duplicates"] - {1001} == {2000, 2001} - gone["quality"] and gone["benchmark"] == {2002} and gone["secrets"] == set()
    a, b = seen["secrets"]
    assert {i for i in a if a[i] != b[i]} == {2003} and "hunter2secret" not in b[2003]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(b)
    assert all(r.decoded_sha256 == hashlib.sha256(b[i].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens for i, r in out.items())


def test_near_duplicates_from_four_fifths(spark):
    """Of 100 shingles in each text, two changed words leave 90 of 110 in common, three leave 85 of 115."""
    rows = []
    for i in range(20):
        words = [f"d{i}w{j}" for j in range(104)]
        for k, places in enumerate(((), (30, 60), (20, 50, 80))):
            rows.append((100 * k + i, " ".join("changed" if j in places else w for j, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    assert kept == set(range(20)) | set(range(200, 220))


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert queries.op5_byte_bpe(spark, str(tmp_path)).count() == 0


def test_every_query_runs(spark, folder):
    spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i % 4, i, "user", f"turn {i}.") for i in range(20)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    # one vector is a query; how many words occur often enough is not told here
    rows = {"op2_embedding_dedup": 20, "op11_nearest_neighbours": 10, "op12_spelling_variants": None, "op13_conversation_repair": 4}
    for name, query in queries.queries().items():
        found = query(spark, folder).agg(F.count("*")).first()[0]
        assert rows.get(name, 244) in (found, None), name
    assert len(queries.queries()) == 13
