"""Text vectors against numpy's decomposition, and the seam for models."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import retrieval
from siftwell.operators import text_vectors as tv

FEATURES = 512


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(5)]
    texts = [" ".join(rng.choices(topics[i % 5], k=20) + rng.choices(["and", "of"], k=6)) for i in range(120)] + ["", None, "?!", "word " * 3000]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def table(spark, texts):
    words = sorted({w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower())})
    place = {r["w"]: r["f"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(FEATURES)).alias("f")).collect()}
    counts = np.zeros((len(texts), FEATURES))
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            counts[i, place[w]] += 1
    df = (counts > 0).sum(0)
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.log((len(texts) - df + 0.5) / (df + 0.5) + 1)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def test_rows_and_basis_are_those_of_numpy(spark, corpus):
    texts, docs = corpus
    rows, _ = tv.weighted(docs, features=FEATURES)
    a, got = table(spark, texts), np.zeros((len(texts), FEATURES))
    for r in rows.collect():
        got[r["id"], r["at"]] = r["w"]
    assert np.allclose(got, a)
    v = tv.basis(rows, rank=8, features=FEATURES, rounds=6)
    want = np.linalg.svd(a)[2][:5].T  # five topics lead by far
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-9) and np.linalg.norm(want - v @ (v.T @ want)) < 0.01
    found = {r["id"]: np.array(r["vector"]) for r in tv.projected(rows, v).collect()}
    plain = a @ v
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-300)
    assert len(found) == len(texts) and all(np.allclose(found[i], plain[i], atol=1e-9) for i in found)


def test_texts_of_a_topic_are_near(spark, corpus):
    texts, docs = corpus
    space = tv.TextVectors(docs, rank=8, features=FEATURES)
    asked = spark.createDataFrame([(t, f"t{t}w0 t{t}w5 unheard") for t in range(5)] + [(9, "unheard")], "query_id long, text string")
    docs_ = space.of_docs().withColumnsRenamed({"id": "doc_id", "vector": "embedding"})
    best = retrieval.dense(docs_, space.of(asked).withColumnRenamed("id", "query_id"), 5).filter("query_id < 9").collect()
    assert len(best) == 25 and all(r["doc_id"] % 5 == r["query_id"] for r in best)
    assert {r["id"]: set(r["vector"]) for r in space.of(asked).filter("id = 9").collect()} == {9: {0.0}}


def test_no_texts(spark):
    space = tv.TextVectors(spark.createDataFrame([], "doc_id long, text string"), features=FEATURES)
    assert space.of_docs().count() == 0 and space.of(spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 1


def test_a_model_is_loaded_once_a_task(spark):
    def load():
        calls = []

        def model(texts):
            calls.append(len(texts))
            return [[float(len(t)), float(len(calls))] for t in texts]

        return model

    docs = spark.createDataFrame([(i, "x" * i if i else None, [9.0]) for i in range(10)], "doc_id long, text string, vector array<double>").coalesce(1)
    rows = tv.embedded(docs, load, rows=4).collect()
    assert [r["vector"] for r in rows] == [[float(i), float(i // 4 + 1)] for i in range(10)]
