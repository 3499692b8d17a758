"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import blocks, retrieval, vectors

SCHEMA = "doc_id long, embedding array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(20, 16)))
    own = unit(centres[rng.integers(0, 20, 1500)] + 0.08 * rng.normal(size=(1500, 16)))
    asked = unit(own[:40] + 0.02 * rng.normal(size=(40, 16)))
    rows = [(i, x.tolist()) for i, x in enumerate(own)] + [(9000, None), (None, own[0].tolist())]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)] + [(99, None)], "query_id long, vector array<double>")
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache(), queries.cache()


@pytest.fixture(scope="module")
def stored(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vectors.write(clustered[0], path, lists=40)
    return vectors.Stored(spark, path)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))


def test_all_lists_give_the_exact_result(clustered, stored, monkeypatch):
    docs, queries = clustered
    want = rows(retrieval.dense(docs.filter("doc_id is not null"), queries, 10))
    assert len(want) == 400 and rows(stored.search(queries, 10, probes=1000)) == want
    monkeypatch.setattr(vectors, "VECTORS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    assert rows(stored.search(queries, 10, probes=1000)) == want


def test_few_lists_find_nearly_all(clustered, stored):
    docs, queries = clustered
    want = {r[:1] + r[2:3] for r in rows(retrieval.dense(docs.filter("doc_id is not null"), queries, 10))}
    curve = {r["probes"]: r["recall"] for r in stored.curve(queries, 10).collect()}
    need = stored.probes_for(queries, 0.95, 10)
    got = {r[:1] + r[2:3] for r in rows(stored.search(queries, 10, probes=need))}
    assert need <= 8 and curve[need] == pytest.approx(len(got & want) / len(want)) and curve[need] >= 0.95


def test_only_probed_lists_are_opened(stored, clustered):
    one = clustered[1].limit(1)
    lists = [r["list"] for r in stored.probes(one, 3).collect()]
    opened = {r[0].split("list=")[1].split("/")[0] for r in stored.rows(lists).select(F.input_file_name()).distinct().collect()}
    assert len(lists) == 3 and opened <= set(map(str, lists))


def test_centroids_are_those_of_plain_k_means(spark, clustered):
    docs = clustered[0].filter("doc_id is not null and embedding is not null")
    got = vectors.centroids(docs, 6)
    rows = docs.select(F.xxhash64(F.lit("centroids"), "doc_id").alias("h"), "embedding").orderBy("h").collect()
    x = np.array([r["embedding"] for r in rows])
    centres = x[:6]
    for _ in range(vectors.ROUNDS):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(6)])
    assert np.allclose(got, centres, atol=1e-6)


def test_one_place_for_all_vectors_and_none(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], SCHEMA)
    vectors.write(same, str(tmp_path / "same"))
    queries = spark.createDataFrame([(1, [0.5, 0.5])], "query_id long, vector array<double>")
    assert rows(vectors.Stored(spark, str(tmp_path / "same")).search(queries, 5, probes=100)) == [(1, i + 1, i, 0.5) for i in range(5)]
    vectors.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert vectors.Stored(spark, str(tmp_path / "none")).search(queries).count() == 0


def test_centroids_have_a_bound(clustered, monkeypatch):
    monkeypatch.setattr(vectors, "CENTROID_BYTES", 100)
    with pytest.raises(ValueError):
        vectors.centroids(clustered[0].filter("embedding is not null"), 40)


def test_blocks_of_short_and_null_vectors(spark):
    left = spark.createDataFrame([(0, "a", [1.0, 2.0]), (0, "b", [3.0]), (0, "c", [None, 1.0])], "part int, id string, v array<double>")
    right = spark.createDataFrame([(0, 1, [1.0, 1.0, 9.0])], "part int, id long, v array<double>")
    found = {tuple(r) for r in blocks.met(left, right, ["part"], None, 0.0).collect()}
    assert found == {(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0)}
    assert {r["key"] for r in blocks.met(left, right, ["part"], 1, 1e-6).collect()} == {"a", "b"}
