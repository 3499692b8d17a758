"""The stored index against the plain search, and joins with frequent keys."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import index, joins, retrieval
from siftwell.sources import postings


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(1, 60))) for _ in range(400)]
    texts[7] = "all " + " ".join(words)
    rows = [(i, "the " + t if i % 10 else t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "!!"), (903, texts[7])]
    queries = [(q, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for q in range(30)] + [(100, "the w1"), (101, "nowhere"), (102, ""), (103, None), (104, "the the THE w250")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(queries, "query_id long, text string").cache()


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("slab_docs, few", [(1024, True), (16, True), (16, False)])
def test_stored_search_equals_the_plain_one(spark, corpus, tmp_path, monkeypatch, slab_docs, few):
    docs, queries = corpus
    if not few:
        monkeypatch.setattr(postings, "BROADCAST_PAIRS", 0)
        monkeypatch.setattr(postings, "QUERIES", 7)
    postings.write(docs, str(tmp_path / "index"), slab_docs=slab_docs)
    stored = postings.Stored(spark, str(tmp_path / "index"))
    for k in (2, 50):
        assert rows(stored.search(queries, k)) == rows(retrieval.bm25(docs, queries, k))
    assert rows(stored.search(queries.filter("query_id = 101"))) == []


def test_only_the_folders_of_the_terms_are_read(spark, corpus, tmp_path):
    docs, _ = corpus
    postings.write(docs, str(tmp_path / "index"), slab_docs=32)
    stored = postings.Stored(spark, str(tmp_path / "index"))
    asked = stored.asked(spark.createDataFrame([(1, "w3 w3 nowhere")], "query_id long, text string"))
    folders = stored.folders(asked)
    assert asked.count() == 2 and len(folders) <= 2
    read = [r[0] for r in stored._table("blocks", folders).select(F.input_file_name()).distinct().collect()]
    assert read and all(any(f"folder={n}/" in f for n in folders) for f in read)
    blocks = spark.read.parquet(str(tmp_path / "index" / "blocks"))
    assert blocks.filter("term = 'the'").count() == stored.told["slabs"]
    assert blocks.agg(F.max(F.size("postings"))).first()[0] <= 64 and not (tmp_path / "index" / "counted").exists()


def test_floors_leave_slabs_out(spark, tmp_path):
    """Documents with a rare word outweigh all others, so slabs without one are not scored."""
    texts = [("rare " * 5 if i < 12 else "") + "common filler" for i in range(640)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    postings.write(docs, str(tmp_path / "index"), slab_docs=16)
    stored = postings.Stored(spark, str(tmp_path / "index"))
    scored = []
    plain = postings.Stored._scored

    def counted(self, blocks, pairs, k, small):
        scored.append(pairs.select("query_id", "slab").distinct().count())
        return plain(self, blocks, pairs, k, small)

    postings.Stored._scored = counted
    try:
        assert rows(stored.search(queries, 1)) == rows(retrieval.bm25(docs, queries, 1))
    finally:
        postings.Stored._scored = plain
    assert sum(scored) < stored.told["slabs"] / 2


def test_an_empty_index_and_another_version(spark, tmp_path):
    postings.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert postings.Stored(spark, str(tmp_path / "none")).search(asked).count() == 0
    spark.read.parquet(str(tmp_path / "none" / "whole")).withColumn("version", F.lit(99)).write.parquet(str(tmp_path / "other" / "whole"))
    with pytest.raises(ValueError):
        postings.Stored(spark, str(tmp_path / "other"))


def test_bm25_by_shuffle_equals_broadcast(corpus, monkeypatch):
    docs, queries = corpus
    want = rows(retrieval.bm25(docs, queries, 10))
    monkeypatch.setattr(retrieval, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(joins, "SALT_ROWS", 40)
    assert rows(retrieval.bm25(docs, queries, 10)) == want
    monkeypatch.setattr(index, "BROADCAST_TERMS", 0)
    assert rows(retrieval.bm25(docs, queries, 10)) == want


def test_joins_with_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "SALT_ROWS", 30)
    rng = random.Random(1)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{rng.randrange(40)}", i) for i in range(600)]
    left = spark.createDataFrame(data, "k string, i long")
    keyed = left.groupBy("k").agg(F.count("*").alias("n")).filter("k is null or k <> 'k3'")
    counts = collections.Counter(k for k, _ in data)
    want = sorted((k, i, counts[k]) for k, i in data if k not in (None, "k3"))
    got = joins.with_key_columns(left, keyed, "k", "n", 600, share=20)
    assert sorted(map(tuple, got.select("k", "i", "n").collect())) == want
    many = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "a"), ("none", "c")], "k string, q string").withColumn("n", F.expr(f"case when k = 'hot' then {counts['hot']} else 10 end"))
    found = sorted(map(tuple, joins.salted(got, many, "k", "n", "i").select("k", "i", "q").collect()))
    assert found == sorted((k, i, q) for k, i, _ in want for q in {"hot": "ab", "k1": "a"}.get(k, ""))
