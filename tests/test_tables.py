"""Passages and the documents that hold them, against plain containment."""

import random

import pytest

from siftwell.plans import tables


@pytest.mark.parametrize("few", [tables.BROADCAST_ITEMS, 0])
def test_gold_against_containment(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tables, "BROADCAST_ITEMS", few)
    rng = random.Random(7)
    words = ["ab", "b", "abc", "wonderful", "wonderfully", "é𝄞x", "long𝄞er"]
    texts = [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60)] + ["", None, "a", "ab" * 5000]
    passages = ["", None, "a", "b", "ab b", "b\nab", "wonderful", "onderfull", "wonderfully", "é𝄞x ab", "𝄞", "𝄞er", " ", "ab ab", "bab", "zz", "a" * 40, "ab" * 20]
    passages += [t[i : i + rng.randrange(1, 60)] for t in texts[:30] for i in [rng.randrange(len(t))]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["query_id"], r["doc_id"]) for r in tables.gold(spark, str(tmp_path)).collect())
    assert got == [(q, i) for q, p in enumerate(passages) if p is not None for i, t in enumerate(texts) if t is not None and p in t]


def test_gold_makes_no_row_for_each_word(spark, tmp_path):
    """A text's words are looked up in its task: rows leave it for the passages that it holds only."""
    texts = ["a common b rare c", "a common b c", "x a common b rare c y\n" * 3, " ab ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = ["a common b rare c", "a common b c", "x a common  b", "common b rare", " ab ", "\ta common b"]
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = tables.gold(spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(q, i) for q, p in enumerate(asked) for i, t in enumerate(texts) if t is not None and p in t]
