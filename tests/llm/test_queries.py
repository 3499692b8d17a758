"""The registered queries of the corpus operators over a small table with a null id, a null text and a repeated row."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_join": ["doc_id", "class_id", "copy_id", "n_copies", "n_links", "n_linked_texts"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stratum", "base_failed", "kept"],
    "op4_mixing": ["doc_id", "source", "lang", "topic", "tokens", "prob", "sampled"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
    "op8_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op13_simhash_dedup": ["doc_id", "fingerprint", "component_id", "n_copies"],
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = docs.filter("doc_id = 7")
    odd = [row, row.withColumn("doc_id", F.lit(None).cast("long")), row.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(5000).cast("long"))]
    for r in odd:
        docs = docs.unionByName(r)
    docs.write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_a_row_for_each_document(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert found.columns == COLUMNS[name]
    rows = found.collect()
    given = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, given))
    if "held_out" in found.columns:
        of, rest = (3, 1) if name.startswith("op5") else (5, 0)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % of == rest) for r in rows)
    if name.startswith("op8"):
        ordered = sorted(rows, key=lambda r: r["start"])
        assert ordered[0]["doc_id"] is None and [r["doc_id"] for r in ordered[1:]] == sorted(x for x in given if x is not None)
        assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(ordered, ordered[1:], strict=False)) and ordered[-1]["n_tokens"] == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_removals_and_searches(spark, sf_dir):
    lines = QUERIES["op6_line_dedup"](spark, sf_dir)
    assert lines.columns == ["doc_id", "line", "keep_doc_id", "keep_line"] and lines.filter("doc_id is null and keep_doc_id = 7").count() > 0
    assert QUERIES["op7_substring_dedup"](spark, sf_dir).columns == ["doc_id", "start", "stop", "n_words", "first_doc_id"]
    best = QUERIES["op2_topk_search"](spark, sf_dir)
    assert best.columns == ["query_id", "rank", "vec_id", "score"] and best.filter("query_id = vec_id").count() == 0
    assert best.groupBy("query_id").count().filter("count = 20").count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 20 = 0").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_conversation_repair"])
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
