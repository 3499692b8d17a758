import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_joins import brute_lines, brute_near

import corpus_pipeline
from siftwell.llm import byte_bpe, mixing

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if name != "encoding":
            assert now.columns == docs.columns
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.99 * counts[0] and counts[-1] == counts[-2] > 0
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


CLASH = ("score", "rejected", "cross_entropy", "lang_pred", "_given", "doc", "row", "ids", "n_tokens", "decoded_sha256", "prob", "topic")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the small table with columns of the operators' names, nulls, a long text and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70)
    docs = docs.withColumns({c: F.concat(F.lit(f"mine {c} "), F.col("doc_id").cast("string")) for c in CLASH})
    row = docs.filter("doc_id = 3")
    cases = [row, row, row.withColumn("doc_id", F.lit(None).cast("long"))]
    for i, text in enumerate((None, "", "123 ...", "word " * 30000)):
        cases.append(row.withColumn("text", F.lit(text).cast("string")).withColumn("doc_id", F.lit(900 + i).cast("long")))
    cases.append(row.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(990).cast("long")))
    for case in cases:
        docs = docs.unionByName(case)
    return docs.cache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_equal_plain_python(spark, odd):
    """Each stage on the same odd rows: what it keeps and makes, by brute force; its columns pass untouched whatever their names."""
    given = odd.collect()
    texts = [r["text"] for r in given]

    def same_columns(rows, changed):
        for r in rows:
            assert all(r[c] == f"mine {c} {r['doc_id'] if r['doc_id'] is not None and r['doc_id'] < 900 else 3}" for c in CLASH if c not in changed)

    kept = corpus_pipeline.language(spark, odd, SF)
    assert kept.columns == odd.columns
    rows = kept.collect()
    same_columns(rows, ())
    assert not {900, 901, 902} & {r["doc_id"] for r in rows} and 990 in {r["doc_id"] for r in rows} and all(r["lang"] for r in rows)

    order = sorted(range(len(given)), key=lambda i: (given[i]["doc_id"] is None, given[i]["doc_id"] or 0))
    ranked = list(dict.fromkeys((given[i]["doc_id"], texts[i]) for i in order))
    gone = {g[:2] for g in brute_lines([t for _, t in ranked])}
    left = {}
    for i, (key, t) in enumerate(ranked):
        own = (t or "").split("\n")
        stay = [x for k, x in enumerate(own) if (i, k) not in gone]
        if len(stay) == len(own) or "".join(stay).strip():
            left[key, t] = t if len(stay) == len(own) else "\n".join(stay)
    got = corpus_pipeline.lines(spark, odd, SF).collect()
    same_columns(got, ())
    assert {(r["doc_id"], r["text"]) for r in got} == {(k, v) for (k, _), v in left.items()}

    near = brute_near([t for _, t in ranked])
    stays = {ranked[i][0] for i in range(len(ranked)) if i not in near or near[i][0] == i}
    got = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    same_columns(got, ())
    assert {r["doc_id"] for r in got} == stays and len(got) == len(stays)

    drawn = {r["doc_id"]: r["sampled"] for r in mixing.decisions(odd).collect()}
    got = corpus_pipeline.mix(spark, odd, SF).collect()
    same_columns(got, ())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in given if drawn[r["doc_id"]])

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.RankBpe.load(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    got = corpus_pipeline.encoding(spark, odd, SF).collect()
    same_columns(got, ("ids", "n_tokens", "decoded_sha256"))
    ids = {(r["doc_id"], r["decoded_sha256"]): (r["n_tokens"], bytes(r["ids"])) for r in got}
    assert len(got) == len(given)
    for r in given:
        want = library.encode_ordinary(r["text"] or "")
        assert ids[r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()] == (len(want), np.array(want, "<u4").tobytes())
