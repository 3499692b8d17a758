import math

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.operators import evaluation, index, logs, retrieval
from siftwell.plans import catalog


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "theft of goods theft"), (2, "contract law"), (3, "law of contract and damages"), (4, ""), (5, None)], "doc_id long, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_by_hand(spark, docs):
    asked = spark.createDataFrame([(7, "theft theft"), (8, "unknown"), (9, "law")], "query_id long, text string")
    found = retrieval.bm25(docs, asked)
    average = (4 + 2 + 5) / 5
    theft = math.log((5 - 1 + 0.5) / 1.5 + 1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / average))
    got = rows(found, "query_id", "doc_id", "score")
    assert got[0] == (7, 1, pytest.approx(theft, abs=1e-6)) and [g[:2] for g in got[1:]] == [(9, 2), (9, 3)]


def test_fusion_by_hand(spark):
    words = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 3.0)], "query_id long, doc_id long, rank int, score double")
    vecs = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.5)], "query_id long, doc_id long, rank int, score double")
    got = rows(retrieval.rrf(words, vecs), "doc_id", "score")
    assert got == [(11, pytest.approx(0.3 / 62 + 0.7 / 61, abs=1e-9)), (12, pytest.approx(0.7 / 62, abs=1e-9)), (10, pytest.approx(0.3 / 61, abs=1e-9))]
    assert rows(retrieval.minmax(words, vecs), "doc_id", "score") == [(11, 0.7), (10, 0.3), (12, 0.0)]
    assert retrieval.gated(words, vecs, 0.95).count() == 0 and retrieval.gated(words, vecs, 0.9).count() == 2 and retrieval.gated(words, vecs, 0.0).count() == 2
    assert rows(retrieval.united(words, vecs), "doc_id", "rank") == [(10, 1), (11, 2), (12, 3)]


def test_dense_and_rerank(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<float>")
    assert rows(retrieval.dense(vectors, asked), "doc_id", "score") == [(2, 0.8), (1, 0.0)]
    pool = spark.createDataFrame([(1, 1, "law of", "law of nature"), (1, 2, "law of", "law"), (1, 3, "law of", "x")], "query_id long, doc_id long, query string, text string")
    assert rows(retrieval.rerank(pool, 5, authority=F.col("doc_id") == 2), "doc_id", "score") == [(1, 1.0), (2, 0.65)]


def test_metrics(spark):
    items = spark.createDataFrame([(1,), (2,)], "query_id long")
    gold = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "query_id long, doc_id long")
    results = spark.createDataFrame([(1, 4, 1), (1, 5, 2), (2, 1, 1)], "query_id long, doc_id long, rank int")
    per = {(r["query_id"], r["k"]): r for r in evaluation.per_query(items, evaluation.relevance(results, gold), gold, (1, 5)).collect()}
    assert per[1, 5]["rr"] == 0.5 and per[1, 5]["recall"] == 0.5 and per[1, 5]["precision"] == 0.2 and per[1, 1]["hit"] == 0
    assert per[1, 5]["ndcg"] == pytest.approx(1 / math.log2(3)) and per[1, 5]["ndcg_full"] == pytest.approx(1 / math.log2(3) / (1 + 1 / math.log2(3)))
    assert {r["k"]: r["hit"] for r in evaluation.means(evaluation.per_query(items, evaluation.relevance(results, gold), gold, (1, 5))).collect()} == {1: 0.0, 5: 0.5}
    cover = {r["query_id"]: (r["n_covered"], r["in_corpus"]) for r in evaluation.coverage(items, gold, spark.createDataFrame([(5,), (9,)], "doc_id long"), ["doc_id"]).collect()}
    assert cover == {1: (1, False), 2: (1, True)}
    expect = spark.createDataFrame([(1, False), (2, True), (3, None)], "query_id long, expect_refusal boolean")
    r = evaluation.refusals(expect, results.filter("query_id = 1")).first()
    assert (r["refusal_rate"], r["false_refusal_rate"]) == (1.0, 0.5)


def test_sweep_and_quantiles(spark):
    items = spark.createDataFrame([(1, False), (2, True)], "query_id long, expect_refusal boolean")
    judged = spark.createDataFrame([(1, 1, 0.9, 1.0), (1, 2, 0.2, 0.0), (2, 1, 0.4, 0.0)], "query_id long, rank int, score double, rel double")
    got = {r["threshold"]: (r["hit"], r["refusal_rate"], r["avg_kept"]) for r in evaluation.sweep(items, judged, [0.0, 0.5]).collect()}
    assert got == {0.0: (1.0, 0.0, 1.5), 0.5: (1.0, 1.0, 0.5)}
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10)], "v double")
    assert {r["share"]: r["value"] for r in evaluation.picked_quantiles(values, "v", [0.25, 0.5, 0.9]).collect()} == {0.25: 2.0, 0.5: 2.0, 0.9: 10.0}


def test_index_tables(spark, docs):
    assert {(r["doc_id"], r["term"]): r["tf"] for r in index.term_frequencies(docs).collect()}[1, "theft"] == 2
    assert index.corpus_stats(docs).first()["n"] == 5
    shuffled = docs.orderBy(F.desc("doc_id"))
    assert index.signature(docs).first() == index.signature(shuffled).first() != index.signature(docs.filter("doc_id < 3")).first()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "x long, source string")
    assert sorted(map(tuple, index.replace_by_source(old, spark.createDataFrame([(3, "a")], "x long, source string")).collect())) == [(2, "b"), (3, "a")]


def test_agent_scores_and_logs(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in evaluation.agent_score(F.lit("依据《x》[来源1]"), F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")).items()]).first()
    assert (row["tool_selection"], row["source_citation"], row["keyword_coverage"]) == (12.5, 12.5, 25.0) and row["structure"] == pytest.approx(25 / 3)
    ratings = spark.createDataFrame([("up", "rag"), ("up", "rag"), ("down", "chat")], "rating string, mode string")
    assert {r["mode"]: r["satisfaction"] for r in logs.feedback(ratings).collect()} == {None: pytest.approx(2 / 3), "rag": 1.0, "chat": 0.0}


def test_relevance_by_statute_and_article(spark):
    items = spark.createDataFrame(
        [(1, [("民法典", "第五百七十七条"), ("刑法", "二百六十四")]), (2, [("公司法", "第三条"), ("公司法", "无编号")]), (3, None)], "query_id long, relevant array<struct<law:string,article:string>>"
    )
    gold = evaluation.law_gold(items)
    assert sorted(map(tuple, gold.collect())) == [(1, "民法典", 577), (2, "公司法", 3)]
    results = spark.createDataFrame(
        [(1, 1, "中华人民共和国民法典", "第五百七十七条之一"), (1, 2, "《中华人民共和国民法典》", "578"), (1, 3, "刑法", "577"), (2, 1, None, "第三条"), (2, 2, "公司法", None), (3, 1, "公司法", "3")],
        "query_id long, rank int, law_title string, article_no string",
    )
    judged = evaluation.law_relevance(results, gold)
    assert {(r["query_id"], r["rank"]) for r in judged.collect() if r["rel"]} == {(1, 1)} and judged.count() == 6
    got = {(r["query_id"], r["k"]): (r["hit"], r["recall"]) for r in evaluation.per_query(items, judged, gold, (1, 3), ["law", "article"]).collect()}
    assert got == {(1, 1): (1.0, 1.0), (1, 3): (1.0, 1.0), (2, 1): (0.0, 0.0), (2, 3): (0.0, 0.0), (3, 1): (0.0, 0.0), (3, 3): (0.0, 0.0)}
    corpus = evaluation.chunk_keys(results)
    assert {r["query_id"]: r["in_corpus"] for r in evaluation.coverage(items, gold, corpus, ["law", "article"]).collect()} == {1: True, 2: True, 3: False}


def test_quantiles_and_systematic_sample_over_parts_of_the_range(spark, monkeypatch):
    rng = random.Random(3)
    numbers = [rng.choice([rng.random(), rng.random() ** 9, 0.5]) for _ in range(3000)]
    values = spark.createDataFrame([(x,) for x in [*numbers, None]], "v double")
    want = sorted(numbers)
    assert {r["share"]: r["value"] for r in evaluation.picked_quantiles(values, "v", [0.0, 0.3, 0.5, 0.999, 1.0]).collect()} == {s: want[min(int(3000 * s), 2999)] for s in (0.0, 0.3, 0.5, 0.999, 1.0)}
    assert evaluation.picked_quantiles(values.filter("v is null"), "v", [0.5]).count() == 0
    ids = spark.createDataFrame([(rng.randrange(10**9),) for _ in range(1000)], "id long")
    assert sorted(r["id"] for r in evaluation.systematic_sample(ids, "id", 7).collect()) == sorted(r["id"] for r in ids.collect())[::7]


def test_order_statistics_of_a_crowded_range(spark, monkeypatch):
    """All values but one lie in a billionth of the range: ranges are even all the same."""
    monkeypatch.setattr(evaluation, "BIN_ROWS", 100)
    rng = random.Random(4)
    numbers = [rng.random() for _ in range(2000)] + [1e9]
    values = spark.createDataFrame([(x, i) for i, x in enumerate(numbers)], "v double, i long")
    want = sorted(numbers)
    assert {r["share"]: r["value"] for r in evaluation.picked_quantiles(values, "v", [0.1, 0.5, 1.0]).collect()} == {s: want[min(int(2001 * s), 2000)] for s in (0.1, 0.5, 1.0)}
    assert sorted(r["v"] for r in evaluation.systematic_sample(values, "v", 9).collect()) == want[::9]
    sizes = [r["count"] for r in evaluation.in_ranges(values, "v").groupBy("bin").count().collect()]
    assert sum(sizes) == 2001 and max(sizes) <= 300
    same = spark.createDataFrame([(1.0, i) for i in range(2000)], "v double, i long")  # ties are spread by their other columns
    assert evaluation.systematic_sample(same, "v", 10).count() == 200
    assert max(r["count"] for r in evaluation.in_ranges(same.selectExpr("*", "xxhash64(v, i) AS t"), "v", "t").groupBy("bin").count().collect()) <= 300


def test_keywords_and_reports(spark):
    terms = spark.createDataFrame([("the", 0.1), ("theft", 3.0), ("law", 1.0)], "term string, idf double")
    asked = spark.createDataFrame([(1, "The theft, the law of the sea"), (2, "…")], "query_id long, text string")
    assert {r["query_id"]: r["keywords"] for r in index.keywords(asked, terms, 3).collect()} == {1: "of sea theft", 2: "…"}
    scored = spark.createDataFrame([(i, 25.0, 25.0, float(i), 10.0, 60.0 + i) for i in range(-5, 21)], "id long, tool_selection double, structure double, source_citation double, keyword_coverage double, total double")
    row = evaluation.agent_report(scored).first()
    assert (row["n"], row["poor"], row["fair"], row["excellent"], row["tool_selection_share"]) == (26, 0, 5, 1, 1.0)
    assert not row["passed"] and evaluation.agent_report(scored.filter("total >= 65")).first()["passed"] and not evaluation.agent_report(scored.limit(0)).first()["passed"]
    assert [r["id"] for r in evaluation.worst(scored, ["id"]).collect()] == [-5, -4, -3]
    rate = spark.createDataFrame([(10, 2.0)], "n long, per_minute double")
    progress = spark.createDataFrame([(30, 40), (10, 10)], "laws long, expected long")
    assert logs.remaining(progress, rate).first()["minutes_left"] == 5.0 and logs.remaining(progress, rate.selectExpr("1L n", "0D per_minute")).first()["minutes_left"] is None


def _scanned_where(plan: str, columns: tuple[str, ...]) -> list[str]:
    """The operators from the scan of ``columns`` up to the first join."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and all(f"{c}#" in line.split("]")[0] for c in columns))
    depth, above = len(re.match(r"[\s:+|-]*", lines[at])[0]), []
    for line in reversed(lines[:at]):
        if (d := len(re.match(r"[\s:+|-]*", line)[0])) < depth:
            depth = d
            above.append(line)
            if "Join" in line:
                break
    return above


@pytest.mark.parametrize("name, columns", [("context_assembly", ("source", "text")), ("rerank_boost_floor", ("source", "text")), ("refusal_rates", ("source", "text"))])
def test_texts_that_no_result_needs_are_not_shuffled(spark, tmp_path, name, columns):
    spark.createDataFrame([(i, f"word{i % 7} some text", "en", "src") for i in range(30)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word1 text"), (2, "none of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = catalog.QUERIES[name](spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert made.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = _scanned_where(plan, columns)
    assert "BroadcastHashJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_bm25_is_scored_where_documents_are_read(spark, monkeypatch):
    """No posting is shuffled; many small groups of scores, ties at the last rank, repeated keys and empty tables."""
    monkeypatch.setattr(retrieval, "SCORES", 12)
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(200)] + [(None, "w1 w2"), (900, None)]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "w1 W2 w3"), (2, "w5"), (3, "absent"), (4, None), (None, "w7 w7")], "query_id long, text string")
    key = lambda r: (str(r["query_id"]), r["rank"])
    found = retrieval.bm25(docs, queries, 5)
    assert "doc_id" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)
    got = sorted(map(tuple, found.select("query_id", "rank", "doc_id", "score").collect()), key=str)
    monkeypatch.setattr(retrieval, "BROADCAST_PAIRS", 0)
    assert got == sorted(map(tuple, retrieval.bm25(docs, queries, 5).select("query_id", "rank", "doc_id", "score").collect()), key=str) and len(got) == 15
    monkeypatch.setattr(retrieval, "BROADCAST_PAIRS", 500_000)
    twice = retrieval.bm25(docs.unionByName(docs.filter("doc_id = 5")), queries, None).collect()
    assert len({(r["query_id"], r["doc_id"]) for r in twice}) == len(twice)
    assert retrieval.bm25(docs.filter("false"), queries, 5).count() == 0 and retrieval.bm25(docs, queries.filter("false"), 5).count() == 0
