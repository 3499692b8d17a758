"""Batch retrieval: all queries of a table at once by BM25, vectors, or both fused; floors, boosts and re-scoring.

Results are rows (query_id, rank, key, score); ties go to the smaller key. Retrievers are functions of a query table, so
decorators (rewriting, re-ranking, gating) are functions of such functions' results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import K1, B, bm25_term, boosted, idf, similarity
from siftwell.functions.text import faceted as augmented
from siftwell.functions.text import hyde_query, tokens
from siftwell.operators import blocks, index
from siftwell.operators.joins import salted, with_key_columns
from siftwell.storage import staged

RRF_K, ALPHA, POOL = 60, 0.3, 20
#: Scores are compared at this many decimals, so that engines and runs agree on ranks.
PLACES = 6
#: Pairs of query and term up to which they are broadcast.
BROADCAST_PAIRS = 500_000
#: Scores of documents and queries that a task makes together.
SCORES = 1 << 21
#: Vectors and queries of a block, and blocks of vectors at least (for few vectors and many cores).
VECTORS, QUERIES, SPREAD = 2000, 1000, 16


def ranked(scores: DataFrame, k: int | None, key: str = "doc_id", places: int = PLACES) -> DataFrame:
    """``scores`` (query_id, key, score, ...) with the score rounded and ``rank``, the best ``k`` of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    found = scores.withColumn("score", F.round("score", places)).withColumn("rank", F.row_number().over(order))
    return found if k is None else found.filter(F.col("rank") <= k)


def _counted(docs: DataFrame, terms: pa.Array, key: str) -> DataFrame:
    """(key, length, terms, tf) of every document of ``docs`` (key, text): its tokens, the places of its tokens in ``terms`` and their counts.

    A document is counted where it is read, so no posting is shuffled.
    """

    def run(batches):
        for batch in batches:
            every = batch.column("all")
            length = pc.list_value_length(every).to_numpy()
            found = pc.index_in(every.flatten(), value_set=terms)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)[known]
            pairs, tf = np.unique(row * len(terms) + found.fill_null(0).to_numpy()[known], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(length) + 1) * len(terms)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(length.astype(np.int64)), *lists], names=[key, "length", "terms", "tf"])

    split = docs.select(F.col(key), tokens(F.col("text")).alias("all"))
    return split.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, length long, terms array<int>, tf array<int>")


def _scored(counted: DataFrame, pairs: pa.Table, kind: str, terms: pa.Array, k: int | None, key: str) -> DataFrame:
    """(query_id, key, score) of ``counted`` for the pairs of query and term; of a task only what its best ``k`` of a query need.

    A score within rounding of the k-th is kept, so that rounding cannot change which are the best.
    """
    told = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    n, average = told["n"], told["average"] or 1.0
    df = np.zeros(len(terms))
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most as many as the pairs
        df[row["t"]] = row["count"]
    weight = np.log((n - df + 0.5) / (df + 0.5) + 1)
    asked = pairs.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    of_term = pc.index_in(pairs.column("term").combine_chunks(), value_set=terms).to_numpy()
    order = np.argsort(of_term, kind="stable")
    query, ids = asked.indices.to_numpy()[order].astype(np.int64), asked.dictionary
    first = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    some = max(1, SCORES // max(1, len(ids)))

    def run(batches):
        floor = np.full(len(ids), -np.inf)
        for batch in (whole.slice(at, some) for whole in batches for at in range(0, whole.num_rows, some)):
            size = pc.list_value_length(batch.column("terms")).to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            w = weight[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * batch.column("length").to_numpy()[row] / average)))
            times = first[term + 1] - first[term]
            each = np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
            score = np.bincount(np.repeat(row, times) * len(ids) + query[each], np.repeat(w, times), len(size) * len(ids)).astype(float).reshape(len(size), len(ids))
            if k and len(size) >= k:
                floor = np.maximum(floor, np.partition(score, -k, 0)[-k])
            at, who = np.nonzero((score > 0) & (score >= floor - 10.0**-PLACES))  # every weight is positive
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), batch.column(key).take(pa.array(at)), pa.array(score[at, who])], names=["query_id", key, "score"])

    return counted.mapInArrow(run, f"query_id {kind}, `{key}` {counted.schema[key].dataType.simpleString()}, score double")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = POOL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 top ``k`` of ``docs`` for ``queries`` (query_id, text); query terms count once, only documents with one appear.

    Only the queries' terms are counted in the documents. With at most BROADCAST_PAIRS pairs of query and term, documents are
    counted and scored where they are read, and a task's best ``k`` of each query are all that is shuffled. Where a key has
    several documents their counts are put together by shuffle. More pairs meet the postings under salted keys, so that
    neither a term of all documents nor one of all queries gathers in a task.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    few = wanted.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    if few:
        pairs = wanted.toArrow()
        terms = pairs.column("term").combine_chunks().unique()
        counted = staged(_counted(docs.select(F.col(key), F.col(text).alias("text")), terms, key))
        if counted.groupBy(key).count().filter("count > 1").isEmpty():
            return ranked(_scored(counted, pairs, wanted.schema["query_id"].dataType.simpleString(), terms, k, key), k, key)
    else:
        wanted = staged(wanted)
    tf, stats = index.frequencies_of(docs.select(F.col(key), F.col(text).alias("text")), wanted.select("term").distinct(), key)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if few:
        asked = wanted.groupBy("term").agg(F.collect_list("query_id").alias("asked"))
        met = tf.join(F.broadcast(df.join(asked, "term")), "term").withColumn("query_id", F.explode("asked"))
    else:
        df = staged(df.join(wanted.groupBy("term").agg(F.count("*").alias("queries")), "term"))
        counted = with_key_columns(tf, df.select("term", "df"), "term", "df", tf.count())
        asked = with_key_columns(wanted, df, "term", "queries", wanted.count()).drop("queries")
        met = salted(counted, asked, "term", "df", key)
    weight = idf(F.col("n"), F.col("df")) * bm25_term(F.col("tf"), F.col("length"), F.col("average"))
    weighed = met.crossJoin(F.broadcast(stats)).select("query_id", key, weight.alias("w"))  # one row of statistics
    return ranked(weighed.groupBy("query_id", key).agg(F.sum("w").alias("score")), k, key)


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = POOL, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Exact top ``k`` by inner product for ``queries`` (query_id, vector); rows without a vector have no part.

    Both sides are dealt to blocks, whose numbers follow from the counts, and each two blocks meet under a key of their own:
    no side is broadcast or gathered whole, and a meeting is one matrix product, of which each query's best ``k`` leave the
    task.
    """
    vectors, queries = vectors.filter(F.col(vector).isNotNull()), queries.filter("vector is not null")
    shards, groups = max(SPREAD, -(-vectors.count() // VECTORS)), max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), dealt(key, shards).alias("shard"), every(groups).alias("block"))
    right = queries.select(F.col("query_id").alias("id"), F.col("vector").alias("v"), dealt("query_id", groups).alias("block"), every(shards).alias("shard"))
    return ranked(blocks.met(left, right, ["shard", "block"], k, 10.0**-PLACES).withColumnRenamed("key", key), k, key)


def rrf(words: DataFrame, vectors: DataFrame, alpha: float = ALPHA, n: int | None = POOL, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked results: alpha / (60 + rank) and (1 - alpha) / (60 + rank), summed."""
    leg = lambda df, weight: df.select("query_id", key, (F.lit(weight) / (RRF_K + F.col("rank"))).alias("score"))
    both = leg(words, alpha).unionByName(leg(vectors, 1 - alpha))
    return ranked(both.groupBy("query_id", key).agg(F.sum("score").alias("score")), n, key, 9)


def minmax(words: DataFrame, vectors: DataFrame, alpha: float = ALPHA, n: int | None = POOL, key: str = "doc_id") -> DataFrame:
    """Fusion of scores scaled to 0..1 within each query and leg; ``vectors`` has inner products of unit vectors, whose
    distance 2 - 2 * score becomes 1 / (1 + distance)."""
    per = Window.partitionBy("query_id")

    def leg(df: DataFrame, value: Column, weight: float) -> DataFrame:
        low, high = F.min("s").over(per), F.max("s").over(per)
        span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
        return df.withColumn("s", value).select("query_id", key, (F.lit(weight) * (F.col("s") - low) / span).alias("score"))

    both = leg(words, F.col("score"), alpha).unionByName(leg(vectors, 1 / (1 + (2 - 2 * F.col("score"))), 1 - alpha))
    return ranked(both.groupBy("query_id", key).agg(F.sum("score").alias("score")), n, key)


def gated(results: DataFrame, vectors: DataFrame, floor: float, space: str = "l2") -> DataFrame:
    """``results`` of the queries whose best vector similarity reaches ``floor``; a floor of 0 or less gates nothing.

    ``vectors``: ranked inner products of unit vectors. Queries without any vector result pass, as there is no evidence.
    """
    if floor <= 0:
        return results
    distance = (2 - 2 * F.col("score")) if space == "l2" else 1 - F.col("score")
    best = vectors.groupBy("query_id").agg(F.max(similarity(distance, space)).alias("best"))
    return results.join(best.filter(F.col("best") < floor).select("query_id"), "query_id", "left_anti")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 10, pool: int = POOL, alpha: float = ALPHA, fusion: str = "rrf", mode: str = "hybrid", floor: float = 0.0) -> DataFrame:
    """Both legs, fused, gated and cut to ``n``; ``queries`` has query_id, text and vector. mode: hybrid, bm25 or semantic."""
    if mode == "bm25":
        return bm25(docs, queries, n)
    semantic = dense(vectors, queries, n if mode == "semantic" else pool)
    if mode == "semantic":
        return gated(semantic, semantic, floor)
    fuse = {"rrf": rrf, "minmax": minmax}[fusion]
    return gated(fuse(bm25(docs, queries, pool), semantic, alpha, n), semantic, floor)


def lexical_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder's probability: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, n: int, score: Callable[[Column, Column], Column] = lexical_overlap, authority: Column | None = None, floor: float = 0.5, key: str = "doc_id") -> DataFrame:
    """``candidates`` (query_id, key, query, text, ...) scored anew, boosted where ``authority`` holds, at least ``floor``, best ``n``.

    ``score`` takes the two text columns, so a model comes in as a pandas UDF.
    """
    p = score(F.col("query"), F.col("text"))
    value = boosted(p, authority) if authority is not None else p
    scored = candidates.select("query_id", key, F.round(value, PLACES).alias("score")).filter(F.col("score") >= floor)
    return ranked(scored, n, key)


def rewritten(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """``queries`` with the passage that a rewrite table (question, passage) has for their text appended to it."""
    some = rewrites.filter(F.coalesce(F.col("passage"), F.lit("")) != "").groupBy("question").agg(F.min("passage").alias("_passage"))
    joined = queries.join(some, queries["text"] == some["question"], "left")
    return joined.withColumn("text", hyde_query(F.col("text"), F.coalesce("_passage", F.lit("")))).drop("question", "_passage")


#: What each facet adds to a query.
FACETS = {"search": "", "sources": "法律规定 条文 适用 依据 相关法规", "mistakes": "常见误区 法律风险 责任 举证 时效 注意事项"}


def faceted(find: Callable[[DataFrame], DataFrame], queries: DataFrame, n: int = 8, key: str = "doc_id") -> DataFrame:
    """(query_id, facet, rank, key, score): the best ``n`` of a retriever for each query in each facet's wording."""
    asked = [(name, queries.withColumn("text", augmented(F.col("text"), extra) if extra else F.col("text"))) for name, extra in FACETS.items()]
    found = [find(q).filter(F.col("rank") <= n).select("query_id", F.lit(name).alias("facet"), "rank", key, "score") for name, q in asked]
    return reduce(DataFrame.unionByName, found)


def united(*results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results one after the other, each document of a query once at its first place."""
    parts = [df.select("query_id", key, "rank", F.lit(i).alias("leg")) for i, df in enumerate(results)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = every.groupBy("query_id", key).agg(F.min(F.struct("leg", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", key, F.row_number().over(order).alias("rank"))


def retriever(docs: DataFrame, vectors: DataFrame, rewrites: DataFrame | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """The one builder of a retriever: rewriting where a rewrite table is given, then ``hybrid`` with ``options``."""
    return lambda queries: hybrid(docs, vectors, rewritten(queries, rewrites) if rewrites is not None else queries, **options)
