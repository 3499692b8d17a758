"""The given tables in the roles that the operators need.

Documents are chunks, benchmark passages are questions, and a document that holds a passage word for word is its gold. A
vector belongs to the document of the same number, and a question's vector is the one of its item number: an artificial
pairing, so both legs of a fused query see only documents that have a vector.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import retrieval
from siftwell.storage import staged

ANCHOR = 8
#: Characters of the anchor of a passage of one or two words.
GRAM = 8
#: Questions up to which their anchors and passages (about a kilobyte each) are broadcast.
BROADCAST_ITEMS = 20_000
#: Results (ids, ranks and scores) up to which they are broadcast to the documents.
BROADCAST_RESULTS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, vector): every benchmark passage; vector is null where there is none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(vectors, "query_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding) of the documents that have a vector."""
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return found.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def paired_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(own, "doc_id", "left_semi")


def bm25(spark: SparkSession, sf_dir: str, k: int = retrieval.POOL, paired: bool = False) -> DataFrame:
    docs = paired_docs(spark, sf_dir) if paired else table(spark, sf_dir, "documents")
    return retrieval.bm25(docs.select("doc_id", "text"), questions(spark, sf_dir).select("query_id", "text"), k)


def dense(spark: SparkSession, sf_dir: str, k: int = retrieval.POOL) -> DataFrame:
    """Nearest vectors other than the question's own."""
    asked = questions(spark, sf_dir).select("query_id", "vector").filter("vector is not null")
    found = retrieval.dense(vectors(spark, sf_dir), asked, k + 1)
    return retrieval.ranked(found.filter("doc_id <> query_id").drop("rank"), k)


def with_documents(spark: SparkSession, sf_dir: str, found: DataFrame, *columns: str) -> DataFrame:
    """``found`` (doc_id, ...) with ``columns`` of its documents.

    At most BROADCAST_RESULTS rows are broadcast, so that texts which no result needs stay where they are read; more are joined by shuffle.
    """
    docs, found = table(spark, sf_dir, "documents").select("doc_id", *columns), staged(found)
    few = found.limit(BROADCAST_RESULTS + 1).count() <= BROADCAST_RESULTS
    return docs.join(F.broadcast(found) if few else found, "doc_id")


def _wide(text: str) -> Column:
    """A text with two bytes a character (four for the rare ones beyond UTF-16's first plane): a slice takes constant time."""
    return F.encode(text, "UTF-16BE")


def _grams(text: str, sizes: list[int]) -> Column:
    """The distinct hashes of a text's runs of as many characters as each of ``sizes``."""
    none = F.array().cast("array<long>")

    def of(wide: Column, n: int) -> Column:
        last = (F.octet_length(wide) / 2).cast("int") - n
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.substring(wide, i * 2 + 1, F.lit(2 * n))))
        return F.when(last >= 0, F.array_distinct(each)).otherwise(none)

    # the outer transform binds the encoded text once
    return F.transform(F.array(_wide(text)), lambda wide: F.concat(*(of(wide, n) for n in sizes)))[0]


def _holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the ``docs`` that hold one of a bounded number of ``passages`` (query_id, passage), compared where texts are read.

    Every passage has a word that is not at its ends, so a text that holds it has that word; a text is searched for the
    passages whose rarest such word it has.
    """
    asked = passages.toArrow()
    ids, wanted = asked.column("query_id").combine_chunks(), [p.encode() for p in asked.column("passage").to_pylist()]
    inner = [set(re.split(rb"[ \t\n\r\x0b\x0c]+", p)[1:-1]) for p in wanted]
    often = Counter(w for ws in inner for w in ws)
    of_word = defaultdict(list)
    for i, ws in enumerate(inner):
        of_word[min(ws, key=lambda w: (often[w], -len(w), w))].append(i)
    anchors = frozenset(of_word)

    def run(batches):
        for batch in batches:
            texts = enumerate(batch.column("text").to_pylist())
            met = [(at, i) for at, text in texts if text for word in anchors.intersection(text.split()) for i in of_word[word] if wanted[i] in text]
            row, item = (pa.array([pair[j] for pair in met], pa.int64()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([ids.take(item), batch.column("doc_id").take(row)], names=["query_id", "doc_id"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((passages, "query_id"), (docs, "doc_id"))]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold a passage word for word.

    A passage's anchor is the run of up to ANCHOR words from its second on, without its last, which a text that holds the
    passage has as whole words. Anchors are a table of the questions: at most BROADCAST_ITEMS of them go to the texts, one word of
    each being enough there; more are joined by shuffle, with the texts fetched for the pairs that meet. Passages of
    one or two words need not stand as whole words: their anchor is what they start with, up to GRAM characters, and meets
    the runs of as many characters of a text. An empty passage is in every text; a null text or passage has no pairs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    words = lambda c: F.split(F.col(c), "[ \t\n\r\x0b\x0c]+")
    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    run = lambda hs, at, n: F.xxhash64(F.slice(hs, at, n))
    sized = items.withColumn("hs", hashed(words("passage"))).withColumn("n", F.least(F.lit(ANCHOR), F.size("hs") - 2))
    sizes = sorted(r["n"] for r in sized.select("n").distinct().collect())  # -1 to ANCHOR
    anchors = sized.filter("n > 0").select("query_id", "passage", run(F.col("hs"), F.lit(2), F.col("n")).alias("anchor"))
    split = docs.select("doc_id", "text", hashed(words("text")).alias("hs"))
    from_each = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("hs") - (n - 1), F.lit(1))), lambda i: run(F.col("hs"), i, F.lit(n)))
    starts = [from_each(n) for n in sizes if n > 0]
    held = F.col("text").contains(F.col("passage"))
    few = items.count() <= BROADCAST_ITEMS

    def met(runs: DataFrame, anchors: DataFrame) -> DataFrame:
        if few:
            return runs.join(F.broadcast(anchors), "anchor").filter(held)
        return runs.drop("text").join(anchors, "anchor").join(docs, "doc_id").filter(held)

    found = []
    if starts and few:
        found.append(_holding(docs, anchors.filter("passage is not null").select("query_id", "passage")))
    elif starts:
        found.append(met(split.select("doc_id", "text", F.explode(F.array_distinct(F.concat(*starts))).alias("anchor")), anchors))
    if sizes and sizes[0] <= 0:
        short = sized.filter("n <= 0 and passage <> ''").select("query_id", "passage", _wide("passage").alias("wide"))
        short = short.select("query_id", "passage", F.least(F.lit(GRAM), F.octet_length("wide") / 2).cast("int").alias("g"), "wide")
        grams = [r["g"] for r in short.select("g").distinct().collect()]  # at most GRAM
        if grams:
            short = short.select("query_id", "passage", F.xxhash64(F.substring("wide", F.lit(1), F.col("g") * 2)).alias("anchor"))
            found.append(met(docs.select("doc_id", "text", F.explode(_grams("text", sorted(grams))).alias("anchor")), short))
        found.append(docs.filter("text is not null").crossJoin(sized.filter("passage = ''")))  # every pair is a result
    each = [f.select("query_id", "doc_id") for f in found] or [items.join(docs, F.lit(False)).select("query_id", "doc_id")]
    return reduce(DataFrame.unionByName, each).distinct()
