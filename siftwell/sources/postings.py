"""A stored inverted index for batches of BM25 queries that reads only the queries' terms and skips what cannot win.

Documents are dealt to slabs of about SLAB_DOCS by a hash of their key. A row of the index is a block: the postings of a
term in a slab, with the largest weight among them. Blocks are sorted by term and slab within folders by a hash of the
term, so a batch opens the folders of its terms, and the row groups in them by the term's range; a term that every
document has is spread over its slabs.

A search first bounds each query's score in each slab from the blocks' largest weights, which it reads without the
postings. It scores the most promising slabs; their k-th score is the query's floor. Slabs whose bound stays below it are
not read, and in the others a query's terms are taken by their bounds: once the rest together cannot reach the floor, it is
only looked up for documents that it can still lift there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import K1, B, bm25_term, idf
from siftwell.functions.text import tokens
from siftwell.operators.retrieval import PLACES, POOL, ranked
from siftwell.storage import discard, staged

VERSION = 1
SLAB_DOCS = 1024
#: Postings of a folder on average, and folders at most.
FOLDER_POSTINGS, FOLDERS = 2_000_000, 4096
#: Slabs that give a query its floor, pairs of query and term up to which they are broadcast, and queries that meet a slab together.
FIRST_SLABS, BROADCAST_PAIRS, QUERIES = 2, 200_000, 1000
#: More than the rounding of scores can change.
SLACK = 10.0**-PLACES * 10


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slab_docs: int = SLAB_DOCS) -> None:
    """Write the blocks, the terms and, last, a row that tells that the index is whole; texts are split to words once.

    Rows with equal key and number of words are one document. Null and empty texts count as documents without words.
    """
    slabs = max(1, -(-docs.count() // slab_docs))
    slab = F.pmod(F.xxhash64("key"), F.lit(slabs)).cast("int").alias("slab")
    split = docs.select(F.col(key).alias("key"), tokens(F.coalesce(text, F.lit(""))).alias("all"))
    # a row without a term for each document carries its length through the one shuffle
    each = split.select("key", F.size("all").alias("length"), F.explode(F.concat("all", F.array(F.lit(None).cast("string")))).alias("term"))
    counted = staged(each.groupBy("key", "length", "term").agg(F.count("*").alias("tf")).select("key", "length", "term", "tf", slab), f"{path}/counted")
    of = counted.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("tf") * F.col("length")) / F.sum("tf"), F.lit(0.0)).alias("average")).first()
    counted = counted.filter("term is not null")
    folders = max(8, min(FOLDERS, counted.count() // FOLDER_POSTINGS))
    weight = bm25_term(F.col("tf"), F.col("length"), F.lit(of["average"]))
    named = counted.withColumn("folder", _folder(F.col("term"), folders))
    posting = F.array_sort(F.collect_list(F.struct("key", "tf", "length")))
    order = ["folder", "term", "slab"]
    blocks = named.repartitionByRange(*order).groupBy(*order).agg(F.max(weight).alias("top"), posting.alias("postings"))
    blocks.sortWithinPartitions(*order).write.partitionBy("folder").parquet(f"{path}/blocks")
    terms = named.groupBy("folder", "term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(of["n"]), F.col("df")))
    terms.repartitionByRange("folder", "term").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/terms")
    discard(docs.sparkSession, f"{path}/counted")
    told = docs.sparkSession.range(1).select(F.lit(VERSION).alias("version"), F.lit(of["n"]).alias("n"), F.lit(of["average"]).alias("average"), F.lit(folders).alias("folders"), F.lit(slabs).alias("slabs"), F.lit(counted.schema["key"].dataType.simpleString()).alias("key"))
    told.write.parquet(f"{path}/whole")


class Stored:
    """An index at ``path``, read when it is asked; ``ValueError`` for another version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.told = spark.read.parquet(f"{path}/whole").first()
        if self.told is None or self.told["version"] != VERSION:
            raise ValueError(f"{path} holds no index of version {VERSION}")

    def _table(self, name: str, folders: list[int]) -> DataFrame:
        columns = {"terms": "df long, idf double", "blocks": f"slab int, top double, postings array<struct<key:{self.told['key']},tf:long,length:int>>"}[name]
        return self.spark.read.schema(f"term string, {columns}, folder int").parquet(f"{self.path}/{name}").filter(F.col("folder").isin(folders))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, folder, term) of ``queries`` (query_id, text), each term of a query once."""
        each = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return each.withColumn("folder", _folder(F.col("term"), self.told["folders"]))

    def folders(self, asked: DataFrame) -> list[int]:
        """The folders that hold the terms of ``asked``: at most FOLDERS numbers."""
        return sorted(r["folder"] for r in asked.select("folder").distinct().collect())

    def search(self, queries: DataFrame, k: int = POOL, key: str = "doc_id") -> DataFrame:
        """BM25 top ``k``, as ``retrieval.bm25`` over the texts that the index was made from: (query_id, key, score, rank)."""
        wanted = staged(self.asked(queries))
        found = self.folders(wanted)
        small = F.broadcast if wanted.count() <= BROADCAST_PAIRS else lambda df: df
        wanted = staged(self._table("terms", found).join(small(wanted), ["folder", "term"]).select("query_id", "folder", "term", "idf"))
        blocks = self._table("blocks", found)
        bounds = blocks.select("folder", "term", "slab", "top").join(small(wanted), ["folder", "term"])
        bounds = staged(bounds.select("query_id", "slab", "folder", "term", "idf", (F.col("idf") * F.col("top")).alias("most")))
        small = F.broadcast if bounds.count() <= BROADCAST_PAIRS else lambda df: df
        meetings = bounds.groupBy("query_id", "slab").agg(F.sum("most").alias("most"))
        # the first floor of each query: its k-th score in the slabs with the largest bounds
        order = Window.partitionBy("query_id").orderBy(F.desc("most"), "slab")
        meetings = staged(meetings.withColumn("n", F.row_number().over(order)))
        early = staged(self._scored(blocks, bounds.join(meetings.filter(F.col("n") <= FIRST_SLABS).select("query_id", "slab"), ["query_id", "slab"]).withColumn("floor", F.lit(0.0)), k, small))
        floors = ranked(early, k, "key").filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))
        left = meetings.filter(F.col("n") > FIRST_SLABS).join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        late = self._scored(blocks, bounds.join(left.filter("most >= floor").select("query_id", "slab", "floor"), ["query_id", "slab"]), k, small)
        return ranked(early.unionByName(late).withColumnRenamed("key", key), k, key)

    def _scored(self, blocks: DataFrame, pairs: DataFrame, k: int, small) -> DataFrame:
        """(query_id, key, score): the best ``k`` of each query in each slab, given (query_id, slab, folder, term, idf, most, floor).

        Queries meet the blocks of their terms by slab, in groups of about QUERIES.
        """
        groups = max(1, -(-pairs.select("query_id").distinct().count() // QUERIES))
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        needed = dealt.select("part", "slab", "folder", "term").distinct()
        held = blocks.join(small(needed), ["folder", "term", "slab"]).groupBy("part", "slab").agg(F.collect_list(F.struct("term", "postings")).alias("lists"))
        each = dealt.groupBy("part", "slab", "query_id", "floor").agg(F.collect_list(F.struct("term", "idf", "most")).alias("terms"))
        asking = each.groupBy("part", "slab").agg(F.collect_list(F.struct("query_id", "floor", "terms")).alias("queries"))
        kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
        of = blocks.schema["postings"].dataType.elementType["key"].dataType.simpleString()
        return held.join(asking, ["part", "slab"]).select("lists", "queries").mapInArrow(_slabs(self.told["average"], k), f"query_id {kinds['query_id']}, key {of}, score double")


def _slabs(average: float, k: int):
    def run(batches):
        for batch in batches:
            for lists, queries in zip(batch.column(0), batch.column(1), strict=True):
                postings = lists.values.field("postings")
                flat = postings.flatten()
                keys = flat.field("key").dictionary_encode()
                at, tf, length = keys.indices.to_numpy(), flat.field("tf").to_numpy().astype(float), flat.field("length").to_numpy()
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (average or 1.0)))
                ends = np.cumsum(postings.value_lengths().to_numpy())
                place = dict(zip(lists.values.field("term").to_pylist(), zip(ends - postings.value_lengths().to_numpy(), ends, strict=True), strict=True))
                ids, rows, scores = [], [], []
                for i, (floor, terms) in enumerate(zip(queries.values.field("floor").to_pylist(), queries.values.field("terms").to_pylist(), strict=True)):
                    score, found = _best(terms, place, at, weight, len(keys.dictionary), floor, k)
                    ids.append(np.full(len(found), i))
                    rows.append(found)
                    scores.append(score[found])
                asked = queries.values.field("query_id").take(pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([asked, keys.dictionary.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], names=["query_id", "key", "score"])

    return run


def _best(terms: list[dict], place: dict, at: np.ndarray, weight: np.ndarray, n: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a slab's documents and those among the best ``k`` (more on near ties) that reach the floor.

    Terms are taken by their bounds. Once what is left cannot lift a new document to the floor, only documents that still can
    reach it stay in play, and only these are looked up in the remaining terms.
    """
    terms = sorted(terms, key=lambda t: -t["most"])
    rest = sum(t["most"] for t in terms)
    score, touched, alive = np.zeros(n), np.zeros(n, bool), None
    for term in terms:
        first, end = place[term["term"]]
        docs, gain = at[first:end], term["idf"] * weight[first:end]
        if alive is None and rest < floor:
            alive = touched & (score + rest >= floor)
        elif alive is not None:
            alive &= score + rest >= floor
        if alive is not None:
            if not alive.any():
                break
            some = alive[docs]
            docs, gain = docs[some], gain[some]
        score[docs] += gain
        touched[docs] = True
        rest -= term["most"]
    found = np.flatnonzero((touched if alive is None else alive) & (score >= floor))
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], -k)[-k] - SLACK]
    return score, found
