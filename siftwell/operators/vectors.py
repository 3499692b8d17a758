"""An inverted-file index of vectors: lists around centroids, stored apart, of which a query reads the nearest few.

Centroids come from k-means on a sample of bounded size. Each round assigns the sample where it lies and sums up vectors by
centroid within a task, so only sums are shuffled. Every vector is then assigned to its nearest centroid and stored in the
folder of its list; a search picks each query's nearest lists and opens only their folders.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators import blocks
from siftwell.operators.retrieval import PLACES, POOL, QUERIES, VECTORS, dense, ranked
from siftwell.storage import staged

VERSION = 1
#: Sampled vectors for each list, rounds of k-means, and bytes that all centroids may have (they are broadcast).
SAMPLE, ROUNDS, CENTROID_BYTES = 256, 10, 256 << 20
SLACK = 10.0**-PLACES
#: Queries at most, about, that say how many lists a recall needs.
CALIBRATION = 1000


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centroids of each row, the nearest first, ties by number."""
    far = (centres**2).sum(1) - 2 * (x @ centres.T)
    if n == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, 1, kind="stable")[:, :n]


def _sums(centres: np.ndarray):
    def run(batches):
        sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = blocks.matrix(batch.column(0))
            own = _nearest(x, centres)[:, 0]
            np.add.at(sums, own, x)
            counts += np.bincount(own, minlength=len(centres))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array([sums[i] for i in some], pa.list_(pa.float64()))], names=["list", "n", "total"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"list": rows["list"].iloc[:1], "n": [rows["n"].sum()], "total": [np.sum(np.stack(rows["total"].to_numpy()), 0)]})


def centroids(vectors: DataFrame, lists: int, rounds: int = ROUNDS, vector: str = "embedding", key: str = "doc_id") -> np.ndarray:
    """Up to ``lists`` centroids (lists x width) of at most about SAMPLE * lists vectors, chosen by a hash of the key.

    The first centroids are the sampled vectors with the least hashes. A centroid without vectors keeps its place. Raises
    where the centroids would have more than CENTROID_BYTES.
    """
    n = vectors.count()
    share = min(1.0, SAMPLE * lists / max(n, 1))
    order = F.xxhash64(F.lit("centroids"), key)
    slim = vectors.select(order.alias("h"), F.col(vector).cast("array<double>").alias("v")).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = staged(slim)
    first = sample.orderBy("h").limit(lists).select("v").toArrow()  # bounded by CENTROID_BYTES below
    centres = blocks.matrix(first["v"].combine_chunks()) if first.num_rows else np.zeros((0, 0))
    if centres.nbytes > CENTROID_BYTES:
        raise ValueError(f"{len(centres)} centroids of {centres.shape[1]} components exceed {CENTROID_BYTES} bytes")
    for _ in range(rounds if len(centres) else 0):
        parts = sample.select("v").mapInArrow(_sums(centres), "list long, n long, total array<double>")
        moved = parts.groupBy("list").applyInPandas(_added, "list long, n long, total array<double>").collect()  # a row for each list
        after = centres.copy()
        for r in moved:
            after[r["list"]] = np.array(r["total"]) / r["n"]
        if np.allclose(after, centres, atol=1e-9):
            break
        centres = after
    return centres


def _assigned(rows: DataFrame, vector: str, centres: np.ndarray, n: int = 1) -> DataFrame:
    """``rows`` with ``list`` and ``place``, once for each of the ``n`` nearest centroids of the vector, the nearest at place 1."""
    held = rows.sparkSession.sparkContext.broadcast(centres)
    at = rows.columns.index(vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            x = blocks.matrix(batch.column(at))
            x = np.pad(x, ((0, 0), (0, max(0, held.value.shape[1] - x.shape[1]))))[:, : held.value.shape[1]]
            own = _nearest(x, held.value, n)
            taken = batch.take(pa.array(np.repeat(np.arange(len(x)), own.shape[1])))
            place = np.tile(np.arange(1, own.shape[1] + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own.ravel().astype(np.int32)), pa.array(place)], names=[*batch.schema.names, "list", "place"])

    return rows.mapInArrow(run, f"{kinds}, list int, place int")


def write(vectors: DataFrame, path: str, lists: int | None = None, vector: str = "embedding", key: str = "doc_id") -> None:
    """Store every row with a key and a vector in the folder of its list; by default there are about 4 * sqrt(n) lists.

    Large lists are dealt to several files by a hash of the key. The centroids come last: without them there is no index.
    """
    some = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = some.count()
    width = some.agg(F.max(F.size("v"))).first()[0] or 0
    most = max(1, CENTROID_BYTES // max(8 * width, 8))
    centres = centroids(some, min(lists or max(1, 4 * isqrt(n)), most), vector="v", key="id")
    dealt = _assigned(some, "v", centres).drop("place") if len(centres) else some.withColumn("list", F.lit(0))
    dealt.repartitionByRange("list", F.xxhash64("id")).write.partitionBy("list").parquet(f"{path}/lists")
    told = [(VERSION, n, some.schema["id"].dataType.simpleString(), i, c.tolist()) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(told or [(VERSION, n, some.schema["id"].dataType.simpleString(), None, None)], "version int, n long, key string, list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")


class Stored:
    """A vector index at ``path``; ``ValueError`` for another version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # bounded by CENTROID_BYTES
        if not rows or rows[0]["version"] != VERSION:
            raise ValueError(f"{path} holds no vector index of version {VERSION}")
        self.n, self.key = rows[0]["n"], rows[0]["key"]
        self.centres = np.array([r["centre"] for r in rows if r["centre"]])

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(id, v, list, place) of ``queries`` (query_id, vector): the ``n`` nearest lists of each that has a vector."""
        asked = queries.filter("vector is not null").select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v"))
        return _assigned(asked, "v", self.centres, min(n, len(self.centres)))

    def rows(self, lists: list[int]) -> DataFrame:
        """(id, v, list) of some lists; no other folder is opened."""
        stored = self.spark.read.schema(f"id {self.key}, v array<double>, list int").parquet(f"{self.path}/lists")
        return stored.filter(F.col("list").isin(lists))

    def curve(self, queries: DataFrame, k: int = POOL) -> DataFrame:
        """(probes, recall): the share of the exact top ``k`` of ``queries`` that lies in as many nearest lists.

        The queries are compared with all vectors, so they should be a sample; every number of lists is read off one pass, as
        a neighbour is found by the number of probes at which its list stands.
        """
        every = self.rows(list(range(len(self.centres))))
        asked = queries.filter("vector is not null")
        exact = dense(every, asked, k, "id", "v").select("query_id", "id")
        order = self.probes(asked, len(self.centres)).select(F.col("id").alias("query_id"), "list", "place")
        at = exact.join(every.select("id", "list"), "id").join(order, ["query_id", "list"]).groupBy(F.col("place").alias("probes")).agg(F.count("*").alias("n"))
        upto = Window.orderBy("probes")  # a row for each list at most
        whole = Window.partitionBy(F.lit(0))
        return at.select("probes", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("recall"))

    def probes_for(self, queries: DataFrame, recall: float, k: int = POOL, sample: int = CALIBRATION) -> int:
        """The least number of probes that finds ``recall`` of the exact top ``k`` of at most about ``sample`` of the queries."""
        share = min(1.0, sample / max(queries.count(), 1))
        some = queries.filter(F.pmod(F.xxhash64(F.lit("curve"), "query_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        found = self.curve(some, k).filter(F.col("recall") >= recall - 1e-12).agg(F.min("probes")).first()[0]
        return found or max(1, len(self.centres))

    def search(self, queries: DataFrame, k: int = POOL, probes: int = 16, key: str = "doc_id") -> DataFrame:
        """Top ``k`` by inner product among the vectors of each query's nearest ``probes`` lists: (query_id, key, score, rank).

        Lists of many vectors or queries are dealt to blocks, and blocks meet within their list. With all lists probed the
        result is that of ``retrieval.dense``.
        """
        if not len(self.centres):
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {self.key}, score double, rank int")
        asked = staged(self.probes(queries, probes))
        found = [r["list"] for r in asked.select("list").distinct().collect()]  # at most the lists
        some = self.rows(found)
        sized = some.groupBy("list").agg(F.count("*").alias("n"))
        wanted = asked.groupBy("list").agg(F.count("*").alias("m"))
        both = F.broadcast(staged(sized.join(wanted, "list").select("list", F.ceil(F.col("n") / VECTORS).alias("shards"), F.ceil(F.col("m") / QUERIES).alias("blocks"))))  # a row for each list
        deal = lambda df, own, other: df.join(both, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col(own)).alias(own[:-1]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[:-1]))
        scored = blocks.met(deal(some, "shards", "blocks"), deal(asked, "blocks", "shards"), ["list", "shard", "block"], k, SLACK)
        return ranked(scored.withColumnRenamed("key", key), k, key)
