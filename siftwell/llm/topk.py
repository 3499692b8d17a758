"""Exact top-k inner-product search by MaxScore over shards of integer vectors.

A dimension is a term; the impact of a document in a term is q * x minus the least such value in the shard, so impacts are
not negative and a score is a constant of the query plus the sum of its impacts. For each query the terms whose impacts
even together cannot lift a document above the current k-th score are non-essential: the postings of the others are
traversed, and the rest are probed only while a document can still compete. Vectors are dense, so a term's postings are
its values for all documents of the shard. The shards' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import staged

#: Documents that are searched together, and queries in a block at least.
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Shards and blocks beyond which they grow instead of becoming more, up to GROWN times as long and GROWN_BYTES of components.
SPREAD, GROWN, GROWN_BYTES = 8, 16, 1 << 23
#: Terms probed together between two checks of the bounds.
PROBE = 8
#: Queries whose scores in a part of a shard are made together.
TOGETHER = 64
LONG = (1 << 63) - 1
#: Partitions over which the meetings of shards and blocks are spread at most.
MEETINGS = 10_000


def quantised(rows: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(key, v array<long>) with floor(scale * x) of every component x as double, no further from 0 than a long can be.

    Rows whose vector is null or holds a null, NaN or infinite component are left out, as are rows with a null key.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return slim.filter(F.col("key").isNotNull() & F.col("v").isNotNull() & finite).select("key", F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-9.2e18)), F.lit(9.2e18)))).alias("v"))


class Shard:
    """Vectors of one shard: for each term its postings over all documents, and their least and largest value."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        self.keys = keys
        self.x = np.ascontiguousarray(vectors.T)
        self.low, self.high = self.x.min(1), self.x.max(1)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the k best documents at least of each of some queries, other than its own key; none need score below ``floor``."""
        terms, n = self.x.shape
        ends = np.stack([q * self.low, q * self.high])
        base = ends.min(0)
        bound = ends.max(0) - base  # the largest impact of each term
        order = np.argsort(-bound, axis=1, kind="stable")
        strongest = np.take_along_axis(bound, order, 1)
        rest = np.pad(np.cumsum(strongest[:, ::-1], 1)[:, ::-1], ((0, 0), (0, 1)))  # what the terms from the i-th on can add
        # the first threshold: the k-th of the documents that lead in the terms with the largest impacts
        theta = np.array(floor, np.float64)
        new = np.flatnonzero(np.isneginf(floor))
        lead = np.zeros_like(q[new])
        np.put_along_axis(lead, order[new, :PROBE], np.take_along_axis(q[new], order[new, :PROBE], 1), 1)
        seeds = np.argpartition(-(lead @ self.x), 4 * k, 1)[:, : 4 * k] if n > 4 * k else np.tile(np.arange(n), (len(new), 1))
        for i, some in zip(new, seeds, strict=True):
            exact = (q[i] @ self.x[:, some])[self.keys[some] != own[i]]
            if len(exact) >= k:
                theta[i] = np.partition(exact, -k)[-k]
        # without an impact in the essential terms a document stays below the threshold; of dense vectors few are left
        # only when all but the weakest are traversed, which one product does
        essential = np.minimum(terms, np.maximum((base.sum(1)[:, None] + rest >= theta[:, None]).sum(1), terms - PROBE))
        traversed = np.zeros(q.shape, bool)
        np.put_along_axis(traversed, order, np.arange(terms) < essential[:, None], 1)
        given = np.where(traversed, 0, base).sum(1)
        score = np.where(traversed, q, 0) @ self.x
        at, rows = np.nonzero(score >= (theta - rest[np.arange(len(q)), essential] - given)[:, None].astype(score.dtype))
        score, done = score[at, rows] + given[at], essential[at]
        while len(at) and done.min() < terms:
            ahead = done[:, None] + np.arange(PROBE)
            probe = order[at[:, None], np.minimum(ahead, terms - 1)]
            impact = q[at[:, None], probe] * self.x[probe, rows[:, None]] - base[at[:, None], probe]
            score, done = score + np.where(ahead < terms, impact, 0).sum(1), np.minimum(done + PROBE, terms)
            alive = score + rest[at, done] >= theta[at]
            at, rows, score, done = at[alive], rows[alive], score[alive], done[alive]
        other = self.keys[rows] != own[at]
        return at[other], rows[other], score[other].astype(np.int64)


def parts(rows: int, least: int, width: int, size: int) -> int:
    """Into how many shards or blocks ``rows`` are dealt: SPREAD of ``least`` rows at most, then as few as what a task may hold allows."""
    most = max(least, min(least * GROWN, GROWN_BYTES // max(1, width * size)))
    return max(1, -(-rows // most), min(SPREAD, -(-rows // least)))


def compact(*tables: DataFrame) -> tuple[list[DataFrame], int, int]:
    """The tables with the components of ``v`` in the shortest integers that hold all of them, the greatest width and the bytes of a component."""
    told = [t.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first() for t in tables]
    most, width = (max(row[name] or 0 for row in told) for name in ("most", "width"))
    kind, size = next((kind, size) for kind, size in (("tinyint", 1), ("smallint", 2), ("int", 4), ("long", 8)) if most < 1 << 8 * size - 1)
    return [t.withColumn("v", F.col("v").cast(f"array<{kind}>")) for t in tables], width, size


def meetings(left: DataFrame, right: DataFrame, place: Column, shards: int, blocks: int, run, schema: str) -> DataFrame:
    """What ``run`` makes of each shard of ``left`` and block of ``right``, two Arrow tables whose rows are dealt by the hash ``place``.

    Both sides are repeated for their meetings and shuffled, so no side is gathered or broadcast, whatever its size is thought to be.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(place, F.lit(n)).cast("int")
    # a task for each shard and block: scoring is much work on few bytes
    tasks = min(MEETINGS, shards * blocks)
    sides = [
        left.select("*", dealt(shards).alias("_shard"), every(blocks).alias("_block")).repartition(tasks, "_shard", "_block"),
        right.select("*", dealt(blocks).alias("_block"), every(shards).alias("_shard")).repartition(tasks, "_shard", "_block"),
    ]
    names = [part.split()[0] for part in schema.split(", ")]

    def met(shard: pa.Table, block: pa.Table) -> pa.Table:
        made = run(*(t.combine_chunks() for t in (shard, block))) if shard.num_rows and block.num_rows else [[]] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in made], names)

    each = [df.groupBy("_shard", "_block") for df in sides]
    return each[0].cogroup(each[1]).applyInArrow(met, schema)


def first(k: int, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the ``k`` rows with the highest scores of each group, ties by the smaller key."""
    order = np.lexsort((key, -score, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < k]


def matrix(table: pa.Table, width: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """A row of longs for each vector from ``first`` to ``end`` of the column ``v``, filled up with zeros to ``width``."""
    vectors = table.column("v").chunk(0)[first:end]
    size = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy()
    return out


def _exhaustive(keys: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by whole numbers of any size, for the rare values whose sums no double holds exactly."""
    found = []
    for at, vector in enumerate(q):
        score = [sum(int(a) * int(b) for a, b in zip(vector, row, strict=True)) for row in x]
        best = sorted((i for i in range(len(keys)) if keys[i] != own[at]), key=lambda i: (-score[i], keys[i]))[:k]
        found += [(at, i, max(-LONG, min(LONG, score[i]))) for i in best]
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def search(corpus: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, key, score): the k best of ``corpus`` (key, v) for each of ``queries`` (key, v), never itself.

    Ties go to the smaller key; fewer rows come back where the corpus has fewer, none for an empty corpus. Keys are
    integers; of repeated corpus keys every row counts. Vectors of different lengths are compared as if the shorter ended
    in zeros. The corpus is dealt to shards and the queries to blocks; each block meets each shard once, and goes through it
    in parts, with each query's k-th score so far as its threshold, so memory is bounded by a shard and a block and k rows a
    query leave a meeting. Sums are exact: in single precision while no bound reaches 2 ** 24, in double precision while
    none reaches 2 ** 53, else in whole numbers; a score beyond a long is given as the nearest long.
    """
    corpus, queries = (staged(df.select("key", F.col("v").cast("array<long>").alias("v")).withColumn("place", F.monotonically_increasing_id())) for df in (corpus, queries))
    (left, right), width, size = compact(corpus, queries)
    shards, blocks = (parts(df.count(), rows, width, size) for df, rows in ((corpus, SHARD_ROWS), (queries, BLOCK_ROWS)))
    step = SHARD_ROWS

    def run(shard: pa.Table, block: pa.Table):
        keys, ids = (t.column("key").to_numpy() for t in (shard, block))
        q = matrix(block, width)
        (at, found, scores), floor = (np.zeros(0, np.int64) for _ in range(3)), np.full(len(ids), -np.inf)
        for start in range(0, len(keys), step):
            x, own = matrix(shard, width, start, start + step), keys[start : start + step]
            # bounds are sums of differences, so up to twice the largest score; components are no least long
            top = 4.0 * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width
            made = [[at], [found], [scores]]
            part = Shard(own, x.astype(np.float32 if top < 1 << 24 else np.float64)) if width and top < 1 << 53 else None
            for some in range(0, len(ids), TOGETHER):
                asked = slice(some, some + TOGETHER)
                who, rows, score = part.search(ids[asked], q[asked].astype(part.x.dtype), k, floor[asked]) if part else _exhaustive(own, x, ids[asked], q[asked], k)
                kept = first(k, who, score, own[rows])
                for column, values in zip(made, (who[kept] + some, own[rows[kept]], score[kept]), strict=True):
                    column.append(values)
            at, found, scores = (np.concatenate(c) for c in made)
            kept = first(k, at, scores, found)
            at, found, scores = at[kept], found[kept], scores[kept]
            full = np.bincount(at, minlength=len(ids)) == k
            last = np.flatnonzero(np.diff(at, append=-1))  # each query's worst
            floor[at[last]] = np.where(full[at[last]], scores[last], -np.inf)
        return ids[at], found, scores

    parted = meetings(left, right, F.xxhash64("place"), shards, blocks, run, "query_id long, key long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return parted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "score")
