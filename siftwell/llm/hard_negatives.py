"""Hard-negative mining by matrix products in a residue number system.

Scores are exact integers although the products run in single precision: matrices are taken modulo several primes, small
enough that a sum of products of residues stays below 2 ** 24, multiplied, and the signed scores are put together from
their residues by the Chinese remainder theorem (mixed radix digits). The number of primes follows from the norms.

Anchors meet all rows in blocks: first each anchor's positives are found, then, in the window of scores that each positive
sets, its negatives. A meeting gives a few rows for each anchor, which are merged by rank.
"""

from __future__ import annotations

from functools import lru_cache
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import caches, staged
from siftwell.llm.topk import LONG, compact, first, matrix, meetings, parts, quantised

#: Rows and anchors that are multiplied together; components of a vector whose products are summed in single precision.
SHARD_ROWS, BLOCK_ROWS, WIDTH = 8192, 256, 1024
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90


@lru_cache(64)
def primes(width: int, most: int) -> tuple[int, ...]:
    """Primes, largest first, whose product exceeds 2 * ``most``; sums of ``width`` products of centred residues are exact in single precision."""
    limit = min(isqrt(4 * (1 << 24) // max(width, 1)), 4000)
    sieve = np.ones(limit + 1, bool)
    sieve[:2] = False
    for i in range(2, isqrt(limit) + 1):
        sieve[i * i :: i] = sieve[i * i :: i] & ~sieve[i]
    found: list[int] = []
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if prod(found) > 2 * most:
            return tuple(found)
        if p > 2:
            found.append(p)
    raise ValueError("the primes below the bound do not reach the largest score")


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p``; a division by one number is several times as fast as its remainder."""
    return x - x // p * p


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact ``a @ b.T`` of integer matrices, as longs, or as Python integers where a score could leave a long."""
    most = int(_norm(a) * _norm(b) * (1 + 1e-6)) + 1
    chosen = primes(min(max(a.shape[1], 1), WIDTH), most)
    wide = 2 * prod(chosen) > LONG
    value, factor = np.zeros((len(a), len(b)), object if wide else np.int64), 1
    for p in chosen:
        left, right = ((np.mod(m + p // 2, p) - p // 2).astype(np.float32) for m in (a, b))
        residue = np.zeros(value.shape, np.int64)
        for first in range(0, a.shape[1], WIDTH):
            residue += (left[:, first : first + WIDTH] @ right[:, first : first + WIDTH].T).astype(np.int64)
        # the next digit in mixed radix: what the value so far lacks modulo p, times the inverse of the radix
        digit = _mod(_mod(residue - _mod(value, p).astype(np.int64), p) * pow(factor % p, -1, p), p) if factor > 1 else _mod(residue, p)
        value = value + (digit.astype(object) if wide else digit) * factor
        factor *= p
    return np.where(value > factor // 2, value - factor, value)


def best(scores: np.ndarray, keys: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k allowed entries with the highest scores, ties by the smaller key."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        some = scores[at]
        at = at[some >= np.partition(some, len(some) - k)[len(some) - k]]
    return at[np.lexsort((keys[at], -scores[at]))][:k]


def windows(scores: list[int]) -> list[tuple[int, int]]:
    """Least and greatest negative score for each positive score."""
    return [(-(-LOW * s // 100), HIGH * s // 100) for s in scores]


def _meet(corpus: DataFrame, anchors: DataFrame, schema: str, choose, k: int) -> DataFrame:
    """Every block of anchors with every shard of the corpus: the best ``k`` rows for each place that ``choose`` gives an anchor.

    ``choose`` yields the place, its columns and the rows that it takes of a part of the shard, from the anchor and its exact scores.
    """
    (left, right), width, size = compact(corpus.select("key", "copy", "label", "v"), anchors)
    shards, blocks = parts(corpus.count(), SHARD_ROWS, width, size), parts(anchors.count(), BLOCK_ROWS, width, size)
    rows, together = SHARD_ROWS, BLOCK_ROWS

    def run(shard: pa.Table, block: pa.Table):
        caches("hard_negatives")
        keys, labels = (shard.column(n).to_numpy() for n in ("key", "label"))
        own, given = block.drop_columns("v").to_pylist(), matrix(block, width)
        best_rows = np.zeros((len(schema.split(", ")) + 1, 0), np.int64)  # the group, the columns, the key, the score
        for start in range(0, len(keys), rows):
            part, names, kinds = matrix(shard, width, start, start + rows), keys[start : start + rows], labels[start : start + rows]
            made = [best_rows]
            for some in range(0, len(own), together):
                score = np.clip(products(given[some : some + together], part), -LONG, LONG).astype(np.int64)
                for i, anchor in enumerate(own[some : some + together]):
                    for place, columns, at in choose(anchor, names, kinds, score[i]):
                        beside = np.tile(np.array([(some + i) * POSITIVES + place, anchor["key"], anchor["copy"], *columns], np.int64)[:, None], len(at))
                        made.append(np.concatenate([beside, [names[at], score[i][at]]]))
            best_rows = np.concatenate(made, 1)
            best_rows = best_rows[:, first(k, best_rows[0], best_rows[-1], best_rows[-2])]
        return best_rows[1:]

    return meetings(left, right, F.xxhash64("key", "copy"), shards, blocks, run, schema)


def _positives(anchor, keys, labels, scores):
    yield 0, (), best(scores, keys, (labels == anchor["label"]) & (keys != anchor["key"]), POSITIVES)


def _negatives(anchor, keys, labels, scores):
    other = labels != anchor["label"]
    given = [p["positive_score"] for p in anchor["positives"]]
    for place, (positive, (low, high)) in enumerate(zip(anchor["positives"], windows(given), strict=True)):
        yield place, (positive["rank"], positive["positive_id"], positive["positive_score"]), best(scores, keys, other & (scores >= low) & (scores <= high), NEGATIVES)


def mine(rows: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose ``key`` fits ``is_anchor``.

    Components become floor(scale * x); a score is the exact inner product, held at the ends of a long. Higher scores come first, ties
    by the smaller key. An anchor's positives are the first POSITIVES rows of its label with another key; the negatives of
    each are the first NEGATIVES rows of other labels with LOW to HIGH hundredths of the positive's score, so none for a
    positive below zero. Rows with a null key, label or vector, or with a null or non-finite component take no part. Rows
    that repeat key, label and vector are one; others with equal keys are rows of their own. Vectors of different lengths
    are compared as if the shorter ended in zeros. An empty table gives no rows. Memory is bounded by a shard and a block.
    """
    both = rows.select(F.struct(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label")).alias("row"), F.col(vector).alias("vector"))
    slim = quantised(both, "row", "vector", scale).select("key.key", "key.label", "v").dropna()
    slim = staged(slim.dropDuplicates().withColumn("copy", F.xxhash64("label", "v")))
    anchors = slim.filter(is_anchor(F.col("key")))
    near = _meet(slim, anchors, "key long, copy long, positive_id long, positive_score long", _positives, POSITIVES)
    leading = Window.partitionBy("key", "copy").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(leading)).filter(F.col("rank") <= POSITIVES)
    told = near.groupBy("key", "copy").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    told = staged(anchors.join(told.hint("merge"), ["key", "copy"]))
    names = "key long, copy long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _meet(slim, told, names, _negatives, NEGATIVES)
    merged = Window.partitionBy("key", "copy", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= NEGATIVES)
    return far.select(F.col("key").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
