"""Distributed union-find over an edge table: alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import heavy_join, staged, temporary


def _large(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return heavy_join(both.filter("v > u"), least, ["u"], "n", 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the least of them; ``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = heavy_join(edges, least, ["u"], "n", edges.count()).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has two columns u and v of one orderable type. The neighbours of a centre, however many, are spread over
    tasks. Self-loops and nulls are dropped. Each round is written to
    the shared folder. Stops when a round changes nothing; raises if ``max_rounds`` do not suffice (they suffice for
    components of any size met in practice, as the number of rounds grows with the logarithm of the size).
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        with temporary(edges.sparkSession) as keep:
            now = staged(_small(staged(_large(now))).distinct())
            keep(now)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.count_distinct("v").alias("d")).first()
        if mark == tuple(seen):
            roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
