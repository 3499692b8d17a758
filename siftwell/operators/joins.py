"""Equi-joins of a long table with a table of its keys, safe for keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes in a salted join.
SALT_ROWS = 100_000


def with_key_columns(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join with ``keyed``, which has one row for each ``key`` and says in ``count`` how many rows have it.

    Fewer than ``share`` keys can hold more than ``total / share`` rows each: these are broadcast. Rows with other keys are
    shuffled by key, rows already served by a hash of all their columns, so no task gets a frequent key.
    """
    often = F.col(count) > max(1, total // share)
    extra = [c for c in keyed.columns if c != key]
    known = rows.join(F.broadcast(keyed.filter(often).select(key, F.struct(*extra).alias("_often"))), key, "left")
    seldom = keyed.filter(~often).select(F.xxhash64(key).alias("_place"), F.col(key).alias("_key"), F.struct(*extra).alias("_seldom"))
    placed = known.withColumn("_at", F.when(F.col("_often").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*rows.columns)))
    both = placed.join(seldom, (F.col("_at") == F.col("_place")) & (F.col(key) == F.col("_key")) & F.col("_often").isNull(), "left")
    return both.withColumn("_found", F.coalesce("_often", "_seldom")).filter("_found is not null").select(*rows.columns, "_found.*")


def salted(rows: DataFrame, many: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """Inner join of two tables that may both hold a ``key`` many times; both have ``count``, the rows of the key in ``rows``.

    A key's rows are dealt, by a hash of ``spread``, to one part for each SALT_ROWS of them, and ``many`` is repeated for
    each part, so a task never meets more than a part.
    """
    parts = F.ceil(F.col(count) / SALT_ROWS).cast("int")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.greatest(parts, F.lit(1))).cast("int"))
    right = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return left.join(right, [key, "_salt"]).drop("_salt")
