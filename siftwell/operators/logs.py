"""Rollups of call logs, feedback, conversations and crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import cost


def usage(calls: DataFrame) -> DataFrame:
    """For each source, and in total (source null): calls, tokens, cost_cny, latency_ms and failures."""
    priced = calls.withColumn("_cost", cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))
    return priced.rollup("source").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(F.sum("_cost"), 6).alias("cost_cny"), F.round(F.sum("latency_ms"), 1).alias("latency_ms"), F.count_if(~F.col("success")).alias("failures"),
    )


def feedback(entries: DataFrame) -> DataFrame:
    """For each mode, and in total (mode null): total, up, down and satisfaction (0 without ratings)."""
    counted = entries.rollup("mode").agg(F.count("*").alias("total"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))
    return counted.withColumn("satisfaction", F.coalesce(F.col("up") / F.nullif(F.col("up") + F.col("down"), F.lit(0)), F.lit(0.0)))


def latest(entries: DataFrame, order: list[Column | str], n: int = 10) -> DataFrame:
    return entries.orderBy(*order).limit(n)


def last_turns(turns: DataFrame, n: int = 6, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    back = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")


def crawl_progress(statutes: DataFrame, expected: DataFrame, category: str = "category") -> DataFrame:
    """(category, laws, articles, expected, share) for every expected category."""
    done = statutes.groupBy(category).agg(F.count("*").alias("laws"), F.sum(F.size(F.coalesce("articles", F.array().cast(statutes.schema["articles"].dataType)))).alias("articles"))
    joined = expected.join(done, category, "left").na.fill(0, ["laws", "articles"])
    return joined.withColumn("share", F.coalesce(F.col("laws") / F.nullif("expected", F.lit(0)), F.lit(0.0)))


def recent_rate(times: DataFrame, column: str, now: Column, seconds: int = 300) -> DataFrame:
    """One row (n, per_minute) over the last ``seconds``: events by the span from the first of them to the last."""
    span = F.greatest((F.max(column) - F.min(column)).cast("double"), F.lit(1.0))
    return times.filter(F.col(column) >= now - seconds).agg(F.count("*").alias("n"), F.coalesce(F.count("*") * 60 / span, F.lit(0.0)).alias("per_minute"))


def remaining(progress: DataFrame, rate: DataFrame) -> DataFrame:
    """One row (done, expected, per_minute, minutes_left) from ``crawl_progress`` and ``recent_rate``.

    minutes_left is null with fewer than two events in the window or no rate, and 0 where all is done.
    """
    total = progress.agg(F.coalesce(F.sum("laws"), F.lit(0)).alias("done"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"))
    left = F.greatest(F.col("expected") - F.col("done"), F.lit(0))
    known = F.when(F.col("n") >= 2, left / F.nullif("per_minute", F.lit(0.0)))
    return total.crossJoin(F.broadcast(rate)).select("done", "expected", "per_minute", F.when(left == 0, 0.0).otherwise(known).alias("minutes_left"))  # one row each


def reasons(failures: DataFrame, column: str = "reason") -> DataFrame:
    return failures.groupBy(column).agg(F.count("*").alias("n"))
