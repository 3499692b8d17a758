"""Mixing sources to target weights by iterative proportional fitting, then calibrated sampling of documents.

Tokens are counted in cells (source, language, topic). The cells' weights are raked to the target marginals of each of the
three, in turn and again, never above the tokens that a cell has; a document is then taken with its cell's weight over
its cell's tokens as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import heavy_join, packed, staged, unpacked

#: Topics that texts are dealt to where no topic column is given.
TOPICS = 8
#: Cells (three short columns and a number each) up to which their table is broadcast.
BROADCAST_CELLS = 200_000
MARGINS = ("source", "lang", "topic")


def cells_of(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """(key, source, lang, topic, tokens) of every row, and with ``whole`` the row as ``doc``.

    Null sources and languages become ``(none)``. tokens: white-space separated tokens, at least 1, so that an empty text
    weighs something. topic: a stand-in from the text alone, the hash of its longest word in lower case (the greatest on
    ties), 0 without a word.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    words = F.split(F.lower(F.col(text)), "[ \t\n\r\x0b\x0c]+")
    rows = packed(docs, key=F.col(key), source=name(source), lang=name(lang), words=words)
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    topic = F.coalesce(F.conv(F.substring(F.md5(F.nullif(longest, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % TOPICS, F.lit(0)).cast("int")
    edges = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    tokens = F.greatest(F.lit(1), F.coalesce(F.size("words") - edges, F.lit(1))).cast("long")
    return rows.select(*["doc"] * whole, "key", "source", "lang", topic.alias("topic"), tokens.alias("tokens"))


def rake(cells: DataFrame, fraction: float = 0.5, temper: float = 0.7, rounds: int = 12, targets: dict[str, dict] | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``prob``, the probability of the documents of each cell.

    ``targets`` gives shares of values, as in {"lang": {"en": 0.6}}; the values of a margin that it leaves out divide what
    is left of 1 by their token shares to the power ``temper``: below 1 lifts rare values. The targets of each margin sum to
    ``fraction`` of all tokens. Each round scales the weights to the three margins in turn; the cells' weights never exceed
    their tokens. A margin whose values have too few tokens for their target, or that lacks a value, falls short by that.

    Up to BROADCAST_CELLS cells are scaled by windows; more of them by a table of each margin's sums, step by step, so that
    a value with many cells is spread over tasks.
    """
    for margin, given in (targets or {}).items():
        if margin not in MARGINS or min(given.values(), default=0) < 0 or sum(given.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {margin} must be shares of 1 of one of {MARGINS}")
    now = cells.withColumn("w", F.col("tokens") * F.lit(fraction))
    grand = cells.agg(F.sum("tokens").alias("grand"))
    few = cells.count() <= BROADCAST_CELLS
    for margin in MARGINS:
        given = (targets or {}).get(margin, {})
        told = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])[F.col(margin)] if given else F.lit(None).cast("double")
        share = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("s"), F.count("*").alias("cells")).withColumn("told", told)
        rest = share.agg(F.coalesce(F.sum(F.when(F.col("told").isNull(), F.col("s"))), F.lit(1.0)).alias("all"))
        part = F.coalesce("told", F.col("s") / F.col("all") * (1 - sum(given.values())))
        target = share.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(grand)).select(margin, (part * F.col("grand") * fraction).alias(f"t_{margin}"), "cells")
        now = now.join(target.drop("cells"), margin) if few else heavy_join(now, target, [margin], "cells", BROADCAST_CELLS).drop("cells")
    if few:
        now = staged(now)  # short plans: the driver plans, and tells of, each step of one anew whenever a shuffle ends
    for turn in range(rounds):
        for margin in MARGINS:
            if few:
                now = now.withColumn("own", F.sum("w").over(Window.partitionBy(margin)))
            else:
                sums = now.groupBy(margin).agg(F.sum("w").alias("own"), F.count("*").alias("cells"))
                now = heavy_join(now, sums, [margin], "cells", BROADCAST_CELLS).drop("cells")
            scaled = F.coalesce(F.col("w") * F.col(f"t_{margin}") / F.nullif("own", F.lit(0.0)), F.lit(0.0))
            now = now.withColumn("w", F.least(F.col("tokens").cast("double"), scaled)).drop("own")
            if not few:
                now = staged(now)
        if few and turn % 2 == 1:
            now = staged(now)
    return now.select(*MARGINS, "tokens", (F.col("w") / F.col("tokens")).alias("prob"))


def uniform(key: Column, seed: int = 17) -> Column:
    """A number in [0, 1) from a key: 52 bits of an MD5 digest, which other engines can repeat."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_probabilities(rows: DataFrame, **options) -> DataFrame:
    """``rows`` (of ``cells_of``) with ``prob`` of their cell.

    The table of cells is broadcast while it has at most BROADCAST_CELLS rows; of a larger one only cells with many rows.
    """
    counted = staged(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    raked = rake(counted.drop("rows"), **options).select(*MARGINS, "prob")
    if counted.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(raked), list(MARGINS))
    sized = staged(raked.join(counted.select(*MARGINS, "rows"), list(MARGINS)))
    total = counted.agg(F.sum("rows")).first()[0]
    return heavy_join(rows, sized, list(MARGINS), "rows", total).drop("rows")


def decisions(docs: DataFrame, key: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """(key, source, lang, topic, tokens, prob, sampled) for every row of ``docs``.

    Rows with equal keys are all sampled or all not, if of one cell; null keys are one key. Ties can't occur. An empty table
    gives an empty one.
    """
    found = with_probabilities(staged(cells_of(docs, key=key)), **options)
    return found.select(F.col("key").alias(key), *MARGINS, "tokens", "prob", (uniform(F.col("key"), seed) < F.col("prob")).alias("sampled"))


def sample(docs: DataFrame, key: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its columns: each with its cell's probability, by a hash of its key.

    The choice depends on key and seed alone, so a rerun takes the same rows; rows with equal keys go or stay together. An
    empty table gives an empty one.
    """
    found = with_probabilities(cells_of(docs, key=key, whole=True), **options)
    return unpacked(found.filter(uniform(F.col("key"), seed) < F.col("prob")), docs.columns)


def oracle(fraction: float = 0.5, temper: float = 0.7, rounds: int = 12, seed: int = 17) -> str:
    """SQL for DuckDB that gives the rows of ``decisions`` over the table documents, prob rounded to 6 places."""
    share = lambda m: f"{fraction} * (SELECT sum(tokens) FROM cells) * pow(sum(tokens) OVER (PARTITION BY {m}), {temper}) / (SELECT sum(pow(n, {temper})) FROM (SELECT sum(tokens) AS n FROM cells GROUP BY {m}))"
    steps = [f"r0 AS MATERIALIZED (SELECT *, tokens * {fraction} AS w, " + ", ".join(f"{share(m)} AS t_{m}" for m in MARGINS) + " FROM cells)"]
    for _ in range(rounds):
        for m in MARGINS:
            n = len(steps)
            steps.append(f"r{n} AS MATERIALIZED (SELECT * REPLACE (least(tokens, w * t_{m} / sum(w) OVER (PARTITION BY {m})) AS w) FROM r{n - 1})")
    return f"""
        WITH words AS (
            SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
                list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents
        ), docs AS MATERIALIZED (
            SELECT doc_id, source, lang, greatest(1, coalesce(len(w), 1))::BIGINT AS tokens,
                coalesce(('0x' || substr(md5(list_max(list_transform(w, lambda x: {{'n': length(x), 'w': x}})).w), 1, 8))::BIGINT % {TOPICS}, 0)::INTEGER AS topic
            FROM words
        ), cells AS MATERIALIZED (
            SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL
        ), {", ".join(steps)}
        SELECT doc_id, source, lang, topic, d.tokens, round(w / c.tokens, 6) AS prob,
            ('0x' || substr(md5(doc_id || ':{seed}'), 1, 13))::BIGINT / {1 << 52}::DOUBLE < w / c.tokens AS sampled
        FROM docs d JOIN r{len(steps) - 1} c USING (source, lang, topic)"""
