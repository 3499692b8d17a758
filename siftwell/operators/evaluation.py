"""Measures of retrieval quality over result tables, and coverage, refusals, sweeps, quantiles and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import article_number, citations, law_matches, normalize_law
from siftwell.storage import staged

# Word lists of the answer's three sections.
STRUCTURE = (
    ("法律依据", "依据", "《", "第", "条"),
    ("适用", "分析", "构成要件", "要件", "情形"),
    ("风险", "提示", "注意", "举证", "时效", "误区", "不确定"),
)


#: Rows of a range that a task puts in order.
BIN_ROWS = 1_000_000


def relevance(results: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """``results`` with rel, 1.0 where (query_id, key) is in ``gold``, else 0.0."""
    marks = gold.select("query_id", key).distinct().withColumn("rel", F.lit(1.0))
    return results.join(marks, ["query_id", key], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))


def law_gold(items: DataFrame, relevant: str = "relevant") -> DataFrame:
    """(query_id, law, article): the different expected articles of items, by normalised statute name and article number.

    ``relevant``: an array of (law, article). Articles without a number are no gold.
    """
    each = items.select("query_id", F.explode(relevant).alias("g"))
    return each.select("query_id", normalize_law(F.col("g.law")).alias("law"), article_number(F.col("g.article")).alias("article")).filter("article is not null").distinct()


def chunk_keys(chunks: DataFrame, title: str = "law_title", article: str = "article_no") -> DataFrame:
    """(law, article): what a corpus holds, in the terms of ``law_gold``."""
    return chunks.select(normalize_law(F.col(title)).alias("law"), article_number(F.col(article)).alias("article")).filter("article is not null").distinct()


def law_relevance(results: DataFrame, gold: DataFrame, title: str = "law_title", article: str = "article_no") -> DataFrame:
    """``results`` with rel, 1.0 where title and article are one of the query's gold articles, else 0.0.

    Query and article number meet by equality; statute names agree if either contains the other, once normalised.
    """
    wanted = gold.groupBy(F.col("query_id").alias("_q"), F.col("article").alias("_a")).agg(F.collect_set("law").alias("_laws"))
    met = results.join(wanted, (F.col("query_id") == F.col("_q")) & (article_number(F.col(article)) == F.col("_a")), "left")
    same = F.exists(F.coalesce("_laws", F.array().cast("array<string>")), lambda law: law_matches(F.col(title), law))
    return met.withColumn("rel", F.coalesce(same, F.lit(False)).cast("double")).drop("_q", "_a", "_laws")


def per_query(items: DataFrame, judged: DataFrame, gold: DataFrame, ks: tuple[int, ...], key: str | list[str] = "doc_id") -> DataFrame:
    """(query_id, k, hit, rr, recall, precision, ndcg, ndcg_full) for every item and k.

    Relevance is binary; results short of k count as irrelevant. recall is 0 without gold. ndcg is ideal among what was
    retrieved, so missed gold doesn't lower it; ndcg_full is ideal over all gold.
    """
    n_gold = gold.select("query_id", *([key] if isinstance(key, str) else key)).distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    base = items.select("query_id").join(n_gold, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    base = base.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    gain = lambda i: 1 / F.log2(i + F.lit(1))
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    hits = judged.filter("rel > 0").select("query_id", "rank")
    joined = base.join(hits, "query_id", "left").withColumn("in_k", F.col("rank") <= F.col("k"))
    counted = joined.groupBy("query_id", "k", "n_gold").agg(
        F.count_if("in_k").alias("n"), F.coalesce(F.max(F.when(F.col("in_k"), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(F.col("in_k"), gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    share = lambda best: F.when(F.col("n") > 0, F.col("dcg") / best).otherwise(0.0)
    return counted.select(
        "query_id", "k", (F.col("n") > 0).cast("double").alias("hit"), "rr",
        F.coalesce(F.col("n") / F.nullif("n_gold", F.lit(0)), F.lit(0.0)).alias("recall"), (F.col("n") / F.col("k")).alias("precision"),
        share(ideal(F.col("n"))).alias("ndcg"), share(ideal(F.least("n_gold", "k"))).alias("ndcg_full"),
    )


def means(measured: DataFrame, *by: str) -> DataFrame:
    """Means over all items, also those without gold, for each k and group."""
    return measured.groupBy(*by, "k").agg(*(F.avg(c).alias(c) for c in ("hit", "rr", "recall", "precision", "ndcg", "ndcg_full")), F.count("*").alias("items"))


def breakdown(measured: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, k, means, items): the means by each of some columns, and over all (facet and value null), in one pass.

    Facets are columns of ``measured``, read as text; a null one is a value of its own, as an empty text.
    """
    rows = measured.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in facets})
    values = [F.avg(c).alias(c) for c in ("hit", "rr", "recall", "precision", "ndcg", "ndcg_full")]
    # a grouping column that a set leaves out has the bit 1
    out = rows.groupingSets([["k"], *([f, "k"] for f in facets)], *facets, "k").agg(*values, F.count("*").alias("items"), *(F.grouping(f).alias(f"_{f}") for f in facets))
    pick = lambda made: F.coalesce(*(F.when(F.col(f"_{f}") == 0, made(f)) for f in facets))
    return out.select(pick(F.lit).alias("facet"), pick(F.col).alias("value"), "k", "hit", "rr", "recall", "precision", "ndcg", "ndcg_full", "items")


def coverage(items: DataFrame, gold: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, n_gold, n_covered, in_corpus): gold keys of every item, those that the corpus has, whether it has some gold and all of it."""
    distinct = gold.select("query_id", *keys).distinct()
    marked = distinct.join(corpus.select(*keys).distinct().withColumn("there", F.lit(1)), keys, "left")
    counted = marked.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("there").alias("n_covered"))
    joined = items.select("query_id").join(counted, "query_id", "left").na.fill(0, ["n_gold", "n_covered"])
    return joined.withColumn("in_corpus", (F.col("n_gold") > 0) & (F.col("n_gold") == F.col("n_covered")))


def in_domain(items: DataFrame, gold: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Items of which the corpus has some gold."""
    return items.join(gold.join(corpus.select(*keys).distinct(), keys, "left_semi").select("query_id").distinct(), "query_id", "left_semi")


def answerable(items: DataFrame, gold: DataFrame, corpus: DataFrame, keys: list[str], refusal: str | None = None) -> DataFrame:
    """Items of which the corpus has all gold, and that don't expect a refusal."""
    found = items.join(coverage(items, gold, corpus, keys).filter("in_corpus").select("query_id"), "query_id", "left_semi")
    return found.filter(~F.coalesce(F.col(refusal), F.lit(False))) if refusal else found


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def refusals(items: DataFrame, results: DataFrame, expect: str = "expect_refusal") -> DataFrame:
    """One row: expected, refused (of those), false_refused (of the rest), refusal_rate, false_refusal_rate."""
    some = results.select("query_id").distinct().withColumn("answered", F.lit(True))
    joined = items.select("query_id", F.coalesce(F.col(expect), F.lit(False)).alias("e")).join(some, "query_id", "left").withColumn("r", F.col("answered").isNull())
    counts = joined.agg(F.count_if("e").alias("expected"), F.count_if(F.col("e") & F.col("r")).alias("refused"), F.count_if(~F.col("e") & F.col("r")).alias("false_refused"), F.count("*").alias("n"))
    return counts.select(
        "expected", "refused", "false_refused", _ratio(F.col("refused"), F.col("expected")).alias("refusal_rate"),
        _ratio(F.col("false_refused"), F.col("n") - F.col("expected")).alias("false_refusal_rate"),
    )


def present_rate(results: DataFrame, column: str) -> DataFrame:
    """One row (slots, present, rate): results whose ``column`` is not null; a rate of 1 without results."""
    return results.agg(F.count("*").alias("slots"), F.count(column).alias("present")).withColumn("rate", F.coalesce(F.col("present") / F.nullif("slots", F.lit(0)), F.lit(1.0)))


def sweep(items: DataFrame, judged: DataFrame, thresholds: list[float], k: int = 5, expect: str = "expect_refusal") -> DataFrame:
    """For each threshold: hit, refusal_rate, false_refusal_rate and avg_kept of the top ``k`` scores that reach it.

    ``judged``: query_id, score, rel, rank by score. The grid is exploded from a literal, results are read once.
    """
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    kept = judged.filter(F.col("rank") <= k).select("query_id", "score", "rel", grid).filter("score >= threshold")
    per = kept.groupBy("query_id", "threshold").agg(F.count("*").alias("kept"), F.max("rel").alias("hit"))
    every = items.select("query_id", F.coalesce(F.col(expect), F.lit(False)).alias("e"), grid).join(per, ["query_id", "threshold"], "left").na.fill(0, ["kept", "hit"])
    out = F.col("kept") == 0
    counts = every.groupBy("threshold").agg(
        F.count_if("e").alias("expected"), F.count_if(~F.col("e")).alias("n"), F.count_if(F.col("e") & out).alias("ok"),
        F.count_if(~F.col("e") & out).alias("wrong"), F.sum(F.when(~F.col("e"), F.col("hit")).otherwise(0.0)).alias("hits"), F.avg("kept").alias("avg_kept"),
    )
    return counts.select(
        "threshold", _ratio(F.col("hits"), F.col("n")).alias("hit"), _ratio(F.col("ok"), F.col("expected")).alias("refusal_rate"),
        _ratio(F.col("wrong"), F.col("n")).alias("false_refusal_rate"), "avg_kept",
    )


def picked_quantiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at index floor(n * share) of the sorted non-null values, not interpolated.

    Equal values are counted; the counts are dealt to ranges of about equally many values, whatever their distribution, and
    only the ranges that hold a wanted index are summed up in order, each by itself.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    dealt = in_ranges(counts, "value")
    wanted = _before(dealt, F.sum("c")).withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    at = F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1)
    wanted = wanted.filter((F.col("before") <= at) & (at < F.col("before") + F.col("rows"))).select("bin", "before", "share", at.alias("at"))
    inside = dealt.join(F.broadcast(wanted), "bin")  # a row for each share
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("share").orderBy("value"))
    return inside.withColumn("upto", upto).filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at"))).select("share", "value")


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, staged, with ``bin``: ascending ranges of the columns ``order`` with about BIN_ROWS rows each.

    The bounds come from a sample of the rows, so ranges are even wherever the values lie; rows that agree in all columns of
    ``order`` share a range.
    """
    rows = staged(rows)
    n = max(1, -(-rows.count() // BIN_ROWS))
    return staged(rows.repartitionByRange(n, *order).withColumn("bin", F.spark_partition_id()))


def _before(dealt: DataFrame, count: Column) -> DataFrame:
    """(bin, rows, before, total) of the ranges with rows: a row for each BIN_ROWS, so the running sum may take one task."""
    sized = dealt.groupBy("bin").agg(count.alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("rows").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sized.withColumns({"before": before, "total": total})


def uniform_sample(items: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) by a hash of the key: the same rows in every run."""
    return items.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def stratified_sample(items: DataFrame, stratum: str, order: str, per: int) -> DataFrame:
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).filter(F.col("_n") <= per).drop("_n")


def systematic_sample(items: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row of the whole set in the order of a numeric column, from the first.

    Rows are numbered within ranges of about BIN_ROWS rows, and the rows of earlier ranges are added, so no task sorts the set.
    Rows with equal values stand by a hash of all their columns; null values come first.
    """
    keyed = items.withColumn("_tie", F.xxhash64(*items.columns))
    dealt = in_ranges(keyed, order, "_tie")
    numbered = dealt.join(F.broadcast(_before(dealt, F.count("*")).select("bin", "before")), "bin")  # a row for each range
    place = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy(order, "_tie")) - 1
    return numbered.withColumn("_n", place).filter(F.pmod(F.col("_n"), F.lit(step)) == 0).select(*items.columns)


def agent_score(answer: Column, called: Column, tools: Column, words: Column) -> dict[str, Column]:
    """Four parts of 0 to 25: expected tools called, sections found, sources cited (two suffice), expected words found."""
    part = lambda found, of: F.when(F.size(F.coalesce(of, F.array())) == 0, F.lit(25.0)).otherwise(25.0 * found / F.size(F.array_distinct(of)))
    answer = F.coalesce(answer, F.lit(""))
    section = lambda ws: reduce(lambda a, b: a | b, [answer.contains(w) for w in ws])
    structure = sum((F.when(section(ws), 25.0 / 3).otherwise(0.0) for ws in STRUCTURE), F.lit(0.0))
    low = F.lower(answer)
    hits = F.size(F.filter(words, lambda w: low.contains(F.lower(w))))
    return {
        "tool_selection": part(F.size(F.array_intersect(F.array_distinct(called), F.array_distinct(tools))), tools),
        "structure": structure,
        "source_citation": F.least(citations(answer) / 2.0, F.lit(1.0)) * 25.0,
        "keyword_coverage": F.when(F.size(F.coalesce(words, F.array())) == 0, F.lit(25.0)).otherwise(25.0 * hits / F.size(words)),
    }


def agent_report(scored: DataFrame, parts: tuple[str, ...] = ("tool_selection", "structure", "source_citation", "keyword_coverage"), total: str = "total", mark: float = 70.0) -> DataFrame:
    """One row: n, the mean of each part and of the total, the share of each part's 25 points, the rows of each tier, and
    ``passed``: whether the mean total reaches ``mark`` (false without rows)."""
    means_ = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in (*parts, total)]
    tiers = [F.count_if(tier(F.col(total)) == t).alias(t) for t in ("excellent", "good", "fair", "poor")]
    told = scored.agg(F.count("*").alias("n"), *means_, *tiers).withColumn("passed", F.col(total) >= mark)
    return told.select("n", *parts, total, *((F.col(c) / 25.0).alias(f"{c}_share") for c in parts), "excellent", "good", "fair", "poor", "passed")


def worst(scored: DataFrame, order: list[str], n: int = 3, below: float = 60.0, total: str = "total") -> DataFrame:
    """The ``n`` rows of least total, of those below a mark; ties in the order of the columns ``order``."""
    return scored.filter(F.col(total) < below).orderBy(total, *order).limit(n)


def combined(*sets: DataFrame) -> DataFrame:
    """Evaluation sets one after the other, with the columns of all; a column that a set lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)


def tier(total: Column) -> Column:
    return F.when(total >= 80, "excellent").when(total >= 60, "good").when(total >= 40, "fair").otherwise("poor")
