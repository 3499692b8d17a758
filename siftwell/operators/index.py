"""Inverted index as tables: term frequencies, document lengths, term statistics, and what a build needs around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import idf
from siftwell.functions.text import cjk_grams, n_tokens, tokens
from siftwell.operators.joins import with_key_columns
from siftwell.storage import staged

SCHEMA_VERSION = 2


#: Terms up to which a table of them is broadcast (some 50 bytes each).
BROADCAST_TERMS = 500_000


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf). Counted before the shuffle, which then moves one row for each pair."""
    return docs.select(F.col(key), F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def frequencies_of(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, length, term, tf) of the given ``terms`` (term, each once) in ``docs``, and one row (n, average) of all documents.

    Texts are split once: a row without a term for each document carries its length, being all tokens of the text, through
    the shuffle that counts. At most BROADCAST_TERMS terms are broadcast, so other tokens never leave their task. More of
    them are joined by shuffle after counting, which moves one row for each pair of document and term.
    """
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    split = docs.select(F.col(key), tokens(F.coalesce(text, F.lit(""))).alias("all"))
    each = split.select(key, F.size("all").alias("length"), F.explode(F.concat("all", F.array(F.lit(None).cast("string")))).alias("term"))
    if few:
        marked = each.join(F.broadcast(terms.withColumn("_asked", F.lit(True))), "term", "left").filter("_asked or term is null")
        counted = staged(marked.groupBy(key, "length", "term").agg(F.count("*").alias("tf")))
        found = counted.filter("term is not null")
    else:
        counted = staged(each.groupBy(key, "length", "term").agg(F.count("*").alias("tf")))
        df = counted.filter("term is not null").groupBy("term").agg(F.count("*").alias("_df"))
        found = with_key_columns(counted.filter("term is not null"), staged(df.join(terms, "term", "left_semi")), "term", "_df", counted.count()).drop("_df")
    whole = counted.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("average"))
    return found, whole


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length) of every document, token-less ones too; no shuffle."""
    return docs.select(F.col(key), n_tokens(F.col(text)).cast("long").alias("length"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents and their average length."""
    return docs.select(n_tokens(F.col(text)).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def term_stats(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); idf is positive for every df."""
    counted = frequencies.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row of statistics


def dedupe(statutes: DataFrame, size: str, order: str, *keys: str) -> DataFrame:
    """Of the rows with equal keys the one with the largest ``size`` column, the first by ``order`` on ties."""
    best = Window.partitionBy(*keys).orderBy(F.desc(size), order)
    return statutes.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def in_force(statutes: DataFrame, status: str = "sxx") -> DataFrame:
    """Statutes in force or not yet effective; those without a status go."""
    return statutes.filter(F.col(status).isin(3, 4))


def parsed(statutes: DataFrame, articles: str = "articles") -> tuple[DataFrame, DataFrame]:
    """(statutes with articles, statutes without)."""
    some = F.size(F.coalesce(F.col(articles), F.array().cast(statutes.schema[articles].dataType))) > 0
    return statutes.filter(some), statutes.filter(~some)


def indexable(statutes: DataFrame, size: str = "n_articles") -> tuple[DataFrame, DataFrame]:
    """What a build indexes, and one row of what it found (laws, repeated, effective, pending, other_versions, unparsed).

    Of records with equal ids the one with most articles counts; those in force or pending, with articles, are indexed.
    """
    sized = statutes.withColumn(size, F.size(F.coalesce("articles", F.array().cast(statutes.schema["articles"].dataType))))
    once = dedupe(sized, size, "title", "bbbs")
    current = in_force(once)
    effective, pending = F.col("sxx") == 3, F.col("sxx") == 4
    some = F.col(size) > 0
    told = once.agg(
        F.count("*").alias("laws"), F.count_if(effective).alias("effective"), F.count_if(pending).alias("pending"),
        F.count_if(~F.coalesce(effective | pending, F.lit(False))).alias("other_versions"), F.count_if((effective | pending) & ~some).alias("unparsed"),
    ).crossJoin(F.broadcast(statutes.agg(F.count("*").alias("records"))))  # fmt: skip  one row each
    report = told.select("laws", (F.col("records") - F.col("laws")).alias("repeated"), "effective", "pending", "other_versions", "unparsed")
    return parsed(current)[0].drop(size), report


def keywords(questions: DataFrame, terms: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, keywords): the ``k`` tokens of each question with the largest count times idf, on ties in order.

    ``terms`` (term, idf) comes from an index; a token that it lacks counts as the rarest. A token of five or more CJK
    characters, which no segmenter has cut, counts as its grams of up to four.
    """
    uncut = lambda t: F.when(t.rlike("^[一-鿿]{5,}$"), cjk_grams(t)).otherwise(F.array(t))
    each = questions.select("query_id", F.explode(F.flatten(F.transform(tokens(F.col("text")), uncut))).alias("term"))
    asked = each.groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    rarest = terms.agg(F.max("idf").alias("_rarest"))
    weighed = asked.join(terms.select("term", "idf"), "term", "left").crossJoin(F.broadcast(rarest))  # one row
    score = F.round(F.col("tf") * F.coalesce("idf", "_rarest", F.lit(1.0)), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    top = weighed.withColumn("score", score).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    packed = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x.term), " ").alias("keywords"))
    return questions.select("query_id", "text").join(packed, "query_id", "left").select("query_id", F.coalesce("keywords", "text").alias("keywords"))


def replace_by_source(existing: DataFrame, incoming: DataFrame, source: str = "source") -> DataFrame:
    """``existing`` without the sources that ``incoming`` brings, and ``incoming``."""
    rest = existing.join(incoming.select(source).distinct(), source, "left_anti").select(*existing.columns)
    return rest.unionByName(incoming, allowMissingColumns=True)


def signature(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (version, n, fingerprint): independent of the order of rows, so it needs no sort and no single task."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    folded = docs.select(part(1).alias("a"), part(16).alias("b")).agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"))
    return folded.select(F.lit(SCHEMA_VERSION).alias("version"), "n", F.concat_ws(":", F.col("x").cast("string"), F.col("s").cast("string")).alias("fingerprint"))


def index_stats(chunks: DataFrame, category: str, title: str) -> DataFrame:
    """Rows (category, chunks, titles, without_title) for each category."""
    return chunks.groupBy(category).agg(
        F.count("*").alias("chunks"), F.count_distinct(title).alias("titles"), F.count_if(F.coalesce(F.col(title), F.lit("")) == "").alias("without_title")
    )
