"""Writers: index tables with a manifest, replacement by source, logs, reports and statute files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import index

RATINGS = ("up", "down")


def save_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Postings (sorted by term within files dealt by term), lengths, term and corpus statistics, and last the manifest."""
    tf = index.term_frequencies(docs, key, text)
    tf.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    postings = docs.sparkSession.read.parquet(f"{path}/postings")
    index.lengths(docs, key, text).write.mode("overwrite").parquet(f"{path}/lengths")
    stats = index.corpus_stats(docs, text)
    stats.write.mode("overwrite").parquet(f"{path}/corpus")
    index.term_stats(postings, stats).write.mode("overwrite").parquet(f"{path}/terms")
    index.signature(docs, text).write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, docs: DataFrame | None = None, text: str = "text") -> dict[str, DataFrame] | None:
    """The tables of an index, or None if it has another version or, with ``docs``, another corpus."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if manifest is None or manifest["version"] != index.SCHEMA_VERSION:
        return None
    if docs is not None and index.signature(docs, text).first() != manifest:
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "corpus")}


def attach_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """The index at ``path`` where it fits ``docs``, else a new one written there."""
    from pyspark.errors import AnalysisException

    try:
        found = load_index(docs.sparkSession, path, docs, text)
    except AnalysisException:  # nothing there yet
        found = None
    if found is None:
        save_index(docs, path, key, text)
        found = load_index(docs.sparkSession, path)
    return found


def build_index(statutes: DataFrame, chunk_path: str, index_path: str, max_chars: int = 800) -> DataFrame:
    """Statute records to chunks and an index over all chunks there; one row: what ``indexable`` found, and ``chunks``.

    Statutes that come again replace their old chunks (by source), so a build may be repeated and done in parts. Chunks are a
    table in versions: a build that fails leaves the last one, and the index is of the version that this one made.
    """
    from siftwell.operators import segment
    from siftwell.sources import versions

    spark = statutes.sparkSession
    kept, report = index.indexable(statutes)
    made = versions.replace(segment.chunks(kept, max_chars), chunk_path)
    every = versions.read(spark, chunk_path, made)
    save_index(every, index_path, "id")
    return report.crossJoin(F.broadcast(every.agg(F.count("*").alias("chunks"))))  # one row each


def replace_sources(incoming: DataFrame, path: str, source: str = "source") -> None:
    """Write ``incoming`` to a table partitioned by source; the partitions it brings replace the old ones, others stay."""
    incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    """Append feedback as JSON lines; raises at a rating that is neither up nor down. Long texts are cut, sources to 20."""
    from siftwell.functions.text import truncated

    wrong = entries.filter(~F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"rating must be up or down, not {wrong[0]['rating']!r}")
    cut = entries.withColumns({c: truncated(F.col(c)) for c in ("question", "answer")})
    sources = F.slice(F.transform(F.coalesce("sources", F.array().cast("array<string>")), truncated), 1, 20)
    append_json(cut.withColumn("sources", sources), path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_statutes(statutes: DataFrame, path: str) -> None:
    statutes.write.mode("overwrite").partitionBy("category").json(path)


def save_report(measured: DataFrame, path: str, drop: tuple[str, ...] = ("retrieved",)) -> None:
    """A report without its bulky columns, as one JSON lines file for each partition."""
    measured.drop(*drop).write.mode("overwrite").json(path)


def save_curve(curve: DataFrame, path: str, sample: int, pool: int) -> None:
    """The rows of a threshold sweep, by threshold, as one JSON object {curve, sample, pool}: a row a threshold, so it is small."""
    row = F.struct("threshold", *(c for c in curve.columns if c != "threshold"))
    whole = curve.agg(F.sort_array(F.collect_list(row)).alias("curve"))
    whole.select("curve", F.lit(sample).alias("sample"), F.lit(pool).alias("pool")).write.mode("overwrite").json(path)


def save_feedback_stats(entries: DataFrame, path: str) -> None:
    """Totals of a feedback log and of each mode as one JSON object {total, up, down, satisfaction, by_mode}; modes are few."""
    from siftwell.operators import logs

    known = entries.filter("rating in ('up', 'down')").withColumn("mode", F.coalesce("mode", F.lit("")))
    told = logs.feedback(known)
    counts = ("total", "up", "down", "satisfaction")
    modes = F.sort_array(F.collect_list(F.when(F.col("mode").isNotNull(), F.struct("mode", *counts)))).alias("by_mode")
    sums = [F.coalesce(F.max(F.when(F.col("mode").isNull(), F.col(c))), F.lit(0)).alias(c) for c in counts]
    told.agg(*sums, modes).write.mode("overwrite").json(path)
