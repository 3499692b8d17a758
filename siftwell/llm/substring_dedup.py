"""Removal of repeated passages by hashing sentences and lines.

A unit is a run of words up to a full stop, exclamation mark, question mark or line end; its digest covers its words in
lower case, so case, punctuation and spacing don't count. Digests are grouped over all documents, the earliest occurrence
(by key, then position) is kept, and consecutive other units that together have enough words are a repeated passage. It
is reported with its offsets in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.llm.shared import GOLDEN, char_tables, code_points, heavy_join, mix, packed, powers, staged, steps, unpacked

#: Words that a repeated passage must have; a passage of 50 loses at most its first unit to the text before it.
MIN_WORDS = 25
STOPS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def units(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Units of all texts: row, unit (its number in the text), start, stop (characters), words and the two digests.

    A unit starts at its first word (the first one at 0) and stops where the next starts or the text ends.
    """
    given = [t or "" for t in texts]
    parts = []
    is_word, lower = char_tables()
    for first, end in steps(given):
        some = given[first:end]
        cp = code_points("\n".join(some) + "\n")
        lengths = np.array([len(t) + 1 for t in some])
        begins = np.cumsum(lengths) - lengths
        inside = is_word[cp]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        size = np.diff(head, append=len(at))
        pos = np.arange(len(at)) - np.repeat(head, size)
        with np.errstate(over="ignore"):
            value = mix(lower[cp[at]].astype(np.uint64) + GOLDEN)
            words = mix(np.add.reduceat(value * powers(1 << int(pos.max()).bit_length() or 1)[pos], head) + size.astype(np.uint64))
            start = at[head]
            stops = np.cumsum(np.isin(cp, STOPS))[start]
            opens = np.flatnonzero(np.diff(stops, prepend=-1))
            count = np.diff(opens, append=len(words))
            place = np.arange(len(words)) - np.repeat(opens, count)
            summed = np.add.reduceat(words * powers(1 << int(place.max()).bit_length() or 1)[place], opens)
            digest = mix(summed + count.astype(np.uint64))
            check = np.bitwise_xor.reduceat(mix(words + place.astype(np.uint64) * GOLDEN), opens)
        start = start[opens]
        row = np.searchsorted(begins, start, side="right") - 1
        new = np.diff(row, prepend=-1) > 0
        number = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        stop = np.append(start[1:], 0)
        last = np.append(new[1:], True)
        stop[last] = (begins + lengths - 1)[row[last]]
        start = np.where(new, begins[row], start)
        parts.append((row + first, number, start - begins[row], stop - begins[row], count, digest.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    names = ("row", "unit", "start", "stop", "words", "digest", "check")
    if not parts:
        return {n: np.zeros(0, np.int64) for n in names}
    return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kinds = {"unit": T.IntegerType(), "start": T.IntegerType(), "stop": T.IntegerType(), "words": T.IntegerType(), "digest": T.LongType(), "check": T.IntegerType()}
    schema = T.StructType([*slim.schema.fields[:2], *(T.StructField(n, k) for n, k in kinds.items())])

    def run(batches):
        for batch in batches:
            made = units(batch.column(2).to_pylist())
            take = pa.array(made["row"])
            columns = [batch.column(i).take(take) for i in (0, 1)]
            columns += [pa.array(made[n].astype(np.int64 if n == "digest" else np.int32), to_arrow_type(k)) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, start, stop, n_words, first_key): passages that repeat an earlier one, by the text's key and hash.

    Offsets are in characters (code points) of the original text, ``stop`` exclusive; first_key is the document that
    keeps the passage's first unit. Null and empty texts have no units; a null key ranks last; rows with equal key and
    text are one document. A unit that a large share of documents holds is counted before it is shuffled and joined by
    broadcast (fewer than 1,000 units can have a thousandth of all occurrences).
    """
    found = staged(_occurrences(docs, key, text))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "th", "unit")
    firsts = staged(found.groupBy("digest", "check").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    again = heavy_join(found, firsts, ["digest", "check"], "n", found.count())
    again = again.filter(~rank.eqNullSafe(F.col("first"))).select("key", "th", "unit", "start", "stop", "words", F.col("first.key").alias("first_key"))
    own = Window.partitionBy("key", "th").orderBy("unit")
    runs = again.dropDuplicates(["key", "th", "unit"]).withColumn("run", F.col("unit") - F.row_number().over(own))
    passages = runs.groupBy("key", "th", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min_by("first_key", "unit").alias("first_key")
    )
    return passages.filter(F.col("n_words") >= min_words).select("key", "th", "start", "stop", "n_words", "first_key")


def remove(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the text and ``removed``, an array of their (start, stop) in the original.

    With ``min_words`` of 1 every repeated line and sentence goes. Null and empty texts stay as they are; a null key ranks
    last, ties go by the hash of the text, rows with equal key and text are one document and are cut alike. A column
    ``removed`` is replaced. An empty table gives none.
    """
    spans = repeated(docs, min_words, key, text).groupBy("key", "th").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    spans = spans.select(F.struct("key", "th").alias("row"), "removed")
    keep = docs.drop("removed")
    rows = packed(keep, row=F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("th"))).join(spans, "row", "left")
    whole = F.col("doc")[text]
    edges = F.concat(F.array(F.lit(0)), F.col("removed.stop")), F.concat(F.col("removed.start"), F.array(F.length(whole)))
    left = F.array_join(F.zip_with(*edges, lambda a, b: F.substring(whole, a + 1, b - a)), "")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    cut = {text: F.when(F.col("removed").isNull(), whole).otherwise(left), "removed": F.coalesce("removed", none)}
    return unpacked(rows, [*keep.columns, "removed"], **cut)
