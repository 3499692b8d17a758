"""Vectors of texts: a randomised truncated singular value decomposition of the tf-idf table, and a seam for models.

Terms are hashed to FEATURES columns, which bounds all that is kept whole: a basis of FEATURES x RANK numbers. The table
itself stays where it is, a row for each text. A round multiplies it with the basis and with its own transpose; each task
sums up its part of the product by feature, and parts are added by shuffle. The basis is made orthonormal after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.scores import idf
from siftwell.functions.text import tokens
from siftwell.storage import staged

#: Hashed terms, components of a vector, further columns that steady the random start, and rounds of products.
FEATURES, RANK, EXTRA, ROUNDS = 1 << 16, 64, 16, 3


def weighted(docs: DataFrame, key: str = "doc_id", text: str = "text", features: int = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(id, at array<int>, w array<double>) with a row for each text, and (feature, idf).

    w is (1 + ln tf) * idf at the features of the text's terms, in ascending order, scaled to length one. Texts without
    words, null ones too, have empty arrays.
    """
    each = docs.select(F.col(key).alias("id"), F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int")).alias("all"))
    each = staged(each)
    known = each.select(F.explode(F.array_distinct("all")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))
    weights = staged(known.select("feature", idf(F.lit(each.count()), F.col("df")).alias("idf")))
    return _rows(each, weights), weights


def _rows(each: DataFrame, weights: DataFrame) -> DataFrame:
    told = {r["feature"]: r["idf"] for r in weights.collect()}  # at most FEATURES rows
    at = np.array(sorted(told), np.int64)
    held = each.sparkSession.sparkContext.broadcast((at, np.array([told[i] for i in at.tolist()])))
    kind = each.schema["id"].dataType.simpleString()

    def run(batches):
        known, value = held.value
        for batch in batches:
            ids, ws = [], []
            for x in batch.column(1):
                feature, tf = np.unique(x.values.to_numpy(), return_counts=True)
                place = np.searchsorted(known, feature)
                some = known[np.minimum(place, len(known) - 1)] == feature if len(known) else np.zeros(len(feature), bool)
                w = (1 + np.log(tf[some])) * value[place[some]]
                ids.append(feature[some].astype(np.int32))
                ws.append(w / (np.linalg.norm(w) or 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(ws, pa.list_(pa.float64()))], names=["id", "at", "w"])

    return each.mapInArrow(run, f"id {kind}, at array<int>, w array<double>")


def _products(basis, vectors: bool):
    """Row vectors times the basis; without ``vectors`` the transposed table times these, summed up by feature in the task."""

    def run(batches):
        v = basis.value
        total = None if vectors else np.zeros(v.shape)
        for batch in batches:
            at, w = batch.column(1), batch.column(2)
            flat, value = at.flatten().to_numpy(), w.flatten().to_numpy()
            row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
            y = np.zeros((len(at), v.shape[1]))
            for i in range(v.shape[1]):
                y[:, i] = np.bincount(row, value * v[flat, i], len(at))
            if vectors:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "vector"])
            else:
                for i in range(v.shape[1]):
                    total[:, i] += np.bincount(flat, value * y[row, i], len(v))
        if not vectors and (some := np.flatnonzero(total.any(1))).size:
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["feature", "total"])

    return run


def _added(batches):
    """Parts of products summed up by feature; a task holds the features that it has been dealt, each once."""
    place: dict[int, int] = {}
    total = np.zeros((0, 0))
    for batch in batches:
        feature = batch.column(0).to_numpy()
        value = batch.column(1).flatten().to_numpy().reshape(len(feature), -1)
        for f in feature.tolist():
            place.setdefault(f, len(place))
        if len(place) > len(total):
            grown = np.zeros((2 * len(place), value.shape[1]))
            grown[: len(total), : total.shape[1]] = total
            total = grown
        np.add.at(total, [place[f] for f in feature.tolist()], value)
    if place:
        yield pa.RecordBatch.from_arrays([pa.array(list(place)), pa.array(list(total[: len(place)]), pa.list_(pa.float64()))], names=["feature", "total"])


def basis(rows: DataFrame, rank: int = RANK, features: int = FEATURES, rounds: int = ROUNDS, extra: int = EXTRA, seed: int = 7) -> np.ndarray:
    """About the leading ``rank`` right singular vectors (features x rank) of the table ``rows`` (id, at, w).

    The start is random, so the result is that of any run with this seed up to the error of ``rounds`` rounds; columns are
    ordered by singular value and the sign of each makes its largest entry positive.
    """
    spark = rows.sparkSession
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, min(rank + extra, features))))[0]
    size = np.zeros(v.shape[1])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(v)
        parts = rows.mapInArrow(_products(shared, False), "feature long, total array<double>").repartition("feature").mapInArrow(_added, "feature long, total array<double>")
        z = np.zeros(v.shape)
        summed = parts.toArrow()  # at most a row for each feature
        if summed.num_rows:
            z[summed["feature"].to_numpy()] = summed["total"].combine_chunks().flatten().to_numpy().reshape(-1, v.shape[1])
        # the columns of z are A'A times those of v: turned to its own singular directions, ordered by size
        left, size, _ = np.linalg.svd(z, full_matrices=False)
        v = left
        shared.unpersist()
    v = v[:, : min(rank, int((size > 1e-12 * max(size.max(initial=0), 1e-300)).sum()))]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def projected(rows: DataFrame, v: np.ndarray) -> DataFrame:
    """(id, vector): each row of (id, at, w) in the basis, scaled to length one; a row without known terms has zeros."""
    shared = rows.sparkSession.sparkContext.broadcast(v)
    found = rows.mapInArrow(_products(shared, True), f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return found.withColumn("_n", norm).select("id", F.when(F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n"))).otherwise(F.col("vector")).alias("vector"))


class TextVectors:
    """Vectors of any texts in the space of ``docs``."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", rank: int = RANK, features: int = FEATURES):
        rows, self.weights = weighted(docs, key, text, features)
        self.rows, self.features = staged(rows), features
        self.basis = basis(self.rows, rank, features)

    def of_docs(self) -> DataFrame:
        return projected(self.rows, self.basis)

    def of(self, texts: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
        """(id, vector) of other texts; terms that the documents lack have no part."""
        hashed = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(self.features)).cast("int"))
        return projected(_rows(texts.select(F.col(key).alias("id"), hashed.alias("all")), self.weights), self.basis)


def embedded(docs: DataFrame, load: Callable[[], Callable[[list[str]], list]], text: str = "text", out: str = "vector", rows: int = 256) -> DataFrame:
    """``docs`` with ``out``, an array of doubles, from a model: ``load`` gives a function of a list of texts, once for each task.

    The model gets ``rows`` texts at a time, empty ones for null, so a batch of long texts does not grow with the table.
    """
    keep = docs.drop(out)
    at = keep.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]):
        model = None
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                model = model or load()
                made = [np.asarray(x, float) for x in model([t or "" for t in part.column(at).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float64()))], names=[*part.schema.names, out])

    return keep.mapInArrow(run, f"{kinds}, `{out}` array<double>")
