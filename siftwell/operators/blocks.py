"""Inner products of many queries with many vectors in blocks of both, of which only each query's best leave a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones are filled up with zeros."""
    size = vectors.value_lengths().fill_null(0).to_numpy()
    out = np.zeros((len(vectors), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = vectors.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return out


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _meetings(k: int | None, slack: float):
    def run(batches):
        for batch in batches:
            for vectors, queries in zip(batch.column(0), batch.column(1), strict=True):
                x, q = _widened(matrix(vectors.values.field("v")), matrix(queries.values.field("v")))
                score = q @ x.T
                kept = score >= (np.partition(score, -k, 1)[:, -k, None] - slack) if k and k < score.shape[1] else np.ones(score.shape, bool)
                at, row = np.nonzero(kept)
                ids, keys = queries.values.field("id").take(pa.array(at)), vectors.values.field("id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(score[at, row])], names=["query_id", "key", "score"])

    return run


def met(vectors: DataFrame, queries: DataFrame, by: list[str], k: int | None, slack: float) -> DataFrame:
    """(query_id, key, score) of the rows of ``vectors`` (by, id, v) and ``queries`` (by, id, v) that agree in ``by``.

    Each two blocks meet as one row and a task holds one such meeting. With ``k`` a query's scores within ``slack`` of its
    k-th in the meeting are given, so that rounding cannot change which are the best. Null and missing components count as
    zero.
    """
    packed = lambda df, name: df.groupBy(*by).agg(F.collect_list(F.struct("id", "v")).alias(name))
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, vectors)]
    pairs = packed(vectors, "_vectors").join(packed(queries, "_queries"), by)
    return pairs.select("_vectors", "_queries").mapInArrow(_meetings(k, slack), f"query_id {kinds[0]}, key {kinds[1]}, score double")
