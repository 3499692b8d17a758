"""What the corpus operators share: staged tables, heavy-key joins and vectorised word hashing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Characters that one vectorised step takes together, unless a single text is longer.
STEP_CHARS = 1_000_000
#: Bytes of text that a worker turns to other columns together, unless a single text is longer.
BATCH_BYTES = 8_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing a folder under /tmp serves local masters only; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/siftwell-{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later use neither repeats the work nor keeps its lineage."""
    path = scratch(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return found


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Deletes at its end what was staged within it, but for the tables given to the function that it yields.

    Those must be staged tables; they belong to the surrounding block, if there is one.
    """
    paths: list[str] = []
    kept: set[str] = set()
    _TEMPORARY.append(paths)
    try:
        yield lambda *tables: kept.update(t.staged_at for t in tables)
    finally:
        _TEMPORARY.pop()
        if _TEMPORARY:
            _TEMPORARY[-1].extend(kept)
        for path in [p for p in paths if p not in kept]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **beside) -> DataFrame:
    """``docs`` as one struct column ``doc`` with the columns ``beside``, so that no name of theirs can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), *(v.alias(k) for k, v in beside.items()))


def unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The ``columns`` of ``doc``, some replaced by the expressions ``changed``."""
    return rows.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in columns))


def by_bytes(batch: pa.RecordBatch, at: int, limit: int):
    """Slices of a batch with about ``limit`` bytes of the text column ``at`` each; texts are never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1, append=-2)).tolist()
    for first, end in zip(edges, edges[1:], strict=False):
        yield batch.slice(first, end - first)


#: What clears each operator's caches in this worker process.
_CACHES: dict[str, object] = {}


def caches(owner: str, clear=None) -> None:
    """Tell how to clear an operator's caches, and clear those of all others: a worker that is used again holds one operator's."""
    for name in [x for x in _CACHES if not owner or not x.startswith(owner)]:
        _CACHES.pop(name)()
    if clear:
        _CACHES[owner] = clear


def with_text_columns(docs: DataFrame, text: str, added: dict[str, str], make, keep_text: bool = True, owner: str = "") -> DataFrame:
    """``docs`` with the columns ``added`` (name: type), replacing any of those names; other columns pass untouched.

    ``make`` gets some texts (None for null) and returns the new columns in order, each as long; it is called anew for every BATCH_BYTES of text, which bounds memory. A task first clears the caches that other
    operators than ``owner`` left in its worker.
    """
    keep = docs.drop(*added)
    kinds = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added.items()]
    schema = T.StructType([f for f in keep.schema.fields if keep_text or f.name != text] + kinds)
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in kinds]
    at = keep.columns.index(text)

    def run(batches):
        caches(owner)
        for batch in (part for whole in batches if whole.num_rows for part in by_bytes(whole, at, BATCH_BYTES)):
            made = make(batch.column(at).to_pylist())
            columns = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if keep_text or i != at]
            columns += [(n, pa.array(x, kind, from_pandas=True)) for (n, kind), x in zip(arrow, made, strict=True)]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return keep.mapInArrow(run, schema)


def heavy_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row for each key, ``count`` = its rows) that no frequent key can skew.

    Keys with more than ``total / share`` rows number fewer than ``share``, so they are broadcast; the others shuffle, and
    rows that the broadcast has served go along under a hash of all their columns, so they are spread evenly, and alike
    when a task runs again. ``rows`` is read once.
    """
    limit = max(1, total // share)
    payload = [c for c in keyed.columns if c not in keys]
    heavy = keyed.filter(F.col(count) > limit).select(*keys, F.struct(*payload).alias("_heavy"))
    light = keyed.filter(F.col(count) <= limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*payload).alias("_light"))
    served = rows.join(F.broadcast(heavy), keys, "left")
    spread = F.when(F.col("_heavy").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*rows.columns))
    match = [F.col("_at") == F.col(f"_{keys[0]}"), *(F.col(k) == F.col(f"_{k}") for k in keys[1:]), F.col("_heavy").isNull()]
    joined = served.withColumn("_at", spread).join(light, match, "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return joined.filter("_found is not null").select(*rows.columns, "_found.*")


@lru_cache(1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter or digit, and its lower-case code point (itself if that is longer)."""
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return word, lower


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def steps(texts: list[str], limit: int = STEP_CHARS):
    """(first, end) slices of ``texts`` with about ``limit`` characters each; texts are never cut."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


@lru_cache(4)
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, GOLDEN | np.uint64(1), np.uint64)]))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of letters and digits) of all texts, and len(texts) + 1 bounds."""
    is_word, lower = char_tables()
    cp = code_points("\n".join(texts) + "\n")
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = is_word[cp]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    pos = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = mix(lower[cp[at]].astype(np.uint64) + GOLDEN)
        sums = np.add.reduceat(value * powers(1 << int(pos.max()).bit_length() or 1)[pos], first)
        hashes = mix(sums + length.astype(np.uint64))
    bounds = np.searchsorted(at[first], ends)
    return hashes, np.concatenate([[0], bounds])
