"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits has a non-zero vector of RADIUS + 1 bits; each non-zero vector v of that size makes a mask, the bits
whose vectors have an odd inner product with v. The vectors of RADIUS differing bits do not span the space, so some v is
orthogonal to all of them: its mask leaves these bits out, and the pair collides in its table. So every pair within the
radius meets in one of 2 ** (RADIUS + 1) - 1 tables, each with about half of the bits as its key.

Buckets of at most LIMIT fingerprints are searched for the components of their links. In a larger bucket no pairs are
formed: fingerprints differ in half the radius from a common point exactly if they link, so each tells all points that
near, within the bits that the mask leaves open, and those of one point are linked to its least.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import components
from siftwell.llm.shared import caches, heavy_join, staged

RADIUS, WORDS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared with each other.
LIMIT = 4096
#: Bytes of a text whose shingles are hashed together.
STEP_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the tables, as unsigned 64-bit integers; bit i has the vector i % (2 ** (radius + 1) - 1) + 1."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if bin((i % n + 1) & v).count("1") & 1) for v in range(1, n + 1)]


def _pieces(text: bytes):
    """The text in stretches of about STEP_BYTES that end between words."""
    first = 0
    while first < len(text):
        space = SPACE.search(text, first + STEP_BYTES)
        stop = space.start() if space else len(text)
        yield text[first:stop]
        first = stop


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text's word shingles, unsigned; zero without a word."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or b"").lower()):
        words = carried + piece.split()
        if len(words) >= WORDS:
            joined = b" ".join(words)
            stops = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], stops[:-1] + 1])
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - WORDS + 1].tolist(), stops[WORDS - 1 :].tolist(), strict=True)]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            n += len(hashes)
        carried = words[1 - WORDS :] if len(words) >= WORDS else words
    if not n and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row, fp as a signed long. Null, empty and blank texts have the fingerprint zero."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        caches("simhash")
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["key", "fp"])

    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, fp long")


def linked(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links of distinct ``values`` join: each value is compared with those not reached so far."""
    left, right, waiting = [], [], values
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            own, front = front[0], front[1:]
            near = np.bitwise_count(waiting ^ own) <= radius
            found = waiting[near]
            left.append(np.full(len(found), own))
            right.append(found)
            front, waiting = np.concatenate([front, found]), waiting[~near]
    none = np.zeros(0, values.dtype)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def _bucket_edges(batches):
    for batch in batches:
        made = [linked(np.sort(v.values.to_numpy()).view(np.uint64)) for v in batch.column(0)]
        u, v = (np.concatenate([*(m[i] for m in made), np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _points(radius: int):
    """The points within half the radius of a fingerprint, by flipping bits that its table's mask leaves open."""
    open_bits = [[1 << i for i in range(64) if not m >> i & 1] for m in masks(radius)]
    flips = [np.array([0] + [sum(c) for k in range(1, radius // 2 + 1) for c in combinations(bits, k)], np.uint64).view(np.int64) for bits in open_bits]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp, table = part.column(0).to_numpy(), part.column(1).to_numpy()
                sets = [flips[t] for t in table]
                point = np.concatenate([f ^ s for f, s in zip(fp, sets, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, [len(s) for s in sets])), pa.array(point)], names=["fp", "point"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges between the fingerprints of ``distinct`` (fp) whose components are those of all pairs within an even ``radius``."""
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")) for m in masks(radius)))).alias("table", "bucket"))
    sized = staged(keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    met = staged(heavy_join(keyed, sized, ["bucket", "table"], "n", distinct.count() * len(masks(radius))))
    small = met.filter(F.col("n") <= LIMIT).groupBy("table", "bucket").agg(F.collect_list("fp").alias("fps"))
    edges = small.select("fps").mapInArrow(_bucket_edges, "u long, v long")
    if sized.filter(F.col("n") > LIMIT).isEmpty():
        return edges
    pointed = staged(met.filter(F.col("n") > LIMIT).select("fp", "table").mapInArrow(_points(radius), "fp long, point long").distinct())
    least = staged(pointed.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    far = heavy_join(pointed, least, ["point"], "n", pointed.count()).filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return edges.unionByName(far.distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id, n_copies) of every row of ``docs``.

    Fingerprints of 16 hexadecimal digits link at ``radius`` (even) or fewer differing bits; component_id is the least key that
    links reach, null where all these keys are null; n_copies counts the rows with this fingerprint. Texts without a word,
    null and empty ones too, have the fingerprint zero and link like any other. Repeated rows each have their row; an empty
    table gives none. Rows with one fingerprint, however many, are counted before anything is joined and then served by
    ``heavy_join``.
    """
    rows = staged(fingerprints(docs, key, text))
    held = staged(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    roots = components.components(staged(links(held.select("fp"), radius)))
    named = staged(held.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    known = staged(heavy_join(named, groups, ["root"], "m", named.count()).select("fp", "n", "component_id"))
    found = heavy_join(rows, known, ["fp"], "n", rows.count())
    return found.select("key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_copies"))
