"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

A store is: shard files (header, raw little-endian ids in ascending key order, footer), written one by each task under
names that no other attempt uses; a table of entries; a table of shards, which names the files of the attempts that
counted; and a table of index blocks. A block holds the minimal perfect hash of the keys of one hash bucket, cascading bit
arrays with ranks, and for each slot a fingerprint, shard, offset and length, so that a look-up is a few array reads
whatever the store's size.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import BATCH_BYTES, by_bytes, caches, mix, scratch, staged

MAGIC = b"SIFTTOK1"
#: Magic, bytes of an id, zero; documents, ids, magic.
HEADER, FOOTER = "<8sII", "<QQ8s"
HEADER_SIZE, FOOTER_SIZE = struct.calcsize(HEADER), struct.calcsize(FOOTER)
#: Keys in an index block on average, bytes of text in a shard on average (its ids take about three quarters of that).
BLOCK_KEYS, SHARD_BYTES = 50_000, 64 << 20
#: Bits of each cascade level for each key that reaches it; keys that are looked up by reading their blocks alone.
GAMMA, FEW = 2.0, 1000
#: Words at which a worker's cache starts afresh with the next batch. It bounds memory and changes no result.
CACHE_WORDS = 500_000


class WordEncoder:
    """The tokenizers library behind a cache of words, with texts split and put together in Arrow.

    The tokenizer drops white space and no token or normalisation crosses it, so the ids of a text are those of its
    chunks between ASCII white space; nor does any cross from a letter or digit to ASCII punctuation other than the
    apostrophe, so a chunk is two words, its closing punctuation being the second. Each different word is encoded once.
    """

    TAIL = ".,;:!?)]}\"%&*#$|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """``rows``: the row of each word in ``table``, whose lists of ids have the lengths ``length``."""
        self.rows: dict[str, int] = {"": 0}
        self.table = pa.array([[]], pa.large_list(pa.uint16() if self.kind == "<u2" else pa.uint32()))
        self.length = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of letters go together as one text, cut where a token closes a word; should the count differ, and other words, one by one."""
        plain, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        names, ids, length = [], [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            made = self._ids([" ".join(part)])[0]
            ends = np.flatnonzero(self.closing[made]) + 1
            if len(ends) == len(part) and ends[-1] == len(made):
                names += part
                ids.append(made)
                length.append(np.diff(ends, prepend=0))
            else:
                others += part
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            made = self._ids(part)
            names += part
            ids += made
            length.append(np.array([len(x) for x in made], np.int64))
        length = np.concatenate(length)
        new = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(length)), pa.array(np.concatenate(ids)))
        self.rows.update(zip(names, range(len(self.length), len(self.length) + len(names)), strict=True))
        self.table, self.length = pa.concat_arrays([self.table, new]), np.append(self.length, length)

    def _cut(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each chunk up to its last letter or digit, if only TAIL follows (else all of it), and what follows."""
        core = pc.ascii_rtrim(chunks, self.TAIL)
        last = pc.utf8_slice_codeunits(core, -1, None).dictionary_encode()
        sharp = np.array([c.isalnum() and len(c.lower()) == 1 for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        begin = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, 4 * chunks.offset)
        size = pc.binary_length(core).to_numpy()
        rest = np.where(sharp, np.diff(begin) - size, 0)
        edge = np.append(0, np.cumsum(rest))
        at = np.repeat(begin[:-1] + size - edge[:-1], rest) + np.arange(edge[-1])
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[at]
        tail = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data))
        return pc.if_else(pa.array(sharp), core, chunks), tail

    def _rows(self, chunks: pa.Array) -> np.ndarray:
        """The rows of the two words of each chunk."""
        if not len(chunks):
            return np.zeros((0, 2), np.int64)
        core, tail = self._cut(chunks)
        core = pc.ascii_lower(core)  # the tokenizer lowers all letters anyway
        words = pa.concat_arrays([core, tail]).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        if fresh := [w for w in names if w not in self.rows]:
            self._learn(fresh)
        row = np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))
        return row[words.indices.to_numpy()].reshape(2, -1).T

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) end to end, and the number of each text's."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        row = self._rows(flat.dictionary)[flat.indices.to_numpy()]
        total = np.append(0, np.cumsum(self.length[row].sum(1)))
        bound = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        return self.table.take(pa.array(row.ravel())).flatten().to_numpy(), np.diff(total[bound])


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class PerfectHash:
    """A minimal perfect hash over distinct pairs of 64-bit hashes: level after level, each key that alone hits its bit stays.

    A level is a bit array in bytes; the rank of a bit is the count of bits before its 64-byte group, and those within it.
    """

    GROUP = 64

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        self.before, base = [], 0
        for level in bits:
            ones = np.bitwise_count(level).astype(np.int64)
            groups = np.add.reduceat(ones, np.arange(0, len(ones), self.GROUP))
            self.before.append(np.cumsum(groups) - groups + base)
            base += int(groups.sum())

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            both = mix(hashes[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) + hashes[:, 1]
        return (mix(both) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes``: two words a key. Keys that agree in one word are kept apart by the other."""
        sizes: list[int] = []
        bits: list[np.ndarray] = []
        while len(hashes):
            if len(sizes) == 200:
                raise ValueError("keys have equal 128-bit hashes")
            size = max(8, int(GAMMA * len(hashes)))
            at = cls._at(hashes, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            hashes = hashes[~alone[at]]
        return cls(sizes, bits)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Bits set before place ``at``: whole groups, and the bytes of its own group up to it."""
        bits, byte = self.bits[level], at >> 3
        group = byte // self.GROUP
        within = group[:, None] * self.GROUP + np.arange(self.GROUP)
        ones = np.bitwise_count(bits[np.minimum(within, len(bits) - 1)]) * (within < byte[:, None])
        last = np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))
        return self.before[level][group] + ones.sum(1) + last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots; -1 for hashes that no level holds. A hash that was not built in may get any slot."""
        slot = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        for n, size in enumerate(self.sizes):
            at = self._at(hashes[left], n, size)
            hit = (self.bits[n][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            slot[left[hit]] = self._rank(n, at[hit])
            left = left[~hit]
        return slot


def pack_block(hashes: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """An index block: level sizes and bits, then for each slot fingerprint, shard, offset and length."""
    mph = PerfectHash.build(hashes)
    order = np.argsort(mph.find(hashes))
    head = struct.pack("<II", len(hashes), len(mph.sizes)) + np.array(mph.sizes, "<u4").tobytes()
    bits = b"".join(x.tobytes() for x in mph.bits)
    prints = hashes[order, 1].astype("<u4")
    return head + bits + prints.tobytes() + shard[order].astype("<u4").tobytes() + offset[order].astype("<u8").tobytes() + length[order].astype("<u4").tobytes()


@dataclass
class Block:
    mph: PerfectHash
    prints: np.ndarray
    shard: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        """The arrays are views of ``data``."""
        n, depth = struct.unpack_from("<II", data)
        sizes = np.frombuffer(data, "<u4", depth, 8).tolist()
        at, levels = 8 + 4 * depth, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, -(-size // 8), at))
            at += -(-size // 8)
        parts = []
        for kind, width in (("<u4", 4), ("<u4", 4), ("<u8", 8), ("<u4", 4)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += width * n
        return cls(PerfectHash(sizes, levels), *parts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for keys that are not there (a wrong slot passes with a chance of 2 ** -32)."""
        slot = self.mph.find(hashes)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == hashes[there, 1].astype(np.uint32)
        return np.where(there, slot, -1)


def _words(rows: pd.DataFrame) -> np.ndarray:
    return np.stack([rows["hash"].to_numpy(), rows["check"].to_numpy()], 1).view(np.uint64)


@dataclass
class TokenStore:
    """A written store. ``shards`` (shard, file, before): for each shard its file and the ids before it."""

    path: str
    kind: str
    entries: DataFrame
    blocks: DataFrame
    n_blocks: int
    shards: DataFrame
    n_shards: int

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, copy, shard, offset, length) for those of ``keys`` (key, copy) that the store has.

        For at most FEW blocks only these are read (the table is sorted by block, so other row groups are skipped).
        """
        out = f"key {self.entries.schema['key'].dataType.simpleString()}, copy long, shard int, offset long, length long"

        def find(blocks: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks) or not len(wanted):
                return pd.DataFrame({x: [] for x in ("key", "copy", "shard", "offset", "length")})
            block = Block.unpack(blocks["data"].iloc[0])
            slot = block.find(_words(wanted))
            there = slot >= 0
            slot = slot[there]
            found = wanted[there][["key", "copy"]].reset_index(drop=True)
            return found.assign(shard=block.shard[slot].astype(np.int32), offset=block.offset[slot].astype(np.int64), length=block.length[slot].astype(np.int64))

        wanted = keys.select("key", "copy", *_hashes()).withColumn("block", _block(self.n_blocks))
        blocks = self.blocks
        if self.n_blocks > 1:
            touched = [r["block"] for r in wanted.select("block").distinct().limit(FEW + 1).collect()]
            if len(touched) <= FEW:
                blocks = blocks.filter(F.col("block").isin(touched))
        return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(find, out)

    def read(self, found: DataFrame) -> DataFrame:
        """``found`` (key, shard, offset, length, ...) with ids (binary, little-endian uint32) and start, read from the shards."""
        root, kind, width, columns = self.path, self.kind, int(self.kind[-1]), found.columns
        schema = pa.schema([("start", pa.int64()), ("ids", pa.binary())])

        def run(batches):
            name, source = None, None
            for batch in batches:
                starts, ids = [], []
                for file, before, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "before", "offset", "length")), strict=True):
                    if file != name:
                        name, source = file, open_shard(f"{root}/{file}")
                    raw = source.read_at(length * width, HEADER_SIZE + offset * width)
                    ids.append(np.frombuffer(raw, kind).astype("<u4").tobytes())
                    starts.append(before + offset)
                added = pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *added.columns], names=[*columns, *schema.names])

        plan = found.join(self.shards, "shard").repartition(max(1, 4 * self.n_shards), "shard", F.floor(F.col("offset") / (SHARD_BYTES // 4 // width))).sortWithinPartitions("shard", "offset")
        return plan.mapInArrow(run, f"{_ddl(found)}, start long, ids binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _hashes():
    """Two 64-bit hashes of a (key, copy)."""
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    return F.xxhash64(name, "copy").alias("hash"), F.xxhash64(F.lit("check"), name, "copy").alias("check")


def _block(n: int):
    return F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int")


def open_shard(uri: str):
    """A shard for reading at any place, after checking header and footer."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    source = fs.open_input_file(path)
    magic, width, _ = struct.unpack(HEADER, source.read_at(HEADER_SIZE, 0))
    _, n_ids, end = struct.unpack(FOOTER, source.read_at(FOOTER_SIZE, source.size() - FOOTER_SIZE))
    if magic != MAGIC or end != MAGIC or HEADER_SIZE + n_ids * width + FOOTER_SIZE != source.size():
        raise ValueError(f"{uri} is not a whole shard")
    return source


def write(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> TokenStore:
    """Encode every text, append ``end_id`` to each and write the store, in ascending order of the key.

    A null text counts as empty; a null key sorts first and is a key of its own. Rows with the same key are copies 0, 1,
    ... in the order of a hash of their text; equal rows are so many copies. ``path`` must be a folder that driver and
    executors share (by default under spark.checkpoint.dir). Texts are sorted by range, so that a task encodes and writes
    one shard, of SHARD_BYTES of text on average; rows of equal key and text, however many, may be split, as their place in
    ``docs`` (a table of files, whose order is fixed) tells them apart.
    """
    path = path or scratch(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = _encoder(tokenizer).kind
    width = int(kind[-1])

    told = slim.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, n_shards = told["n"], max(1, -(-(told["bytes"] or 0) // SHARD_BYTES))
    key_kind = slim.schema["key"].dataType.simpleString()

    def run(batches):
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root)
        encoder, sink, docs_in, at = _encoder(tokenizer), None, 0, 0
        caches("token_store")
        caches(f"token_store {tokenizer}", encoder.clear)
        for batch in (part for whole in batches if whole.num_rows for part in by_bytes(whole, 1, BATCH_BYTES)):
            if sink is None:
                sink = fs.open_output_stream(f"{root}/{name}")
                sink.write(struct.pack(HEADER, MAGIC, width, 0))
            ids, counts = encoder.encode_all(batch.column(1))
            sink.write(np.insert(ids, np.cumsum(counts), end_id).astype(kind).tobytes())
            length = counts + 1
            offset = at + np.cumsum(length) - length
            docs_in, at = docs_in + len(length), at + int(length.sum())
            m = len(length)
            made = [batch.column(0), pa.array([shard] * m, pa.int32()), pa.array([name] * m), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["key", "shard", "file", "offset", "length"])
        if sink is not None:
            sink.write(struct.pack(FOOTER, docs_in, at, MAGIC))
            sink.close()

    placed = slim.withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(n_shards, "key", "th", "place").sortWithinPartitions("key", "th", "place").select("key", "text")
    entries = staged(ordered.mapInArrow(run, f"key {key_kind}, shard int, file string, offset long, length long"))
    per_shard = entries.groupBy("shard").agg(F.first("file").alias("file"), F.sum("length").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = staged(per_shard.select("shard", "file", before.alias("before")))  # a row for each 64 MB of text
    entries = _with_copies(entries.drop("file"))
    n_blocks = max(1, -(-n // BLOCK_KEYS))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        data = pack_block(_words(rows), rows["shard"].to_numpy(), rows["offset"].to_numpy(), rows["length"].to_numpy())
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [data]})

    slots = entries.select(*_hashes(), "shard", "offset", "length").withColumn("block", _block(n_blocks))
    blocks = staged(slots.groupBy("block").applyInPandas(pack, "block int, data binary").sortWithinPartitions("block"))
    return TokenStore(path, kind, entries, blocks, n_blocks, shards, n_shards)


def _with_copies(entries: DataFrame) -> DataFrame:
    """``entries`` with ``copy``, the number of each row among those of its key, in the order of shard and offset.

    A key's rows of one shard are numbered there, and those of earlier shards are added: no key has all its rows in a task.
    """
    counts = entries.groupBy("key", "shard").agg(F.count("*").alias("rows"))
    repeated = counts.groupBy("key").agg(F.sum("rows").alias("all")).filter("all > 1").select(F.col("key").alias("again"))
    same = F.col("key").eqNullSafe(F.col("again"))
    many = staged(counts.join(repeated, same, "left_semi"))
    if many.isEmpty():
        return entries.withColumn("copy", F.lit(0).cast("long"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = many.select(F.col("key").alias("again"), F.col("shard").alias("there"), earlier.alias("base"))
    joined = entries.join(base, same & (F.col("shard") == F.col("there")), "left")
    own = F.row_number().over(Window.partitionBy("key", "shard").orderBy("offset")) - 1
    twice = joined.filter("base is not null").withColumn("copy", F.col("base") + own)
    once = joined.filter("base is null").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(twice).select("key", "shard", "offset", "length", "copy")


def all_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, copy) of every row: the keys to look the whole table up by."""
    counted = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
