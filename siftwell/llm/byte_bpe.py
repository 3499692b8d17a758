"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merge candidates of a pre-token wait in one bucket for each merge rank; a two-level bitmap over the ranks gives the next
rank by find-first-set. Buckets hold positions of a linked list of tokens; an entry whose pair has changed since is stale
and skipped. The cost of a pre-token is linear in its length but for the bucket order, so very long pre-tokens are safe.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import caches, steps, with_text_columns

#: Entries at which a worker's two caches start afresh before the next batch. It bounds memory and changes no result.
CACHE_ENTRIES = 400_000
#: Characters of texts whose new pre-tokens are merged together.
BATCH_CHARS = 16_000_000
#: Pieces of at most so many characters are merged together and kept; longer ones are merged one by one.
SHORT = 64
LEAF_BITS = 8


class RankBpe:
    """Encoder and decoder for a vocabulary of byte strings with ranks (ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        size = max(ranks.values()) + 1
        self.buckets: list[list[int] | None] = [None] * size
        self.leaf = [0] * ((size >> LEAF_BITS) + 1)
        self.byte_array = np.array(self.byte)
        self.pair_keys = np.array(sorted(self.pair))
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()])
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> RankBpe:
        """``path``: lines of a base64 token and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token: always the least rank first, at equal ranks the leftmost pair."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        token = [self.byte[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair, buckets, leaf, top = self.pair.get, self.buckets, self.leaf, 0
        for i in range(n - 1):
            if (r := pair(token[i] << 32 | token[i + 1])) is not None:
                if (b := buckets[r]) is None:
                    buckets[r] = [i]
                    leaf[r >> LEAF_BITS] |= 1 << (r & 255)
                    top |= 1 << (r >> LEAF_BITS)
                else:
                    b.append(i)  # ascending, so a heap
        while top:
            high = (top & -top).bit_length() - 1
            r = high << LEAF_BITS | (leaf[high] & -leaf[high]).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                buckets[r] = None
                leaf[high] &= leaf[high] - 1
                if not leaf[high]:
                    top &= top - 1
            j = after[i]
            if token[i] < 0 or j >= n or pair(token[i] << 32 | token[j]) != r:
                continue  # stale
            k = after[j]
            token[i], token[j], after[i] = r, -1, k
            h = before[i]
            if k < n:
                before[k] = i
            for at, left, right in ((h, h, i), (i, i, k)):
                if left >= 0 and right < n and (s := pair(token[left] << 32 | token[right])) is not None:
                    if (b := buckets[s]) is None:
                        buckets[s] = [at]
                        leaf[s >> LEAF_BITS] |= 1 << (s & 255)
                        top |= 1 << (s >> LEAF_BITS)
                    else:
                        heappush(b, at)
        return [t for t in token if t >= 0]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge`` for many short pre-tokens at once: one queue holds the positions of all of them.

        Words don't touch each other, and the least rank of all is the least of each word that has it, so each round
        merges the leftmost pair of that rank in every such word; further ones of the same word wait for another round.
        """
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        token = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first + size - 1], before[first] = -1, -1
        left = np.flatnonzero(after >= 0)
        rank = np.full(n, -1)
        rank[left] = self._ranks(token[left], token[left + 1])
        buckets: dict[int, list] = {}
        leaf, top = [0] * len(self.leaf), 0

        def put(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            if len(at) > 24:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cut = np.flatnonzero(np.diff(ranks, prepend=-1))
                pairs = zip(ranks[cut].tolist(), np.split(at, cut[1:]), strict=True)
            else:
                pairs = zip(ranks.tolist(), at[:, None], strict=True)
            for r, x in pairs:
                if r in buckets:
                    buckets[r].append(x)
                else:
                    buckets[r] = [x]
                    leaf[r >> LEAF_BITS] |= 1 << (r & 255)
                    top |= 1 << (r >> LEAF_BITS)

        have = np.flatnonzero(rank >= 0)
        put(have, rank[have])
        while top:
            high = (top & -top).bit_length() - 1
            r = high << LEAF_BITS | (leaf[high] & -leaf[high]).bit_length() - 1
            waiting = buckets.pop(r)
            leaf[high] &= leaf[high] - 1
            if not leaf[high]:
                top &= top - 1
            i = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            i = i[rank[i] == r]  # the others are stale
            if len(i) > 1:
                i = np.unique(i)
                later = np.diff(word[i], prepend=-1) == 0
                if later.any():
                    put(i[later], np.full(int(later.sum()), r))
                    i = i[~later]
            elif not len(i):
                continue
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = r, -1, k
            rank[i], rank[j] = -1, -1
            on = k >= 0
            before[k[on]] = i[on]
            h = before[i]
            at = np.concatenate([h[h >= 0], i[on]])
            rank[at] = s = self._ranks(token[at], token[after[at]])
            put(at[s >= 0], s[s >= 0])
        for x, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:  # a whole token wins even where merges don't reach it
                token[first[x]], token[first[x] + 1 : first[x] + size[x]] = whole, -1
        alive = token >= 0
        ids = token[alive].astype("<u4")
        return np.split(ids, np.cumsum(np.add.reduceat(alive, first))[:-1])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            return np.array(self.merge(word.encode()), "<u4").tobytes()
        return ids

    def _learn(self, texts: list[str]) -> None:
        """Fill the caches with all short pieces of ``texts``."""
        unseen: set[str] = set()
        for text in texts:
            if not _ODD_SPACE.search(text):
                first, *rest = text.split(" ")
                unseen.update(x for x in [first, *[" " + x for x in rest]] if x not in self.pieces)
        cut = {x: self.split.findall(x) for x in unseen if 0 < len(x) <= SHORT}
        fresh = [w for w in {w for x in cut.values() for w in x} if w not in self.words]
        for at in range(0, len(fresh), 400_000):
            part = fresh[at : at + 400_000]
            for w, ids in zip(part, self.merge_many([w.encode() for w in part]), strict=True):
                self.words[w] = ids.tobytes()
        for x, words in cut.items():
            self.pieces[x] = b"".join(map(self.words.__getitem__, words))

    def _encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return b"".join(map(self._word, self.split.findall(text)))
        first, *rest = text.split(" ")
        known = self.pieces.get
        return b"".join([known(x) or b"".join(map(self._word, self.split.findall(x))) for x in [first, *[" " + x for x in rest]]])

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        The pattern never matches a space after a non-space, so a text whose spaces stand alone between non-spaces may
        be cut before each space and the pieces looked up; any other text is split by the pattern as a whole.
        """
        given = [t or "" for t in texts]
        for first, end in steps(given, BATCH_CHARS):
            if len(self.pieces) > CACHE_ENTRIES or len(self.words) > CACHE_ENTRIES:
                self.clear()
            self._learn(given[first:end])
            yield from map(self._encode, given[first:end])

    def clear(self) -> None:
        self.pieces.clear()
        self.words.clear()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: A space beside another white space or at an end of the text.
_ODD_SPACE = re.compile(r" \s|\s |\A | \Z")


@lru_cache(2)
def _loaded(path: str, pattern: str) -> RankBpe:
    return RankBpe.load(path, pattern)


def _ready(path: str, pattern: str) -> RankBpe:
    bpe = _loaded(path, pattern)
    caches(f"byte_bpe {path} {pattern}", bpe.clear)
    return bpe


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian uint32) and, unless None, ``decoded`` (binary, from those ids).

    Null and empty texts give no ids. Existing columns of those names are replaced; all others stay as they are.
    ``path`` must be readable on every executor, as an installed vocabulary file is.
    """
    added = {ids: "binary"} | ({decoded: "binary"} if decoded else {})

    def make(texts: list[str | None]):
        bpe = _ready(path, pattern)
        out = list(bpe.encode_all(texts))
        return [out, [bpe.decode(x) for x in out]] if decoded else [out]

    return with_text_columns(docs, text, added, make, keep_text, owner="byte_bpe")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` gives, made in the same pass.

    One row for each of ``docs``, repeated and null keys too; null and empty texts have the digests of nothing. An empty
    table gives none.
    """

    def make(texts: list[str | None]):
        bpe = _ready(path, pattern)
        made = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x)).hexdigest()) for x in bpe.encode_all(texts)]
        return list(zip(*made, strict=True))

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return with_text_columns(docs.select(key, text), text, added, make, keep_text=False, owner="byte_bpe")


def token_counts(docs: DataFrame, ids: str = "ids") -> DataFrame:
    return docs.withColumn("n_tokens", (F.octet_length(ids) / 4).cast("long"))
