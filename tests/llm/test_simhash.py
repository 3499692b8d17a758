"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import components, simhash

SCHEMA = "doc_id long, text string, fp long, root string"


def plain(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().replace(b"\x0b", b" ").split() if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    all_ = np.array(sorted(parent), np.uint64)
    for v in all_:
        for w in all_[np.bitwise_count(all_ ^ v) <= radius].tolist():
            parent[find(int(v))] = find(w)
    return {v: find(v) for v in parent}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeÉü", k=4)) for _ in range(300)]
    out = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([3, 5, 40, 400]))
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\n ".join(copy))
    return out + [out[3]] * 40 + [out[3].upper(), None, "", " \t\n", "a", "a b", "A b", "a b c d", "w " * 30000, "x" * 50000, "a\x1cb c d e f", "a\x0bb"]


def test_fingerprints(texts, monkeypatch):
    want = [plain(t) for t in texts]
    for step in (1 << 20, 50, 1):
        monkeypatch.setattr(simhash, "STEP_BYTES", step)
        assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == want


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_the_radius(radius):
    """Whatever bits differ, some mask leaves all of them out."""
    rng = random.Random(radius)
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for _ in range(5000):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & bits for m in tables)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_of_a_family(spark, monkeypatch, limit):
    """A ball of copies whose centre is missing, chains of four bits, and strangers; buckets compared, then by common points."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(9)
    flip = lambda v, k: v ^ sum(1 << b for b in rng.sample(range(64), k))
    values = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    values |= {flip(centre, rng.choice([2, 2, 3, 4, 5])) for _ in range(120)}
    walk = rng.getrandbits(64)
    for k in [4, 5, 4, 3, 4, 4, 6, 1] * 3:
        values.add(walk := flip(walk, k))
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = classes(values)
    found = {v: got.get(s, s) for v, s in zip(sorted(values), signed, strict=True)}
    assert len(set(found.values())) == len(set(want.values())) == len({(found[v], want[v]) for v in values})


def test_near_duplicates(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[3], 1, "x"), (None, "a null key that has a text of its own", 1, "x"), (3, texts[3], 1, "x")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = classes({plain(t) for _, t, *_ in rows})
    least, copies = {}, {}
    for i, t, *_ in rows:
        root = want[plain(t)]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
        copies[plain(t)] = copies.get(plain(t), 0) + 1
    expected = [(i, f"{plain(t):016x}", least[want[plain(t)]], copies[plain(t)]) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingle_hash_is_that_of_spark(spark):
    row = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % (1 << 64) == simhash.fingerprint(b"One two\nthree four")
