"""Products in residues against whole numbers, and mined negatives against brute force."""

import math
import random

import numpy as np
import pytest

from siftwell.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, _key string, label_rows int"


@pytest.mark.parametrize("width, size", [(1, 5), (64, 256), (64, 2**30), (3000, 4000), (5, 2**62), (0, 1)])
def test_products_are_exact(width, size):
    rng = np.random.default_rng(width + size)
    a, b = rng.integers(-size, size, (7, width)), rng.integers(-size, size, (9, width))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert hn.products(a, b).tolist() == want
    assert hn.products(a[:0], b).shape == (0, 9)


def test_products_at_the_ends():
    for size in (255, 256, 1 << 20, 9_200_000_000_000_000_000):
        x = np.full((2, 64), size)
        x[1] = -x[1]
        assert hn.products(x, x).tolist() == [[64 * size * size, -64 * size * size], [-64 * size * size, 64 * size * size]]


def test_too_few_primes_is_an_error():
    with pytest.raises(ValueError):
        hn.primes(1024, 1 << 4000)


def brute(rows):
    clean = sorted({(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    for i, v, lab in clean:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other) for j, w, other in clean)
        for s, p, _ in [x for x in scored if x[1] != i and x[2] == lab][:5]:
            far = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 256), (50, 2)])
def test_mine(spark, monkeypatch, shard, block):
    """Ties, repeated rows, equal keys, nulls, vectors of other lengths, one label of most rows; few and many shards."""
    monkeypatch.setattr(hn, "SHARD_ROWS", shard)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(4)], 0 if i % 3 else rng.randrange(4)) for i in range(420)]
    rows += [rows[5], rows[100], (200, [0.5, 0.25], 0), (200, [0.5, 0.25], 1), (None, [0.1] * 4, 0), (500, None, 1), (600, [None, 0.1], 1), (700, [float("nan")], 0), (800, [float("inf")], 0), (900, [0.5] * 4, None), (1000, [], 2), (1100, [-1.0] * 9, 7)]
    given = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    found = hn.mine(given, lambda k: k % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, found.collect())) == brute(exact)


def test_mine_sends_no_meeting_through_the_driver(spark, monkeypatch):
    """However small the files of either side are, no side of the meetings is broadcast; parts of grown shards are merged."""
    for name, value in (("SHARD_ROWS", 20), ("BLOCK_ROWS", 1)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr("siftwell.llm.topk.SPREAD", 2)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-4, 5) / 4 for _ in range(5)], i % 3) for i in range(0, 1200, 4)]
    found = hn.mine(spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA), lambda k: k % 100 == 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_nothing_to_mine(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), lambda k: k % 100 == 0).count() == 0
    assert hn.mine(spark.createDataFrame([(100, [1.0], 1, "", 1)], SCHEMA), lambda k: k % 100 == 0).count() == 0
