"""Segmentation against a plain best path, and words found in texts without blanks."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import words

LEXICON = ["合同", "解除", "解除权", "当事人", "人", "权", "违约", "责任", "承担", "的", "应当", "当", "事", "ab", "abc", "cd", "bcd", "d", "e"]


def plain(run, cost, dearest):
    best = [(0.0, -1)]
    for end in range(1, len(run) + 1):
        options = [(best[end - 1][0] + dearest + words.UNKNOWN, end - 1)]
        options += [(best[s][0] + cost[run[s:end]], s) for s in range(max(0, end - words.LONGEST), end) if run[s:end] in cost]
        best.append(min(options))
    out, at = [], len(run)
    while at > 0:
        out.append(run[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_segments_are_those_of_the_best_path(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(words, "BROADCAST_TERMS", 0)
    rng = random.Random(7)
    seen = rng.choices(LEXICON, weights=[rng.random() for _ in LEXICON], k=500)
    runs = ["".join(rng.choices(LEXICON + ["?", "Ü", "x"], k=rng.randrange(1, 12))) for _ in range(60)] + ["", None, "zzz", "abcd" * 60, "的"]
    dictionary = words.costs(spark.createDataFrame([(w,) for w in seen + ["", None]], "word string"))
    counts = collections.Counter(seen)
    cost = {w: math.log(len(seen) / n) for w, n in counts.items()}
    assert {r["word"]: pytest.approx(r["cost"]) for r in dictionary.collect()} == cost
    got = {r["id"]: r["words"] for r in words.segmented(spark.createDataFrame(list(enumerate(runs)), "id long, run string").repartition(3), dictionary).collect()}
    assert {i: "".join(w) for i, w in got.items()} == {i: r or "" for i, r in enumerate(runs)}
    total = lambda ws: sum(min(cost.get(w, 1e9), max(cost.values()) + words.UNKNOWN if len(w) == 1 else 1e9) for w in ws)
    for i, r in enumerate(runs):
        assert total(got[i]) == pytest.approx(total(plain(r or "", cost, max(cost.values()))))


def test_words_are_found_without_blanks(spark):
    """Words of two and three characters, in random order and written without blanks, are found again."""
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(60)]
    lexicon = ["".join(rng.sample(signs, rng.choice([2, 2, 3]))) for _ in range(40)]
    given = [rng.choices(lexicon, k=20) for _ in range(300)]
    runs = spark.createDataFrame([(i, "".join(ws)) for i, ws in enumerate(given)], "id long, run string")
    found = words.found_words(runs)
    long = {r["word"] for r in found.filter("length(word) > 1").collect()}
    assert len(long & set(lexicon)) >= 0.95 * len(set(lexicon)) and len(long - set(lexicon)) <= 0.2 * len(long)
    dictionary = words.costs(found.select(F.explode(F.array_repeat("word", F.col("n").cast("int"))).alias("word")))
    true = spark.createDataFrame(list(enumerate(given)), "id long, true array<string>")
    scored = words.segmented(runs, dictionary).join(true, "id").agg(F.sum(words.agreement(F.col("words"), F.col("true"))), F.sum(F.size("words")), F.sum(F.size("true"))).first()
    assert 2 * scored[0] / (scored[1] + scored[2]) > 0.95


def test_no_runs_and_no_words(spark):
    none = spark.createDataFrame([], "word string, cost double")
    runs = spark.createDataFrame([(1, "ab")], "id long, run string")
    assert words.segmented(runs, none).first()["words"] == ["a", "b"]
    assert words.segmented(runs.filter("false"), none).count() == 0 and words.found_words(runs.filter("false")).count() == 0
