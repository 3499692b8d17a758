"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed words. The score is a logistic function of a bias, a weight for each term and the inner
products of the factors of each two terms, so that a pair (an insult with the mention of a group, say) can count for more
or less than its parts. Training is distributed: partitions of a bounded labelled sample run AdaGrad steps from shared
parameters, and their results are averaged, round after round.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import staged, steps, with_text_columns, word_hashes

#: Bits of a term's hash; factors of a term; texts of the sample that a term must be in to be tried at all.
BITS, FACTORS, MIN_TEXTS = 24, 4, 5
#: A tried term keeps its weights if its log-likelihood ratio (G squared, one degree of freedom) with the label reaches EVIDENCE, or
#: if its factors are as many times longer than the longest that training on shuffled labels gives to any term.
EVIDENCE, MARGIN = 15.0, 1.5
#: Labelled rows that training takes at most, on average; parts at most, rows of a part at least, rounds of averaging, passes.
SAMPLE_ROWS, PARTS, PART_ROWS, ROUNDS, EPOCHS = 40_000, 8, 2_000, 3, 3
#: Rounds in which all terms are tried.
TRIALS = 2
STEPS, RATE, DECAY, MINIBATCH = 200, 0.5, 1e-4, 64


def terms(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashed words of each whole text."""
    given = [t or "" for t in texts]
    out: list[np.ndarray] = []
    for first, end in steps(given):
        words, bounds = word_hashes(given[first:end])
        row = np.repeat(np.arange(end - first, dtype=np.uint64), np.diff(bounds))
        each = np.unique(row << np.uint64(32) | words >> np.uint64(64 - BITS))
        cut = np.searchsorted(each, np.arange(1, end - first, dtype=np.uint64) << np.uint64(32))
        out += np.split((each & np.uint64(0xFFFFFFFF)).astype(np.int32), cut)
    return out


@dataclass
class FactorizationMachine:
    """``known``: sorted term hashes; ``weights``: a row for each, the linear weight and then the factors."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def rows(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Model rows of the known terms of all sets, end to end, and the bounds of each set."""
        flat = np.concatenate([*sets, np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = self.known[at] == flat
        return at[hit], np.searchsorted(owner[hit], np.arange(len(sets) + 1))

    def margins(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, the factor sums of each set, and the scale of its terms in the pairs (one over the root of their number)."""
        each = self.weights[rows]
        total = np.concatenate([np.zeros((1, FACTORS + 1)), np.cumsum(each, 0)])
        square = np.concatenate([[0.0], np.cumsum((each[:, 1:] ** 2).sum(1))])
        sums = total[bounds[1:]] - total[bounds[:-1]]
        scale = 1 / np.sqrt(np.maximum(np.diff(bounds), 1))
        pairs = 0.5 * ((sums[:, 1:] ** 2).sum(1) - (square[bounds[1:]] - square[bounds[:-1]])) * scale**2
        return self.bias + sums[:, 0] + pairs, sums[:, 1:], scale

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for first, end in steps([t or "" for t in texts]):
            if len(self.known):
                logit = self.margins(*self.rows(terms(texts[first:end])))[0]
            else:
                logit = np.full(end - first, self.bias)
            out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return np.concatenate([*out, np.zeros(0)])

    def train(self, sets: list[np.ndarray], labels: np.ndarray, seed: int) -> None:
        """AdaGrad on the logistic loss, in place: EPOCHS passes, more over few sets, so that it takes STEPS steps at least."""
        rng = np.random.default_rng(seed)
        speed, bias_speed = np.ones(self.weights.shape), 1.0
        for _ in range(max(EPOCHS, -(-STEPS * MINIBATCH // len(sets)))):
            order = rng.permutation(len(sets))
            for at in range(0, len(order), MINIBATCH):
                some = order[at : at + MINIBATCH]
                rows, bounds = self.rows([sets[i] for i in some])
                logit, sums, scale = self.margins(rows, bounds)
                error = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels[some]
                owner = np.repeat(np.arange(len(some)), np.diff(bounds))
                slope = np.empty((len(rows), FACTORS + 1))
                slope[:, 0] = error[owner]
                slope[:, 1:] = (error * scale**2)[owner, None] * (sums[owner] - self.weights[rows, 1:])
                touched, which = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(which, slope[:, f], len(touched)) for f in range(FACTORS + 1)], 1).astype(float)
                step += DECAY * self.weights[touched]
                speed[touched] += step**2
                self.weights[touched] -= RATE * step / np.sqrt(speed[touched])
                mean = float(error.mean())
                bias_speed += mean**2
                self.bias -= RATE * mean / np.sqrt(bias_speed)


def _improved(shared, turn: int, shuffled: bool):
    def improve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        own = replace(shared.value, weights=shared.value.weights.copy())
        labels, seed = rows["label"].to_numpy(float), int(rows["part"].iloc[0])
        if shuffled:
            labels = np.random.default_rng(seed).permutation(labels)
        own.train([np.asarray(x) for x in rows["terms"]], labels, 1000 * turn + seed)
        return pd.DataFrame({"bias": [own.bias], "weights": [own.weights.astype(np.float32).tobytes()]})

    return improve


def _trained(parts: DataFrame, known: np.ndarray, bias: float, rounds: int, shuffled: bool = False) -> FactorizationMachine:
    """A machine of the terms ``known`` after some rounds on ``parts`` (part, key, label, terms)."""
    start = np.zeros((len(known), FACTORS + 1))
    start[:, 1:] = np.random.default_rng(7).normal(0, 0.01, (len(known), FACTORS))
    machine = FactorizationMachine(known, start, bias)
    for turn in range(rounds):
        shared = parts.sparkSession.sparkContext.broadcast(machine)
        made = parts.repartitionByRange(PARTS, "part").groupBy("part").applyInPandas(_improved(shared, turn, shuffled), "bias double, weights binary").collect()
        weights, biases = np.zeros(start.shape), []
        for r in made:
            weights += np.frombuffer(r["weights"], np.float32).reshape(start.shape)
            biases.append(r["bias"])
        machine = FactorizationMachine(known, weights / len(biases), float(np.mean(biases)))
        shared.unpersist()
    return machine


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> FactorizationMachine:
    """A machine from labelled documents.

    At most about SAMPLE_ROWS labelled rows are used, chosen by a hash of the key, whole texts each. Every hashed term of
    MIN_TEXTS of them is tried; the machine knows those that pass EVIDENCE or MARGIN. Repeated labels of a key are averaged
    and rounded; null keys, labels and texts are left out. Without labels, or with one kind only, the machine has no terms
    and a bias that gives the (smoothed) share of toxic labels.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).dropna().groupBy("key").agg(F.round(F.avg("label")).cast("int").alias("label"))
    n = marks.count()
    share = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * 1_000_000)
    marks = marks.filter(F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1_000_000)) < share)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().join(marks, "key")
    sample = staged(with_text_columns(rows.repartition(PARTS), "text", {"terms": "array<int>"}, lambda t: [terms(t)], keep_text=False))
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, all_ = counts.get(1, 0), sum(counts.values())
    bias = float(np.log((ones + 0.5) / (all_ - ones + 0.5))) if all_ else 0.0
    none = FactorizationMachine(np.zeros(0, np.int32), np.zeros((0, FACTORS + 1)), bias)
    if not 0 < ones < all_:
        return none
    term = sample.select("label", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("k"))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cells = [(F.col("k"), ones), (F.col("n") - F.col("k"), all_ - ones)]
    ratio = sum((part(seen, F.col("n") * of / all_) + part(of - seen, (all_ - F.col("n")) * of / all_) for seen, of in cells), F.lit(0.0)) * 2
    # the terms of a bounded sample, at most 2 ** BITS
    told = term.withColumn("g", ratio).filter((F.col("n") >= MIN_TEXTS) | (F.col("g") >= EVIDENCE)).orderBy("t").toArrow()
    tried, alone = told["t"].to_numpy(), told["g"].to_numpy() >= EVIDENCE
    if not len(tried):
        return none
    parts = sample.select(F.pmod(F.xxhash64("key"), F.lit(max(1, min(PARTS, all_ // PART_ROWS)))).alias("part"), "key", "label", "terms")
    length = lambda shuffled: np.linalg.norm(_trained(parts, tried, bias, TRIALS, shuffled).weights[:, 1:], axis=1)
    known = tried[alone | (length(False) > MARGIN * length(True).max())]
    return _trained(parts, known, bias, ROUNDS) if len(known) else none


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0), replacing columns of those names.

    A text without a known term, null and empty ones too, gets the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make(texts: list[str | None]):
        made = shared.value.score(texts)
        return [made, (made >= 0.5).astype(np.int32)]

    return with_text_columns(docs, text, {"score": "double", "predicted": "int"}, make)
