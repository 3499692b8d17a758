"""Quality rules with risk-controlled thresholds.

Fixed base rules drop degenerate texts. Each learned rule bounds one measure of a text; its cutoff comes from labelled
holdouts so that, in every stratum, it rejects at most a given share of the good texts with a given confidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import staged, steps, with_text_columns

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def _repeat_words(words: list[bytes], bounds: np.ndarray) -> np.ndarray:
    """For each text (words[bounds[i]:bounds[i + 1]]) its words inside WINDOW-word windows that occur twice or more in it.

    Windows are compared exactly: ids of single words, then of pairs, fours and eights, by doubling.
    """
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(ids)
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.int64)
    if n < WINDOW:
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    for span in (1, 2, 4):
        pair = ids[: n - span] * (int(ids.max()) + 1) + ids[span:]
        ids = np.full(n, -1, np.int64)
        ids[: len(pair)] = np.unique(pair, return_inverse=True)[1]
        ids[n - span :] = ids.max() + 1 + np.arange(span)
    whole = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    if not len(whole):
        return out
    key = text[whole] * (int(ids.max()) + 1) + ids[whole]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    begins = whole[count[which] >= 2]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + WINDOW, -1)
    return np.bincount(text, np.cumsum(cover)[:n] > 0, minlength=len(sizes)).astype(np.int64)


def measure(texts: list[str | None]) -> list[np.ndarray]:
    """The columns of MEASURES for each text."""
    given = [t or "" for t in texts]
    table = np.zeros((len(given), len(MEASURES)), np.int64)
    for first, end in steps(given):
        words: list[bytes] = []
        bounds = [0]
        for i in range(first, end):
            raw = given[i].encode("utf-8", "surrogatepass")
            own = raw.split()  # bytes split on the six ASCII white spaces
            words += own
            bounds.append(len(words))
            seen: set[bytes] = set()
            dup = 0
            for line in raw.split(b"\n"):
                if line in seen:
                    dup += bool(line.split())
                else:
                    seen.add(line)
            joined = b"".join(own)
            table[i, :4] = len(own), len(joined.decode("utf-8", "surrogatepass")), len(joined) - len(joined.translate(None, SYMBOLS)), dup
        table[first:end, 4] = _repeat_words(words, np.array(bounds))
    return list(table.T)


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``ratio`` (a SQL expression of the measures) is above a cutoff; cutoffs from lenient to strict."""

    name: str
    ratio: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    Rule("dup_lines", "n_dup_lines / greatest(n_words, 1)", (0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.22, 0.19, 0.16, 0.13, 0.1, 0.07, 0.04, 0.02)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    Rule("short_words", "greatest(n_words, 1) / greatest(word_chars, 1)", (0.6, 0.55, 0.5, 0.45, 0.42, 0.39, 0.36, 0.33, 0.3, 0.27)),
)


def upper_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the p-value of "the rate is at least p" when k of n were rejected."""
    if k >= n:
        return 1.0
    x = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in x]) + x * math.log(p) + (n - x) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def path(cells: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float) -> list[tuple[int, ...]]:
    """A sequence of ever stricter sets of cutoffs, each one cutoff of one rule further than the one before it.

    ``cells``: for each kind of text the first cutoff of each rule that it exceeds (1: the most lenient, 0: none); ``good``
    and ``bad``: how many labelled texts are of that kind. Of the steps that leave the share of good texts rejected at ``alpha`` or less, the one
    that rejects most bad texts less good ones comes next (on ties the more lenient, then the earlier rule); the path ends
    where none gains.
    """
    now, left, steps_ = [0] * len(RULES), np.ones(len(cells), bool), []
    while True:
        best = None
        for r, rule in enumerate(RULES):
            for level in range(now[r] + 1, len(rule.cutoffs) + 1):  # the level-th cutoff from lenient to strict
                hit = left & (cells[:, r] > 0) & (cells[:, r] <= level)
                gain = int(bad[hit].sum() - good[hit].sum())
                safe = good[~left | hit].sum() <= alpha * good.sum()
                if gain > 0 and safe and (best is None or (gain, -level) > best[0]):
                    best = (gain, -level), r, level, hit
        if best is None:
            return steps_
        _, r, level, hit = best
        now[r] = level
        left &= ~hit
        steps_.append(tuple(now))


def certify(steps_: list[tuple[int, ...]], cells: np.ndarray, good: np.ndarray, alpha: float, delta: float) -> tuple[int, ...]:
    """The last of ``steps_`` that fixed-sequence testing certifies on other labels; no cutoffs at all if none passes.

    The steps are tested in order, each by the exact binomial p-value of "a share ``alpha`` of good texts or more is
    rejected", at level ``delta``; testing stops at the first that fails, so all that pass are safe at once.
    """
    found = (0,) * len(RULES)
    for step in steps_:
        hit = ((cells > 0) & (cells <= np.array(step))).any(1)
        if not good.sum() or upper_tail(int(good[hit].sum()), int(good.sum()), alpha) > delta:
            break
        found = step
    return found


def thresholds(measured: DataFrame, alpha: float = 0.05, delta: float = 0.05, label: str = "quality", stratum: str = "stratum", key: str = "key") -> dict[str, dict[str, float]]:
    """Cutoffs {stratum: {rule: cutoff}} from measured, labelled rows (label 1: good, 0: bad; others are ignored).

    The share of good texts that the rules together reject is at most ``alpha`` in every stratum at once, with confidence
    1 - ``delta``: half of the labels, by a hash of the key, choose a path of ever stricter cutoffs in each stratum, the
    other half certify a stretch of it, each stratum at delta / strata (Bonferroni), its steps in fixed sequence. A
    stratum needs some 90 good labels in the second half; with fewer it gets no cutoff and rejects nothing beyond the base
    rules. Only counts of kinds of text reach the driver: at most 11 ** 5 for each stratum, half and label, however many rows.
    """
    exceeded = [F.coalesce(*(F.when(F.expr(r.ratio) > c, i) for i, c in enumerate(r.cutoffs, 1)), F.lit(0)).alias(r.name) for r in RULES]
    half = F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)).alias("half")
    rows = measured.filter(F.col(label).isin(0, 1)).select(stratum, half, F.col(label).alias("label"), *exceeded)
    counted = rows.groupBy(stratum, "half", *(r.name for r in RULES)).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).toPandas()
    found: dict[str, dict[str, float]] = {}
    strata = counted[stratum].unique()
    for name in strata:
        own = counted[counted[stratum] == name]
        parts = [own[own["half"] == h].sort_values([r.name for r in RULES]) for h in (0, 1)]
        cells = [p[[r.name for r in RULES]].to_numpy() for p in parts]
        steps_ = path(cells[0], parts[0]["good"].to_numpy(), parts[0]["bad"].to_numpy(), alpha)
        chosen = certify(steps_, cells[1], parts[1]["good"].to_numpy(), alpha, delta / len(strata))
        found[name] = {r.name: r.cutoffs[n - 1] for r, n in zip(RULES, chosen, strict=True) if n}
    return found


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", key: str = "doc_id", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(key, n_words, the other measures, stratum, base_failed, kept) for every row of ``docs``.

    base_failed: fewer than 20 words, or more than 30 in 100 of them inside repeated 8-word windows. A null text has no
    words; a null stratum is a stratum of its own. ``labels`` (key, quality) are averaged for each key and rounded, null
    labels ignored, so that repeated labels multiply no rows. Whole texts are measured, once; the measures are staged.
    """
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("(null)")).alias("stratum"), F.col(text).alias("text"))
    rows = staged(with_text_columns(slim, "text", MEASURES, measure, keep_text=False))
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    marks = labels.filter("quality is not null").groupBy(F.col(key).alias("key")).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    cut = thresholds(rows.filter("not base_failed").join(marks, "key"), alpha, delta)
    reject = F.lit(False)
    for name, own in cut.items():
        for r in RULES:
            if r.name in own:
                reject = reject | ((F.col("stratum") == name) & (F.expr(r.ratio) > own[r.name]))
    return rows.select(F.col("key").alias(key), *MEASURES, "stratum", "base_failed", (~F.col("base_failed") & ~reject).alias("kept"))
