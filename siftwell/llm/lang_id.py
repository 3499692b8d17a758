"""Language identification by interpolated Kneser-Ney character models.

One character 4-gram model is fitted for each language. All models share sorted arrays of n-gram hashes with a column of
log-probabilities for each language; a text gets the language of least cross-entropy per character, and a text whose
cross-entropy is too high even for that language is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import GOLDEN, code_points, steps, with_text_columns

#: Characters of an n-gram; 16 bits each fill a 64-bit key.
ORDER = 4
ODD = GOLDEN | np.uint64(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point the 16-bit code of its lower case, 0 for what is no letter; astral letters share codes."""
    code = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            code[i] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return code


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each letter or word boundary of each text, and their len(texts) + 1 bounds.

    A text is lower-cased, its runs of other characters become one space, and it starts after ORDER - 1 spaces.
    """
    pad = " " * ORDER
    cp = code_points(pad + pad.join(texts) + pad)
    lengths = np.array([len(t) + ORDER for t in texts])
    code = _letters()[cp]
    space = code == 0
    code[space] = 32
    again = space[1:] & space[:-1]
    keep = np.concatenate([[True], ~again])
    edge = np.cumsum(np.concatenate([[0], lengths]))[:-1] + ORDER  # where each text begins
    kept = np.cumsum(keep)
    first = kept[edge - 1]  # kept characters up to the space before the text
    c = code[keep]
    key = c.copy()
    gone = np.zeros(len(c), np.int64)  # characters since the text's opening space
    gone[first[first < len(c)]] = first[first < len(c)]
    since = np.arange(len(c)) - np.maximum.accumulate(gone)
    for back in range(1, ORDER):
        shifted = np.full(len(c), np.uint64(32))
        shifted[back:] = c[:-back]
        shifted[since < back] = 32
        key |= shifted << np.uint64(16 * back)
    bounds = np.concatenate([first, [len(c)]])
    # a text without a letter has at most its closing space, which is dropped
    return key, bounds


@dataclass
class HashArray:
    """Sorted hashes with a row of values each; a table of the leading bits narrows every search to a few slots."""

    hashes: np.ndarray
    values: np.ndarray
    start: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        with np.errstate(over="ignore"):
            hashes = keys.astype(np.uint64) * ODD
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(4, int(len(hashes)).bit_length() + 2)
        start = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(np.append(hashes, np.uint64(0)), values[order].astype(np.float32), np.append(start, len(hashes)).astype(np.int32), bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        with np.errstate(over="ignore"):
            h = keys * ODD
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.start[top]
        found = np.where((self.hashes[at] == h) & (at < len(self.values)), at, -1)
        left = np.flatnonzero((found < 0) & (at + 1 < self.start[top + 1]))
        while len(left):
            at[left] += 1
            hit = self.hashes[at[left]] == h[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < self.start[top[left] + 1]]
        return found


class KneserNey:
    """One language's interpolated Kneser-Ney model from the counts of its highest-order n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.uint64), counts[order].astype(np.float64)
        tables = [(keys, counts)]
        for n in range(ORDER - 1, 0, -1):  # below the top, a count is the number of distinct characters before
            suffix = tables[0][0] & np.uint64((1 << 16 * n) - 1)
            k, c = np.unique(suffix, return_counts=True)
            tables.insert(0, (k, c.astype(np.float64)))
        below = None
        for n, (k, c) in enumerate(tables, 1):
            once, twice = (c == 1).sum(), (c == 2).sum()
            cut = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
            context, which = np.unique(k >> np.uint64(16), return_inverse=True)
            total = np.bincount(which, c)
            back = cut * np.bincount(which) / total
            if below is None:
                lower = np.full(len(k), 1 / 65536)
            else:
                lower = below[np.searchsorted(tables[n - 2][0], k & np.uint64((1 << 16 * (n - 1)) - 1))]
            below = (c - cut) / total[which] + back[which] * lower
            self.levels.append((k, np.log(below), context, np.log(back)))

    def log_prob(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log-probability of the last character after the n - 1 before it."""
        if n == 0:
            return np.full(len(keys), -np.log(65536))
        known, prob, context, back = self.levels[n - 1]
        keys = keys & np.uint64((1 << 16 * n) - 1) if n < ORDER else keys
        out = np.empty(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        out[hit] = prob[at[hit]]
        rest = keys[~hit]
        if len(rest):
            ctx = rest >> np.uint64(16)
            at = np.minimum(np.searchsorted(context, ctx), len(context) - 1)
            out[~hit] = np.where(context[at] == ctx, back[at], 0) + self.log_prob(rest, n - 1)
        return out


def excess(above_mean, n):
    """Cross-entropy above the language's mean in units of its spread: chance falls with the length, other variation does not."""
    return above_mean / np.sqrt(1 / np.maximum(n, 1) + 1 / 1000)


class LanguageModels:
    """Models of all languages in shared hash arrays, and the calibrated limits of their cross-entropy."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.models = [KneserNey(*counts[x]) for x in self.langs]
        union = np.unique(np.concatenate([m.levels[-1][0] for m in self.models]))
        self.table = HashArray.of(union, np.stack([m.log_prob(union) for m in self.models], 1))
        self.mean = np.zeros(len(self.langs))
        self.limit = np.full(len(self.langs), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per n-gram, a row for each text and a column for each language, and the n-gram counts.

        An n-gram that no language has is scored by each model's back-off.
        """
        sums, sizes = [], []
        for first, end in steps(texts):
            key, bounds = grams(texts[first:end])
            at = self.table.find(key)
            value = self.table.values[at]
            odd = np.flatnonzero(at < 0)
            if len(odd):
                each, which = np.unique(key[odd], return_inverse=True)
                value[odd] = np.stack([m.log_prob(each) for m in self.models], 1)[which]
            size = np.diff(bounds)
            total = np.zeros((len(size), len(self.langs)))
            if size.any():
                total[size > 0] = np.add.reduceat(value, bounds[:-1][size > 0], 0, dtype=np.float64)
            sums.append(total)
            sizes.append(size)
        n = np.concatenate(sizes)
        return -np.concatenate(sums) / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and rejected for each text."""
        given = [t or "" for t in texts]
        h, n = self.entropies(given) if given else (np.zeros((0, len(self.langs))), np.zeros(0))
        best = h.argmin(1)
        row = np.arange(len(given))
        least = h[row, best]
        score = 1 / np.exp(-(h - least[:, None]) * np.sqrt(np.maximum(n, 1))[:, None]).sum(1)
        rejected = excess(least - self.mean[best], n) > self.limit[best]
        lang = np.array(self.langs, object)[best]
        none = np.array([not any(map(str.isalpha, t)) for t in given], bool)
        lang[none], score[none], least[none], rejected[none] = "und", 0.0, np.nan, True
        return pd.DataFrame({"lang_pred": lang, "score": score, "cross_entropy": least, "rejected": rejected})


def _sampled(docs: DataFrame, per_lang: int, key: str, lang: str, salt: str) -> DataFrame | None:
    """About ``per_lang`` rows of each language (all, if there are fewer), chosen by a hash of the key."""
    counts = {r[lang]: r["n"] for r in docs.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_lang / n) * 1_000_000))])
    return docs.filter(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < share[F.col(lang)])


def fit(docs: DataFrame, per_lang: int = 4000, calibration: int = 10_000, alpha: float = 0.0005, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModels | None:
    """Models from labelled documents; None if there are none with a letter.

    Bounded samples are used, whole texts each. Four fifths of the rows, at most about ``per_lang`` of each language, give
    the n-gram counts; of the other fifth at most about ``calibration`` set each language's limit, above which at most a
    share ``alpha`` of its own texts lie (a conformal quantile of ``excess``). Fewer than 1 / alpha of them are too few for
    the quantile: the limit is then half as much again as the largest seen.
    Rows with a null text, lang or key are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    fold = F.pmod(F.xxhash64("key", F.lit("calibrate")), F.lit(5))
    counted = _sampled(rows.filter(fold > 0), per_lang, "key", "lang", "lang-id")
    if counted is None:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for first, end in steps(texts):
                    k, n = np.unique(grams(texts[first:end])[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": k.view(np.int64), "n": n})

    found = (
        counted.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    )
    if found.empty:
        return None
    models = LanguageModels({k: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for k, g in found.groupby("lang")})
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        at = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            batch = batch[batch["lang"].isin(m.langs)]
            if len(batch):
                h, n = m.entropies(batch["text"].tolist())
                own = h[np.arange(len(batch)), batch["lang"].map(at).to_numpy()]
                yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "h": own, "n": n})[n > 0]

    held = _sampled(rows.filter(fold == 0), calibration, "key", "lang", "limits")
    if held is None:
        return models
    held = held.select("lang", "text").mapInPandas(measure, "lang string, h double, n long").toArrow().to_pandas()
    for i, x in enumerate(models.langs):
        own = held[held["lang"] == x]
        need = int(np.ceil((len(own) + 1) * (1 - alpha)))
        models.mean[i] = np.average(own["h"], weights=own["n"]) if len(own) else 0.0
        if need <= len(own):
            models.limit[i] = np.sort(excess(own["h"] - models.mean[i], own["n"]))[need - 1]
        elif len(own):  # too few for the quantile: half as much again as the largest seen
            models.limit[i] = 1.5 * max(1.0, float(excess(own["h"] - models.mean[i], own["n"]).max()))
    return models


def identify(docs: DataFrame, models: LanguageModels | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy and rejected; columns of those names are replaced.

    A null text, or one without a letter, gets ``und``, score 0, a null cross_entropy and counts as rejected. Without
    models every text gets that. Ties go to the language that sorts first.
    """
    added = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}
    if models is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make(texts: list[str | None]):
        made = shared.value.predict(texts)
        return [made[name] for name in added]

    return with_text_columns(docs, text, added, make)
