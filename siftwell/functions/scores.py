"""Score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price in CNY for a million tokens, (input, output); what unknown models cost.
PRICES = {"deepseek-v4-pro": (10.0, 40.0), "deepseek-chat": (2.0, 8.0)}
OTHER_PRICE = (2.0, 8.0)
# The parameters of BM25.
K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_term(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """Weight of one term before its idf; an average length of 0 counts as 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.coalesce(F.nullif(average, F.lit(0.0)), F.lit(1.0))))


def similarity(distance: Column, space: str = "l2") -> Column:
    """Cosine similarity from a distance of unit vectors: squared Euclidean, or cosine and inner-product distance."""
    return 1 - distance / (2 if space == "l2" else 1)


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    prices = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[i])]), model), F.lit(OTHER_PRICE[i]))
    return prompt_tokens / 1_000_000 * prices(0) + completion_tokens / 1_000_000 * prices(1)


def boosted(probability: Column, authoritative: Column, factor: float = 1.3) -> Column:
    return F.when(authoritative, F.least(F.lit(1.0), probability * factor)).otherwise(probability)
