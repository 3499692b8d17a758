"""Language identification, toxicity, quality rules and byte-level BPE against brute force and held-out rows."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, lang_id, quality, toxicity

EDGE = [None, "", " ", "\n\n", "12 !!", "ß" * 3000, "a b c " * 5000]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    parts = {"xa": ["ba", "do", "ki", "la"], "yb": ["sch", "ung", "tz", "ei"]}
    rows = []
    for i in range(400):
        lang = "xa" if i % 2 else "yb"
        words = ["".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(40)]
        toxic = int(i % 5 == 3)
        words[7:9] = rng.sample(["idiot", "scum"], 2) if toxic else words[7:9]
        rows.append((i, " ".join(words), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3).cache()


def edge_rows(spark):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(EDGE)] + [(None, "x", "x", 1)], "doc_id long, text string, score string, big long")


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc ", k=50)) for _ in range(40)]
    keys, counts = np.unique(lang_id.grams(texts)[0], return_counts=True)
    model = lang_id.KneserNey(keys, counts)
    for context in np.unique(keys >> np.uint64(16))[:10]:
        every = context << np.uint64(16) | np.arange(65536, dtype=np.uint64)
        assert np.exp(model.log_prob(every)).sum() == pytest.approx(1)
    table = lang_id.HashArray.of(keys, np.arange(len(keys), dtype=float)[:, None])
    assert (table.values[table.find(keys), 0] == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1 << 62)) < 0).all()


def test_language_held_out_accuracy_and_rejection(spark, corpus):
    models = lang_id.fit(corpus.filter("doc_id % 4 <> 0"))
    found = lang_id.identify(corpus.filter("doc_id % 4 = 0"), models)
    assert found.filter("lang_pred = lang and not rejected and score > 0.5").count() == 100
    odd = spark.createDataFrame([(1, "qqqq wwww jjjj vvvv qwjv " * 8)], "doc_id long, text string")
    assert lang_id.identify(odd, models).first()["rejected"]


def test_language_edges(spark, corpus):
    models = lang_id.fit(corpus)
    rows = {r["doc_id"]: r for r in lang_id.identify(edge_rows(spark), models).collect()}
    assert [rows[i]["lang_pred"] for i in range(5)] == ["und"] * 5 and rows[0]["score"] == 0 and rows[0]["rejected"] and rows[0]["cross_entropy"] is None
    assert rows[6]["lang_pred"] in ("xa", "yb") and set(rows[6].asDict()) == {"doc_id", "text", "big", "lang_pred", "score", "cross_entropy", "rejected"}
    empty = corpus.filter("false")
    assert lang_id.fit(empty) is None and lang_id.identify(empty, None).count() == 0
    assert lang_id.identify(corpus.limit(2), None).first()["lang_pred"] == "und"


def test_toxicity_held_out(spark, corpus):
    machine = toxicity.fit(corpus.filter("doc_id % 4 <> 0"), corpus.filter("doc_id % 4 <> 0").select("doc_id", "toxic"))
    rows = toxicity.score(corpus.filter("doc_id % 4 = 0"), machine).collect()
    assert all(r["predicted"] == r["toxic"] for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_factorization_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    known = np.sort(rng.choice(1 << 20, 50, replace=False)).astype(np.int32)
    machine = toxicity.FactorizationMachine(known, rng.normal(size=(50, toxicity.FACTORS + 1)), 0.3)
    sets = [np.sort(rng.choice(known, 7, replace=False)), known[:0], known[:1]]
    logits = machine.margins(*machine.rows(sets))[0]
    for s, logit in zip(sets, logits):
        w = machine.weights[np.searchsorted(known, s)]
        pairs = sum(w[i, 1:] @ w[j, 1:] for i in range(len(s)) for j in range(i)) / max(len(s), 1)
        assert logit == pytest.approx(0.3 + w[:, 0].sum() + pairs)


def test_toxicity_learns_a_pair(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["lo", "mi", "ra"]) for _ in range(6)] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(words), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in scored]) > 0.97


def test_toxicity_learns_a_pair_without_single_signals(spark):
    """Toxic with both an insult and a group or with neither: no word tells anything alone, and other words get no weights."""
    rng = random.Random(11)
    insults, groups, rows = ["moron", "fool", "clown"], ["north", "south", "east"], []
    for i in range(4000):
        words = rng.choices([f"word{j}" for j in range(300)], k=rng.randrange(8, 25))
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + a * [rng.choice(insults)] + b * [rng.choice(groups)]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs, docs.filter("doc_id % 4 > 0").select("doc_id", "toxic"))
    assert machine.known.tolist() == toxicity.terms([" ".join(insults + groups)])[0].tolist()
    held = toxicity.score(docs.filter("doc_id % 4 = 0"), machine).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97


def test_toxicity_learns_nothing_from_chance(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices([f"word{j}" for j in range(200)], k=15)), rng.randrange(2)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.fit(docs, docs.select("doc_id", "toxic")).known) <= 2


def test_toxicity_edges(spark, corpus):
    labels = corpus.select("doc_id", "toxic")
    machine = toxicity.fit(corpus, labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (1, 0)], "doc_id long, toxic int")))
    rows = toxicity.score(edge_rows(spark), machine).collect()
    assert len(rows) == len(EDGE) + 1 and all(0 < r["score"] < 0.5 for r in rows if r["doc_id"] in (0, 1, 2))
    none = toxicity.fit(corpus, labels.filter("false"))
    assert toxicity.score(corpus, none).select("score").distinct().count() == 1
    assert toxicity.score(corpus.filter("false"), none).count() == 0


def brute_measure(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, covered = set(), 0, set()
    for line in t.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    counts = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    for i in range(len(words) - 7):
        if counts[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_measures():
    rng = random.Random(1)
    texts = [*EDGE, *("".join(rng.choices(["a ", "b ", "c\n", "é", "#", " "], k=rng.randint(0, 60))) for _ in range(800))]
    assert list(zip(*(c.tolist() for c in quality.measure(texts)))) == [brute_measure(t) for t in texts]


def test_exact_binomial_bound_and_certification():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.05), (50, 50, 0.5)):
        assert quality.upper_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def level(rule, n):
    return tuple(n if r == rule else 0 for r in range(len(quality.RULES)))


def test_path_and_certification():
    cells = np.array([level(0, 0), level(0, 10), level(0, 3), level(1, 7)])
    steps = quality.path(cells, np.array([1000, 0, 1, 400]), np.array([5, 50, 40, 500]), 0.05)
    assert steps == [level(0, 10)]  # one step rejects both kinds; the other rule would reject too many good texts
    assert quality.certify(steps, cells, np.array([500, 0, 1, 200]), 0.05, 0.01) == level(0, 10)
    assert quality.certify(steps, cells, np.array([500, 0, 60, 200]), 0.05, 0.01) == level(0, 0)  # too many good ones go
    assert quality.certify(steps, cells, np.array([50, 0, 0, 0]), 0.05, 0.01) == level(0, 0)  # too few labels to be sure
    assert quality.certify(steps, cells, np.array([95, 0, 0, 0]), 0.05, 0.01) == level(0, 10)
    assert quality.path(cells, np.array([9, 0, 0, 0]), np.array([9, 0, 0, 0]), 0.05) == []  # no use


def test_the_share_of_good_texts_lost_is_bounded():
    """Over many draws of labels the true share exceeds alpha no more often than delta."""
    rng = np.random.default_rng(6)
    kinds = np.array([level(r, n) for r in range(2) for n in range(11)])
    true = np.concatenate([np.r_[0.42, np.full(10, 0.008)], np.r_[0.42, np.full(10, 0.008)]])
    bad = np.concatenate([np.r_[0.05, np.full(10, 0.05)], np.r_[0.05, np.full(10, 0.04)]])
    broken = used = 0
    for _ in range(400):
        goods, bads = (rng.multinomial(n, p / p.sum(), 2) for n, p in ((1000, true), (300, bad)))
        chosen = quality.certify(quality.path(kinds, goods[0], bads[0], 0.05), kinds, goods[1], 0.05, 0.05)
        hit = ((kinds > 0) & (kinds <= np.array(chosen))).any(1)
        used += any(chosen)
        broken += true[hit].sum() / true.sum() > 0.05
    assert broken <= 400 * 0.05 + 13 and used > 20


def test_quality_rules(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + (" ###" * 30 if i % 10 == 0 else ""), ["en", None][i % 2], int(i % 10 != 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    found = quality.apply(docs, docs.select("doc_id", "quality"))
    assert found.filter("kept").count() == 2700 and found.filter("kept").join(docs, "doc_id").filter("quality = 0").count() == 0
    odd = quality.apply(edge_rows(spark).withColumn("lang", F.lit(None).cast("string")), docs.select("doc_id", "quality").filter("false"))
    assert odd.count() == len(EDGE) + 1 and odd.filter("doc_id = 0 and base_failed and not kept and n_words = 0").count() == 1
    assert quality.apply(docs.filter("false"), docs.select("doc_id", "quality")).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.RankBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(bpe):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "in", "the", "'s", "'", " ", "  ", "\n", "\t", ".", "é", "ß", "中", "🙂", "1", " "], k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 20000, "ab" * 9000, "e" * 5000 + "r" * 99, " ", "  a", "a  ", "\n a"]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_batch_and_single_agree(bpe):
    rng = random.Random(9)
    words = ["".join(rng.choices("abeinrst", k=rng.randint(1, 30))).encode() for _ in range(500)]
    assert [x.tolist() for x in bpe.merge_many(words)] == [bpe.merge(w) for w in words]


def test_bpe_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = {r["doc_id"]: r for r in byte_bpe.token_counts(byte_bpe.encode(edge_rows(spark), path, public_tokenizers.PATTERN)).collect()}
    assert rows[0]["n_tokens"] == 0 and bytes(rows[6]["decoded"]).decode() == EDGE[6] and rows[6]["score"] == "x"
    assert byte_bpe.digests(edge_rows(spark).filter("false"), path, public_tokenizers.PATTERN).count() == 0


def plain_kneser_ney(grams):
    """Probability of a 4-gram (a tuple) by interpolated Kneser-Ney, from the tables of counts alone."""
    counts = {4: collections.Counter(grams)}
    for n in (3, 2, 1):  # a lower count is the number of different characters before
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    cut, total, kinds = {}, {n: collections.Counter() for n in counts}, {n: collections.Counter() for n in counts}
    for n, table in counts.items():
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        cut[n] = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
        for g, c in table.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def prob(g, n=4):
        if n == 0:
            return 1 / 65536
        own, below = g[-n:], prob(g, n - 1)
        if not total[n][own[:-1]]:
            return below
        return (max(counts[n][own] - cut[n], 0) + cut[n] * kinds[n][own[:-1]] * below) / total[n][own[:-1]]

    return prob


def test_cross_entropies_equal_plain_kneser_ney():
    rng = random.Random(12)
    words = {"a": ["the", "cat", "sat", "on", "mats"], "b": ["der", "kater", "saß", "auf", "matten"]}
    texts = {k: [" ".join(rng.choices(w, k=30)) for _ in range(6)] for k, w in words.items()}

    def tuples(text):
        keys = lang_id.grams([text])[0].tolist()
        return [tuple(k >> 16 * i & 0xFFFF for i in (3, 2, 1, 0)) for k in keys[lang_id.grams([text])[1][0] :]]

    counted = {k: np.unique(lang_id.grams(ts)[0], return_counts=True) for k, ts in texts.items()}
    models = lang_id.LanguageModels(counted)
    asked = ["The cat saß on der mat", "xyz qq", "kater matten!", "on", ""]
    h, n = models.entropies(asked)
    for j, name in enumerate(models.langs):
        keys, c = counted[name]
        prob = plain_kneser_ney([tuple(k >> 16 * i & 0xFFFF for i in (3, 2, 1, 0)) for k, m in zip(keys.tolist(), c.tolist(), strict=True) for _ in range(m)])
        for i, text in enumerate(asked):
            own = tuples(text)
            assert len(own) == n[i]
            assert h[i, j] == pytest.approx(-sum(np.log(prob(g)) for g in own) / max(len(own), 1), abs=2e-5)
