"""Line, passage and document deduplication, top-k search, token store and mixing against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import components, line_dedup, mixing, ngram_join, shared, substring_dedup, token_store, topk

_PICK = random.Random(0)
WORDS = ["".join(_PICK.choices("abcdefghiklmnoprst", k=6)) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, _row string"


def sentence(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = ["\n".join(sentence(rng) for _ in range(6)) for _ in range(60)]
    family = rows[0].split(" ")
    for _ in range(40):  # near copies of one text, chains included
        copy = list(family)
        copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append(" ".join(copy))
        family = copy if rng.random() < 0.3 else family
    rows += [rows[1]] * 30 + [rows[1].upper()] * 3 + [None, None, "", "one", "one", " \n ", "x" * 30000]
    passage = " ".join(sentence(rng) for _ in range(6))
    rows += [sentence(rng)[:-1] + " " + passage + " " + sentence(rng) for _ in range(10)] + [sentence(rng, 4) + "\nCommon short line." for _ in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", "clash") for i, t in enumerate(texts)]
    rows += [(None, "a null key with a few words of its own here", "en", "s1", "c"), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_heavy_join_is_an_inner_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1")
    assert sorted(map(tuple, shared.heavy_join(rows, keyed, ["k"], "n", 1000, share=10).collect())) == sorted(map(tuple, rows.join(keyed, "k").select("k", "id", "n").collect()))


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_near(texts):
    classes = collections.defaultdict(list)
    for i, t in enumerate(texts):
        if s := shingle_set(t):
            classes[s].append(i)
    sets = list(classes)
    links, parent = collections.Counter(), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k, s in enumerate(sets):
        members[find(k)] += classes[s]
    return {i: (min(members[find(k)]), min(classes[s]), len(classes[s]), links[k]) for k, s in enumerate(sets) for i in classes[s]}


@pytest.mark.parametrize("limit", [100, 4])
def test_ngram_join(spark, texts, monkeypatch, limit):
    """With a small limit buckets are split to the last level and the family is compared in blocks."""
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ngram_join.near_duplicates(plain).collect()}
    want = brute_near(texts)
    assert len(rows) == len(texts)
    assert {i: (r["class_id"], r["copy_id"], r["n_copies"], r["n_linked_texts"]) for i, r in rows.items() if i in want} == want
    wordless = [r for i, r in rows.items() if i not in want]
    assert len(wordless) == 4 and all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in wordless)


def test_runs_reach_the_recall():
    assert 5 <= ngram_join.runs_for(0.99, 0.8) <= ngram_join.runs_for(0.9999, 0.8) <= 15


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = (ngram_join.sketch([np.unique(pool[s])])[0] for s in (slice(0, 900), slice(100, 1000)))
    assert abs((a == b).mean() - 0.8) < 0.2


def test_sketches_of_small_sets_agree_independently():
    """Pairs at 0.8: the number of equal tokens is binomial, so (nearly) no pair of small sets falls below 0.55."""
    rng = np.random.default_rng(2)
    for n in (5, 10, 15, 20):
        pools = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(4000)]
        own = ngram_join.sketch(pools)
        other = ngram_join.sketch([np.sort(p[: n * 4 // 5]) for p in pools])
        agree = np.array([(a == b).mean() for a, b in zip(own, other, strict=True)])
        assert (agree < 0.55).mean() <= 0.0005 and abs(agree.mean() - 0.8) < 0.01 and abs(agree.std() - 0.05) < 0.01


def test_runs_and_sketches_keep_the_recall_together():
    runs = ngram_join.runs_for(0.9999, 0.8)
    rng = np.random.default_rng(3)
    tokens = runs * ngram_join.RUN_TOKENS
    assert (rng.binomial(tokens, 0.8, 1_000_000) < ngram_join.least_agreement(0.9999, 0.8, tokens)).mean() <= 2e-5
    assert (1 - ngram_join._meeting(0.8, ngram_join.LEVELS, ngram_join.SECOND)) ** runs <= 0.9e-4


def test_ngram_join_of_short_texts(spark, monkeypatch):
    """A text of 8 words and the same with one more (4 of 5 shingles): all pairs are found."""
    monkeypatch.setattr(ngram_join, "LIMIT", 4)
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        words = rng.sample(WORDS, 9)
        rows += [" ".join(words[:8]), " ".join(words)]
    plain = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in ngram_join.near_duplicates(plain).collect())


def test_keep_one(spark, docs, texts):
    kept = ngram_join.keep_one(docs)
    want = {c[0] for c in brute_near(texts).values()} | {i for i, t in enumerate(texts) if shingle_set(t) is None}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(want)
    assert kept.filter("doc_id is null").count() == 1 and ngram_join.keep_one(docs.filter("false")).count() == 0


def brute_lines(texts):
    places = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if norm := line.strip(" \t\r\x0b\x0c").lower():
                places[norm].append((i, k))
    lines = list(places)
    sets = [frozenset(x[i : i + 8] for i in range(max(1, len(x) - 7))) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, x in enumerate(lines):
        groups[find(k)] += places[x]
    return {(*p, *min(g)) for g in groups.values() for p in g if p != min(g)}


def test_line_dedup(spark, texts):
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["key"], r["line"], r["keep_key"], r["keep_line"]) for r in line_dedup.removed_lines(plain).collect()}
    want = brute_lines(texts)
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("block", [400, 30])
def test_line_dedup_compares_all_pairs_of_a_bucket(spark, monkeypatch, block):
    """Long shared boilerplate with different tails: a bucket's least and greatest line are like few of its lines."""
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("abcdefghiklmnoprst ", k=n - 1)) + "x"
    shared_part, rows = draw(210), []
    for _ in range(150):
        line = shared_part + draw(34)
        rows += [line, line[:-1] + "y"]
    plain = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r["key"], r["line"], r["keep_key"], r["keep_line"]) for r in line_dedup.removed_lines(plain).collect()}
    want = brute_lines(rows)
    assert len(want) == 150 and got == want


def test_line_dedup_of_repetitive_and_short_lines(spark):
    """Equal shingle sets of different lengths, long lines of one distinct shingle, and pairs of few shingles."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghiklmnoprst", k=6)) + " " for _ in range(20)]
    rows = [c * n for c in "-=*#_~.+" for n in (80, 200, 500)] + [w * n for w in words for n in (15, 40)]
    for _ in range(300):
        line = "".join(rng.choices("abcdefghiklmnoprst", k=11))
        rows += [line, line + "z"]  # 4 and 5 shingles: at 0.8
    plain = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r["key"], r["line"], r["keep_key"], r["keep_line"]) for r in line_dedup.removed_lines(plain).collect()}
    want = brute_lines(rows)
    sure = {w for w in want if w[0] < 64}
    assert len(sure) == 36 and sure <= got <= want and len(got) >= 0.99 * len(want)


def test_drop_lines_of_a_text_with_many_lines(spark):
    """A log of 200,000 lines, of which seven and the last differ, is cut in time that grows with its lines."""
    log = "\n".join(f"line number {i % 7} of the log" for i in range(200_000)) + "\nthe last one stays here"
    docs = spark.createDataFrame([(1, log), (2, "short\nthe last one stays here")], "doc_id long, text string")
    found = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_lines(docs, similarity=0.99).collect()}
    assert found == {1: [*(f"line number {i} of the log" for i in range(7)), "the last one stays here"], 2: ["short"]}


def test_drop_lines(spark, docs):
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    originals = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(set((t or "").split("\n")) <= set((originals[i] or "").split("\n")) for i, t in rows.items())
    assert rows[1] == originals[1] and None in rows and line_dedup.drop_lines(docs.filter("false")).count() == 0
    blank = [i for i, t in originals.items() if not (t or "").strip()]
    assert set(blank) <= set(rows) and not any((t or "").strip() == "" for i, t in rows.items() if i not in blank)


def brute_repeats(texts, least):
    seen, found = {}, set()
    for i, t in enumerate(texts):
        t = t or ""
        units, previous = [], 0
        for m in re.finditer(r"[^\W_]+", t):
            if not units or re.search(r"[.!?\n]", t[previous : m.start()]):
                units.append([m.start(), []])
            units[-1][1].append(m.group().lower())
            previous = m.end()
        spans = [(0 if k == 0 else s, units[k + 1][0] if k + 1 < len(units) else len(t), tuple(w)) for k, (s, w) in enumerate(units)]
        again = []
        for s in spans:
            again.append(s[2] in seen)
            seen.setdefault(s[2], i)
        k = 0
        while k < len(spans):
            end = k
            while end < len(spans) and again[end]:
                end += 1
            n = sum(len(s[2]) for s in spans[k:end])
            if n >= least:
                found.add((i, spans[k][0], spans[end - 1][1], n))
            k = max(end, k + 1)
    return found


def test_every_repeated_unit_however_short(spark, texts):
    """With one word as the least passage single short lines and sentences are reported too."""
    own = [*texts, "Yes.\nA line of its own here.", "No!\nyes\n\nNo!", "Yes. no"]
    plain = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {(r["key"], r["start"], r["stop"], r["n_words"]) for r in substring_dedup.repeated(plain, min_words=1).collect()}
    assert got == brute_repeats(own, 1) and {(len(own) - 1, 0, 7, 2)} <= got


def test_substring_dedup(spark, texts, docs):
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["key"], r["start"], r["stop"], r["n_words"]) for r in substring_dedup.repeated(plain).collect()}
    assert got == brute_repeats(texts, substring_dedup.MIN_WORDS) and got
    cut = {r["doc_id"]: r for r in substring_dedup.remove(plain).collect()}
    for i, t in enumerate(texts):
        want = t
        for _, a, b, _ in sorted((g for g in got if g[0] == i), reverse=True):
            want = want[:a] + want[b:]
        assert cut[i]["text"] == want and len(cut[i]["removed"]) == sum(g[0] == i for g in got)
    assert substring_dedup.remove(docs).count() == docs.count() and substring_dedup.repeated(docs.filter("false")).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 16])
def test_topk(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 16)) / 4
    x[50:60] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [float("nan")] * 16), (202, [None] * 16), (203, [float("inf")] * 16)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in topk.search(vectors, vectors.filter("key % 20 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["key"], r["score"]))
    q = np.floor(64 * x).astype(int)
    for i in range(0, 120, 20):
        assert got[i] == sorted(((j, int(q[i] @ q[j])) for j in range(120) if j != i), key=lambda p: (-p[1], p[0]))[:7]
    few = vectors.filter("key < 3")
    assert topk.search(few, few.filter("key = 0"), 20).count() == 2 and topk.search(few.filter("false"), few, 5).count() == 0


def test_topk_by_grown_shards_and_no_broadcast(spark, monkeypatch):
    """Shards of many parts and blocks of many groups; no side of the meetings goes through the driver, however small its files are."""
    for name, value in (("SHARD_ROWS", 16), ("BLOCK_ROWS", 8), ("SPREAD", 2), ("TOGETHER", 3)):
        monkeypatch.setattr(topk, name, value)
    x = np.random.default_rng(1).integers(-3, 4, (300, 12)) / 2
    vectors = topk.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    found = topk.search(vectors, vectors.filter("key % 5 = 0"), 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["key"], r["score"]))
    q = np.floor(64 * x).astype(int)
    assert got == {i: sorted(((j, int(q[i] @ q[j])) for j in range(300) if j != i), key=lambda p: (-p[1], p[0]))[:4] for i in range(0, 300, 5)}


def test_topk_of_large_values_and_mixed_lengths(spark):
    """A component of 1e9, values that no double sums exactly and vectors of different lengths: nothing fails, ranks are exact."""
    rows = [(0, [1e9, 1.0]), (1, [1e9, 0.5]), (2, [-1e9, 2.0, 7.0]), (3, []), (4, [1e300, 0.0]), (20, [1e9, -1e9, 3.0]), (5, [0.25])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    q = {r["key"]: r["v"] for r in vectors.collect()}
    assert q[0] == [64 * 10**9, 64] and q[4][0] > 9 * 10**18 and len(q) == 7
    got = {i: [] for i in q}
    for r in topk.search(vectors, vectors, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["key"], r["score"]))
    clip = lambda x: max(-topk.LONG, min(topk.LONG, x))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i in q:
        assert got[i] == [(j, clip(dot(q[i], q[j]))) for j in sorted((j for j in q if j != i), key=lambda j: (-clip(dot(q[i], q[j])), j))]


def test_perfect_hash_block():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 64, (5000, 2), dtype=np.uint64)
    keys[1, 0], keys[2:9, 0] = keys[0, 0], keys[2, 0]  # keys with equal first words stay apart
    value = np.arange(len(keys))
    block = token_store.Block.unpack(token_store.pack_block(keys, value % 7, value * 3, value + 1))
    slot = block.find(keys)
    assert sorted(slot.tolist()) == list(range(len(keys))) and (block.offset[slot] == value * 3).all() and (block.shard[slot] == value % 7).all()
    assert (block.find(rng.integers(0, 1 << 64, (5000, 2), dtype=np.uint64)) < 0).mean() > 0.999


@pytest.mark.parametrize("shard_bytes", [64 << 20, 4000])
def test_token_store(spark, docs, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_store, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(token_store, "BLOCK_KEYS", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_store.write(docs, path, end_id=2)
    rows = store.read(store.lookup(token_store.all_keys(docs))).collect()
    library = Tokenizer.from_file(path)
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r["key"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows), key=repr) == sorted(want, key=repr)
    some = spark.createDataFrame([(987654, 0), (5, 99), (5, 2)], "key long, copy long")
    assert [(r["key"], r["copy"]) for r in store.lookup(some).collect()] == [(5, 2)]


def test_token_store_of_nothing(spark, docs):
    store = token_store.write(docs.filter("false"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert store.read(store.lookup(token_store.all_keys(docs))).count() == 0


def test_chunked_encoding_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, rng = token_store.WordEncoder(path), Tokenizer.from_file(path), random.Random(2)
    library.encode_special_tokens = True
    parts = ["a", "É", " ", "\n", "\x85", "\xa0", "'s", "'", "Σ", "İ", "中", "́", "1", "½", "_", "\x1c", "﻿", "TH", "🙂", ".", "?!", "$"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    ids, counts = encoder.encode_all(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_raking_meets_the_margins(spark, docs):
    rows = [(s, g, t, (7 * i + 3) % 11 * 100 + 50) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in range(4))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    raked = mixing.rake(cells, fraction=0.3, temper=0.8, rounds=20).collect()
    total = sum(r[3] for r in rows)
    for at, name in enumerate(mixing.MARGINS):
        own = collections.Counter()
        for r in rows:
            own[r[at]] += r[3]
        norm = sum(v**0.8 for v in own.values())
        got = collections.Counter()
        for r in raked:
            got[r[name]] += r["prob"] * r["tokens"]
        for v, n in own.items():
            assert got[v] == pytest.approx(0.3 * total * n**0.8 / norm, rel=1e-3)
    assert all(0 < r["prob"] <= 1 for r in raked)


@pytest.mark.parametrize("few", [200_000, 3])
def test_raking_to_given_targets_converges(spark, monkeypatch, few):
    """Feasible targets are met within a thousandth of all tokens, by windows and by tables of sums alike."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", few)
    rng = random.Random(2)
    rows = [(s, l, t, float(rng.randrange(5000, 9000))) for s in "abc" for l in ("en", "de") for t in (0, 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens double")
    targets = {"lang": {"en": 0.7, "de": 0.3}, "source": {"a": 0.5}, "topic": {0: 0.4, 1: 0.6}}
    found = [r.asDict() | {"w": r["prob"] * r["tokens"]} for r in mixing.rake(cells, 0.3, 0.7, 12 if few > 3 else 6, targets).collect()]
    every = sum(r[3] for r in rows)
    for margin, shares in targets.items():
        for value, share in shares.items():
            assert sum(r["w"] for r in found if r[margin] == value) == pytest.approx(0.3 * share * every, abs=0.003 * every)
    assert len(found) == 12 and all(0 <= r["prob"] <= 1 for r in found)
    with pytest.raises(ValueError):
        mixing.rake(cells, targets={"lang": {"en": 1.7}})


def test_mixing_samples_what_it_decides(spark, docs):
    told = mixing.decisions(docs)
    assert told.count() == docs.count() and told.filter("prob is null or prob <= 0 or prob > 1").count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r["doc_id"]) for r in told.filter("sampled").collect())
    assert mixing.sample(docs.filter("false")).count() == 0
    words = {r["doc_id"]: r["tokens"] for r in told.collect()}
    for r in docs.collect():
        assert words[r["doc_id"]] == max(1, len(re.findall(r"[^ \t\n\r\x0b\x0c]+", r["text"] or "")))


def test_line_dedup_compares_only_pairs_that_bitmaps_allow(spark, monkeypatch):
    """Lines that share two thirds of their text meet in many buckets, but only those that can be similar have their shingles compared."""
    rng, pairs, small = random.Random(8), set(), line_dedup._small_pairs
    draw = lambda n: "".join(rng.choices("abcdefghiklmnoprst ", k=n - 1)) + "x"
    shared_part, rows = draw(200), []
    for _ in range(40):
        line = shared_part + draw(100)
        rows += [line, line[:-1] + "y"]

    def noted(*a):
        found = shared.staged(small(*a))
        pairs.update((r["a"], r["b"]) for r in found.collect())
        return found

    monkeypatch.setattr(line_dedup, "_small_pairs", noted)
    plain = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r["key"], r["line"], r["keep_key"], r["keep_line"]) for r in line_dedup.removed_lines(plain).collect()}
    want = brute_lines(rows)
    assert len(want) == 40 and got == want and len(pairs) <= 40


def test_rake_keeps_plans_short(spark, monkeypatch):
    """Each staged step of raking has the windows of two rounds at most, apart from the targets' joins."""
    plans, stage = [], shared.staged
    monkeypatch.setattr(mixing, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i % 2}", i % 8, 100 + i) for i in range(48)], "source string, lang string, topic int, tokens long")
    cells = cells.groupBy(*mixing.MARGINS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    rows = mixing.rake(cells).collect()
    count = lambda p, what: len(re.findall(rf"\b{what}\b \[", p)) + len(re.findall(rf"\b{what} ", p))
    windows, joins = [count(p, "Window") for p in plans], [count(p, "Join") for p in plans]
    assert rows and max(windows) <= 12 and all(not (w and j) for w, j in zip(windows, joins, strict=True)) and sum(w > 0 for w in windows) == 6
