"""N-gram Jaccard self-join by recursive splitting on sampled shared tokens (Chosen-Path join).

A text is the set of its word n-grams. Texts with equal sets form one class; classes are joined. In each run a bucket of
classes that is too large is split: its path samples one or two of the level's two min-wise tokens, which no other run or
level uses, and classes that share such a token meet in a child bucket, so similar sets stay together with a chance that depends on their similarity only. Small
buckets are compared by brute force, as are those that the deepest level leaves large (groups of truly similar sets), in
blocks. Runs repeat until a pair at the threshold is found with the target recall. Every pair is counted in exactly one
bucket, the least that both of its classes reached, and is accepted by the exact Jaccard similarity of its sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.shared import GOLDEN, heavy_join, mix, packed, staged, steps, temporary, unpacked, with_text_columns, word_hashes

#: Bucket size for brute force, levels of splitting, chance of a second sampled token, min-wise tokens of a run.
LIMIT, LEVELS, SECOND = 100, 4, 0.25
RUN_TOKENS = 2 * LEVELS
#: Share of the pairs that may be missed which the comparison of sketches may miss; the runs may miss the rest.
SKETCH_SHARE = 0.1


def shingles(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a text of fewer words has one, of all its words."""
    out: list[np.ndarray] = []
    given = [t or "" for t in texts]
    for first, end in steps(given):
        words, bounds = word_hashes(given[first:end])
        with np.errstate(over="ignore"):
            grams = words.copy()
            for i in range(1, n):  # a gram starts at each word; those that leave their text are cut off below
                grams = mix(grams * (GOLDEN | np.uint64(1)))
                grams[: len(words) - i] += words[i:]
            grams = mix(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), np.uint64))
            else:
                out.append(words[:0])
    return out


def _factors(tokens: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, tokens + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def sketch(sets: list[np.ndarray], tokens: int = 64) -> list[np.ndarray]:
    """Min-wise tokens of each set, 32 bits each: for each of some odd factors the member with the least product.

    A factor orders all members anew, so the tokens of a pair agree independently, in small sets too.
    """
    factors = _factors(tokens)
    out = []
    for s in sets:
        if not len(s):
            out.append(np.zeros(0, np.int32))
            continue
        best = np.full(tokens, ~np.uint64(0))
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 4096):
                best = np.minimum(best, (s[at : at + 4096, None] * factors).min(0))
        out.append(best.astype(np.uint32).view(np.int32))  # the low half: the high one of a least product is mostly zeros
    return out


def _meeting(similarity: float, levels: int, second: float) -> float:
    """Chance that a pair shares a bucket of the deepest level of one run: a Markov chain of the number of paths shared."""
    paths = np.array([0.0, 1.0])
    for _ in range(levels):
        new = np.zeros(2 * len(paths))
        for k, p in enumerate(paths):
            for extra in range(k + 1):  # paths that sample the second token too
                q = p * math.comb(k, extra) * second**extra * (1 - second) ** (k - extra)
                for first, other in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    agree = (similarity if first else 1 - similarity) * (similarity if other else 1 - similarity)
                    new[first * k + other * extra] += q * agree
        paths = new
    return 1 - float(paths[0])


def runs_for(recall: float, similarity: float, levels: int = LEVELS, second: float = SECOND) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the deepest level with the target recall."""
    return math.ceil(math.log((1 - recall) * (1 - SKETCH_SHARE)) / math.log(1 - _meeting(similarity, levels, second)))


def least_agreement(recall: float, similarity: float, tokens: int) -> int:
    """Tokens that a pair at the threshold has in common, but for the share of misses that the sketches may have."""
    below = 0.0
    for k in range(tokens + 1):
        below += math.comb(tokens, k) * similarity**k * (1 - similarity) ** (tokens - k)
        if below > (1 - recall) * SKETCH_SHARE:
            return k
    return tokens


def _child_paths(path, run, level: int, sig):
    """Paths of a class's child buckets: the path alone chooses whether the second of the level's tokens decides too."""
    child = lambda i: F.xxhash64(path, F.lit(i), F.get(sig, run * RUN_TOKENS + 2 * level + i))
    twice = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < int(SECOND * 1000)
    return F.when(twice, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def _leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(leaf, cid, size): the buckets to compare by brute force, those of one class left out."""
    at = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("path", F.xxhash64("run"))
    done = None
    for level in range(LEVELS):
        at = staged(at.select("cid", "run", F.explode(_child_paths(F.col("path"), F.col("run"), level, F.col("sig"))).alias("path")))
        sizes = at.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        at = heavy_join(at, staged(sizes), ["path"], "size", at.count())
        small = at if level == LEVELS - 1 else at.filter(F.col("size") <= LIMIT)
        small = staged(small.select(F.col("path").alias("leaf"), "cid", "size"))
        done = small if done is None else done.unionByName(small)
        if level < LEVELS - 1:
            large = staged(at.filter(F.col("size") > LIMIT).select("cid", "run", "path"))
            if large.isEmpty():
                break
            at = large.join(classes.select("cid", "sig"), "cid")
    return done


def _similar(sig: np.ndarray, leaves: np.ndarray, side: np.ndarray, leaf: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one bucket whose sketches agree enough and whose least common leaf this is, in strips.

    ``side``: block of each row where a large bucket comes in two blocks, of which only the pairs across count; else 0.
    """
    n, found = len(sig), []
    strip = max(1, 2_000_000 // (n * sig.shape[1]))
    for a in range(0, n, strip):
        b = min(n, a + strip)
        agree = (sig[a:b, None, :] == sig[None, a:, :]).sum(2, dtype=np.uint16) >= least
        i, j = np.nonzero(agree)
        i, j = i + a, j + a
        keep = (j > i) & ((side[i] != side[j]) | (side.min() == side.max()))
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 20_000):
            x, y = i[c : c + 20_000], j[c : c + 20_000]
            both = (leaves[x][:, :, None] == leaves[y][:, None, :]).any(2) & (leaves[x] != 0)
            first = np.where(both, leaves[x], np.iinfo(np.int64).max).min(1)
            found.append((x[first == leaf], y[first == leaf]))
    return found


def _groups(batches, key: int = 0):
    """Whole groups of rows with equal first column, from batches that are sorted by it."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = t.column(key).to_numpy()
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for end in cut.tolist():
            yield t.slice(at, end - at)
            at = end
        rest = t.slice(at).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy()
    return values.reshape(len(flat), -1)


def _tasks(leaves: DataFrame) -> DataFrame:
    """(task, block, leaf, cid): a small bucket is one task; one of more than 4 LIMIT classes is cut into blocks, a task for each two."""
    block = 4 * LIMIT
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("parts")).cast("int")
    cut = leaves.withColumn("parts", parts).withColumn("block", own)
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.xxhash64("leaf", F.least("block", "other"), F.greatest("block", "other"))
    return each.select(task.alias("task"), "block", "leaf", "cid")


def join_classes(classes: DataFrame, sets_of, similarity: float, recall: float) -> DataFrame:
    """(cid, partner count, partner rows, least cid linked) partial rows of all pairs of classes at the threshold."""
    runs = runs_for(recall, similarity)
    leaves = staged(_leaves(classes, runs))
    every = leaves.groupBy("cid").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    tasks = _tasks(leaves).join(every.join(classes.select("cid", "sig", "copies"), "cid"), "cid")
    least = least_agreement(recall, similarity, runs * RUN_TOKENS)

    def candidates(batches):
        for g in _groups(batches):
            if g.num_rows < 2:
                continue
            cid, copies = g.column("cid").to_numpy(), g.column("copies").to_numpy()
            mine = g.column("leaves").combine_chunks()
            size = np.diff(mine.offsets.to_numpy())
            lists = np.zeros((len(cid), int(size.max())), np.int64)
            lists[np.arange(lists.shape[1]) < size[:, None]] = mine.flatten().to_numpy()
            found = _similar(_matrix(g.column("sig")), lists, g.column("block").to_numpy(), g.column("leaf")[0].as_py(), least)
            i, j = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
            if not len(i):
                continue
            rows = np.unique(np.concatenate([i, j]))
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(i, rows, side="right")
            starts = np.searchsorted(i, rows, side="left")
            # the pairs of a row follow each other, so the lists of all rows are one array
            partners = pa.LargeListArray.from_arrays(np.append(starts, ends[-1]), pa.array(cid[j])).cast(pa.list_(pa.int64()))
            task = pa.array(np.full(len(rows), g.column("task")[0].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([task, pa.array(cid[rows]), pa.array(copies[rows]), partners], names=["task", "cid", "copies", "partners"])

    ordered = tasks.select("task", "cid", "block", "leaf", "copies", "leaves", "sig").repartition("task").sortWithinPartitions("task")
    wanted = staged(ordered.mapInArrow(candidates, "task long, cid long, copies long, partners array<long>"))
    sets = sets_of(wanted.select("cid").distinct())

    def verify(batches):
        for g in _groups(batches):
            cid = g.column("cid").to_numpy()
            at: dict[int, int] = {}
            for i, c in enumerate(cid.tolist()):
                at.setdefault(c, i)
            copies = g.column("copies").to_numpy()
            members, partners = g.column("set").combine_chunks(), g.column("partners").combine_chunks()
            edge, flat = members.offsets.to_numpy(), members.flatten().to_numpy()
            pedge, pflat = partners.offsets.to_numpy(), partners.flatten().to_numpy()
            links, rows, low = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), cid.copy()
            pairs = [np.zeros((0, 2), np.int64)]
            for i in at.values():
                theirs = np.unique(pflat[pedge[i] : pedge[i + 1]])
                js = np.array([at[c] for c in theirs.tolist()], np.int64)
                mine = flat[edge[i] : edge[i + 1]]
                size = edge[js + 1] - edge[js]
                ok = np.minimum(size, len(mine)) >= similarity * np.maximum(size, len(mine))
                js, size = js[ok], size[ok]
                if not len(js):
                    continue
                pool = np.concatenate([flat[edge[j] : edge[j + 1]] for j in js.tolist()])
                pos = np.minimum(np.searchsorted(mine, pool), len(mine) - 1)
                shared = np.add.reduceat((mine[pos] == pool).astype(np.int64), np.cumsum(size) - size)
                js = js[shared >= similarity * (size + len(mine) - shared) - 1e-9]
                links[i] += len(js)
                rows[i] += copies[js].sum()
                links[js] += 1
                rows[js] += copies[i]
                pairs.append(np.stack([np.full(len(js), i), js], 1))
            i, j = np.concatenate(pairs).T
            while len(i):  # the least class of each component of this task's pairs
                before = low.copy()
                both = np.minimum(low[i], low[j])
                np.minimum.at(low, i, both)
                np.minimum.at(low, j, both)
                if (before == low).all():
                    break
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (cid, links, rows, low)], names=["cid", "links", "rows", "low"])

    ready = wanted.join(sets, "cid").select("task", "cid", "copies", "partners", "set").repartition("task").sortWithinPartitions("task")
    return staged(ready.mapInArrow(verify, "cid long, links long, rows long, low long"))


def _classified(docs: DataFrame, n: int, similarity: float, recall: float, key: str, text: str) -> DataFrame:
    """(key, th, lead_key, lead_th, copy_id, copies, links, texts) for every row; th is the hash of its text."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))

    tokens = runs_for(recall, similarity) * RUN_TOKENS

    def describe(texts: list[str | None]):
        sets = shingles(texts, n)
        cids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
        return [cids, sketch(sets, tokens)]

    with temporary(docs.sparkSession) as keep:
        rows = staged(with_text_columns(slim, "text", {"cid": "long", "sig": "array<int>"}, describe, keep_text=False))
        worded = rows.filter("cid is not null")
        first = F.struct(F.col("key").isNull().alias("none"), "key", "th")
        least = staged(worded.groupBy("cid").agg(F.min(first).alias("first"), F.count("*").alias("copies")))
        # rows of a class have equal sketches, of which one is kept before the shuffle, so copies never gather in a task
        classes = staged(worded.groupBy("cid").agg(F.count("*").alias("copies"), F.any_value("sig").alias("sig")))

        def sets_of(wanted: DataFrame) -> DataFrame:
            """(cid, set) of the wanted classes, from the text of each one's first row."""
            chosen = least.join(wanted, "cid").select("cid", F.col("first.key").alias("chosen"), F.col("first.th").alias("th"))
            texts = slim.join(chosen.withColumnRenamed("th", "own"), (F.col("th") == F.col("own")) & F.col("key").eqNullSafe(F.col("chosen"))).select("cid", "text").dropDuplicates(["cid"])
            return with_text_columns(texts, "text", {"set": "array<long>"}, lambda t: [[np.sort(s.view(np.int64)) for s in shingles(t, n)]], keep_text=False)

        links = join_classes(classes, sets_of, similarity, recall)
        roots = components(links.select(F.col("cid").alias("u"), F.col("low").alias("v"))).withColumnRenamed("node", "cid")
        counts = links.groupBy("cid").agg(F.sum("links").alias("texts"), F.sum("rows").alias("links"))
        linked = least.join(counts, "cid").join(roots, "cid")
        linked = staged(linked)
        leads = staged(linked.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("members")))
        linked = heavy_join(linked, leads, ["root"], "members", linked.count()).select("cid", "texts", "links", "lead")
        told = staged(least.join(linked, "cid", "left").withColumn("lead", F.coalesce("lead", "first")))
        keep(rows, told)
    # a class that many rows have is told by broadcast; rows without a word are in none
    worded_rows = rows.select("key", "th", "cid").filter("cid is not null")
    found = heavy_join(worded_rows, told, ["cid"], "copies", rows.count())
    found = found.unionByName(rows.select("key", "th", "cid").filter("cid is null"), allowMissingColumns=True)
    alone = F.col("cid").isNull()
    return found.select(
        "key", "th",
        F.when(alone, F.col("key")).otherwise(F.col("lead.key")).alias("lead_key"),
        F.when(alone, F.col("th")).otherwise(F.col("lead.th")).alias("lead_th"),
        F.when(alone, F.col("key")).otherwise(F.col("first.key")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"),
    )


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, copy_id, n_copies, n_links, n_linked_texts) for every row of ``docs``.

    copy_id: least key of the rows with the same set of word n-grams (lower-cased runs of letters and digits), n_copies
    their number; n_linked_texts: other sets at Jaccard similarity ``similarity`` or more; n_links: other rows with the
    same or such a set; class_id: least key of the connected component. A text without a word (null and empty texts too)
    links to nothing and is its own class. A null key counts as larger than any other. Pairs at the threshold are found
    with a chance of at least ``recall`` each and closer pairs with a larger one; every accepted pair is exact up to
    64-bit hash collisions.
    """
    found = _classified(docs, n, similarity, recall, key, text)
    return found.select(
        F.col("key").alias(key), F.col("lead_key").alias("class_id"), "copy_id", F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("texts").alias("n_linked_texts"),
    )


def keep_one(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least key, on ties the least hash of its text.

    Rows with equal key and text are one document. Texts without a word are in no group. All columns stay, whatever
    their names.
    """
    found = _classified(docs, n, similarity, recall, key, text)
    stays = found.filter(F.col("key").eqNullSafe(F.col("lead_key")) & F.col("th").eqNullSafe(F.col("lead_th")))
    stays = stays.select(F.struct("key", "th").alias("row")).distinct()
    rows = packed(docs, row=F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("th")))
    return unpacked(rows.join(stays, "row", "left_semi").dropDuplicates(["row"]), docs.columns)
