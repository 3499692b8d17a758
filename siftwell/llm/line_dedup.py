"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Equal normalised lines are one class. A class's signature holds least and greatest hashes of its character shingles in
several orders, each of which two lines share with a chance equal to their Jaccard similarity. Bands of four signature
values propose the pairs of their buckets, the exact Jaccard similarity of the shingle sets decides, and union-find over
the accepted pairs leaves one line, the earliest, of each component.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.shared import heavy_join, packed, staged, temporary, unpacked

#: Characters of a shingle; shingles that one row of the signing stage holds.
SHINGLE, STEP = 8, 8
#: Hashes of a shingle, and the bits from which each gives an order of its own: two values (least, greatest) for each.
HASHES, WINDOWS = 2, (0, 16, 32, 48)
#: The signature values of each band, one of each window; two bands have at most one value in common (i + j and i + 2 j over
#: the field of four elements). A pair at 0.8 shares a band with a chance of 0.989, one at 0.85 with 0.997, at 0.9 with 0.9995.
BANDS = tuple((i, 4 + j, 8 + (i ^ j), 12 + (i ^ (0, 2, 3, 1)[j])) for i in range(4) for j in range(4))
#: Equal signature values without which a pair is not compared: one at 0.8 has fewer with a chance of 0.0007.
AGREE = 8
#: Classes up to which texts are looked up by broadcast (16 bytes each); pairs of one line that are compared in one part.
BROADCAST_IDS, HUB = 1_000_000, 200
#: Size from which a bucket's pairs are compared in blocks; lines and shingles of a block.
LARGE, BLOCK, BLOCK_SHINGLES = 64, 800, 2_000_000
#: Partitions over which the meetings of blocks are spread at most.
MEETINGS = 10_000
#: Words of 64 bits of a line's bitmap, and shingles that one task puts into bitmaps.
WORDS, TASK_SHINGLES = 32, 500_000
#: Times that all members of a large bucket meet two more of its lines before its remaining pairs are compared.
TURNS = 1


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, line, norm, id) of every line with something other than white space; th is the hash of the whole text.

    norm is the line in lower case without outer white space, id its 64-bit hash.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.split(F.lower(text), "\n").alias("raws"))
    each = rows.select("key", "th", F.posexplode("raws").alias("line", "raw"))
    norm = F.btrim("raw", F.lit(" \t\r\x0b\x0c"))
    return each.select("key", "th", "line", norm.alias("norm")).filter("norm <> ''").withColumn("id", F.xxhash64("norm"))


def _count(wide: Column) -> Column:
    """Shingles of a line in UTF-16, two bytes a character (four for the rare ones beyond it); a shorter line is one."""
    return F.greatest(F.lit(1), (F.octet_length(wide) / 2).cast("int") - (SHINGLE - 1))


def _hash(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(2 * SHINGLE)))


def _shingles(norm: str) -> Column:
    """The distinct shingle hashes of a line.

    The outer transform binds the encoded line once; a slice of it takes constant time.
    """
    cut = lambda wide: F.transform(F.sequence(F.lit(1), _count(wide) * 2 - 1, F.lit(2)), lambda at: _hash(wide, at))
    return F.array_distinct(F.transform(F.array(F.encode(norm, "UTF-16BE")), cut)[0])


def _mask(j: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"line {j}".encode(), digest_size=8).digest(), "little", signed=True)


def signatures(lines: DataFrame) -> DataFrame:
    """(id, n, sig): for each class of ``lines`` (id, norm) its number of lines and its signature, 32 bits a value.

    A row holds STEP shingles, so that a value is compared within the row before it meets the class's: least and greatest
    of each window of bits of each hash. Equal lines have equal values, so their rows merge on either side of the shuffle.
    """
    wide = lines.select("id", F.encode("norm", "UTF-16BE").alias("wide")).withColumn("last", _count(F.col("wide")) - 1)
    each = wide.select("id", "wide", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("p"))
    at = [F.least(F.col("p") + i, F.col("last")) for i in range(STEP)]  # past the end the last shingle comes again
    rows = each.select("id", "p", *(_hash(F.col("wide"), p * 2 + 1).alias(f"h{i}") for i, p in enumerate(at)))
    values = []
    for w in WINDOWS:
        for j in range(HASHES):
            hashes = [F.xxhash64(F.col(f"h{i}").bitwiseXOR(F.lit(_mask(j)))) if j else F.col(f"h{i}") for i in range(STEP)]
            order = [F.shiftleft(h, w) if w else h for h in hashes]
            values += [F.min(F.least(*order)).alias(f"low_{w}_{j}"), F.max(F.greatest(*order)).alias(f"high_{w}_{j}")]
    signed = rows.groupBy("id").agg(F.count_if(F.col("p") == 0).alias("n"), *values)
    return signed.select("id", "n", F.array(*(F.shiftright(c, 32).cast("int") for c in signed.columns[2:])).alias("sig"))


def _band(b: int, sig: Column) -> Column:
    return F.xxhash64(F.lit(b), *(sig[i] for i in BANDS[b]))


def _members(signed: DataFrame) -> DataFrame:
    """(band, id): the hashes of the bands of each class's signature."""
    return signed.select("id", F.explode(F.array(*(_band(b, F.col("sig")) for b in range(len(BANDS))))).alias("band"))


def _buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of all buckets of two lines, and the members (band, id, low, size) of larger ones."""
    members = _members(signed)
    buckets = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
    buckets = staged(buckets.filter("size > 1"))
    larger = buckets.filter("size > 2").select("band", "low", "size")
    inside = staged(heavy_join(members, larger, ["band"], "size", signed.count() * len(BANDS)))
    return buckets.filter("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")), inside


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, norm), a row for each of the ``wanted`` classes (id).

    Few classes are looked up by broadcast, so that no other text moves; more than BROADCAST_IDS by a shuffle of all lines,
    after equal ones have merged within their tasks.
    """
    wanted, all_lines = staged(wanted.distinct()), lines.select("id", "norm")
    if wanted.count() <= BROADCAST_IDS:
        return staged(all_lines.join(F.broadcast(wanted), "id", "left_semi").dropDuplicates(["id"]))
    return staged(all_lines.dropDuplicates(["id"]).join(wanted, "id", "left_semi"))


def _beside(pairs: DataFrame, side: str, other: str, texts: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the text of one side. A line of many pairs comes in as many parts (``parts_a``, ``parts_b``)."""
    parts = pairs.groupBy(side).agg(F.max(f"parts_{side}").alias("parts"))
    copies = texts.withColumnRenamed("id", side).join(parts, side).select(side, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("norm").alias(name))
    own = F.pmod(F.xxhash64(other), F.col(f"parts_{side}")).cast("int")
    return pairs.withColumn("part", own).join(copies, [side, "part"]).drop("part")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, own_a, own_b) of pairs (a, b, parts_a, parts_b): distinct shingles in both lines and in each."""
    both = _beside(_beside(pairs, "a", "b", texts, "x"), "b", "a", texts, "y")
    # exploding one struct makes the sets once; as plain columns each of their uses would make them again
    sets = both.select("a", "b", F.explode(F.array(F.struct(_shingles("x").alias("s"), _shingles("y").alias("t")))).alias("x"))
    sizes = F.size(F.array_intersect("x.s", "x.t")).alias("shared"), F.size("x.s").alias("own_a"), F.size("x.t").alias("own_b")
    return sets.select("a", "b", *sizes)


def _jaccard() -> Column:
    return F.col("shared") / (F.col("own_a") + F.col("own_b") - F.col("shared"))


def _linked(compared: DataFrame, similarity: float) -> DataFrame:
    return compared.filter(F.col("shared") >= similarity * (F.col("own_a") + F.col("own_b") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hub(size) -> Column:
    return F.ceil(size / HUB).cast("int")


def _placed(inside: DataFrame, star: DataFrame, signed: DataFrame) -> DataFrame:
    """(band, id, sig, own, far): members of buckets but for the least line, and their distances to it."""
    low = star.select(F.col("a").alias("low"), F.col("b").alias("id"), F.col("own_b").alias("own"), (1 - _jaccard()).alias("far"))
    rest = inside.filter(F.col("id") != F.col("low")).join(low, ["low", "id"])
    return staged(rest.join(signed.select("id", "sig"), "id").select("band", "id", "sig", "own", "far"))


def _labels(links: DataFrame) -> DataFrame:
    """(id, label) of lines with a lesser linked one: the least of these, and the least linked to that, three steps in all.

    Lines with equal labels are in one component; those of one component may keep different labels.
    """
    parent = staged(links.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("label")))
    for _ in range(2):
        higher = parent.select(F.col("id").alias("label"), F.col("label").alias("above"))
        parent = parent.join(higher, "label", "left").select("id", F.coalesce("above", "label").alias("label"))
    return staged(parent)


def _open(placed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels, and the buckets that hold several (band, size, shingles, cross): cross is the pairs across."""
    labelled = staged(placed.join(labels, "id", "left").select(*placed.columns, F.coalesce("label", "id").alias("label")))
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("own").alias("shingles"))
    sizes = sizes.groupBy("band").agg(F.sum("n").alias("size"), F.sum("shingles").alias("shingles"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return labelled, staged(sizes.withColumn("cross", (F.col("size") * F.col("size") - F.col("same")) / 2).filter("cross > 0").select("band", "size", "shingles", "cross"))


def _able(x, y, similarity: float) -> Column:
    """Whether two members (functions from names to columns) can reach the similarity: by the sizes of their sets and as 1 - Jaccard is a metric."""
    near = F.abs(x("far") - y("far")) <= 1 - similarity + 1e-9
    sizes = F.least(x("own"), y("own")) >= (similarity - 1e-9) * F.greatest(x("own"), y("own"))
    return (x("label") != y("label")) & sizes & near


MEMBER = ("id", "own", "far", "label")


def _pivot_pairs(labelled: DataFrame, split: DataFrame, total: int, turn: int, similarity: float) -> DataFrame:
    """Pairs of each member of a split bucket with two others, chosen anew each turn."""
    member, at = F.struct(*MEMBER), F.xxhash64("id", F.lit(turn))
    pivots = labelled.groupBy("band").agg(F.min_by(member, at).alias("first"), F.max_by(member, at).alias("last")).join(split, "band").select("band", "size", F.array("first", "last").alias("ys"))
    each = heavy_join(labelled, staged(pivots), ["band"], "size", total).select(member.alias("x"), F.explode("ys").alias("y"), "size")
    met = each.filter(_able(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), similarity))
    below = F.col("y.id") < F.col("x.id")
    hub = _hub(F.col("size"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(below, hub).otherwise(1).alias("parts_a"), F.when(below, 1).otherwise(hub).alias("parts_b"))


VALUES = range(len(WINDOWS) * HASHES * 2)


def _as(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` (keys, MEMBER, sig) with the columns of a member renamed name_*, each signature value one of its own: plain columns are read fastest.

    Values are never null, which halves the code that compares them.
    """
    return rows.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in MEMBER), *(F.coalesce(F.col("sig")[i], F.lit(0)).alias(f"{name}_{i}") for i in VALUES))


def _first_met(similarity: float) -> Column:
    """Whether the members x and y of a bucket are to be compared in it: able, alike enough, and in no earlier band together."""
    same = sum((F.when(F.col(f"x_{i}") == F.col(f"y_{i}"), 1 << i).otherwise(0) for i in VALUES), F.lit(0))
    masks = [sum(1 << i for i in band) for band in BANDS]
    # a bit for each equal value, bound once: the code of the join stays short enough to be compiled
    earlier = lambda bits: F.coalesce(*(F.when(bits.bitwiseAND(F.lit(m)) == m, b) for b, m in enumerate(masks)))
    first = F.transform(F.array(same), lambda bits: F.when(F.bit_count(bits) >= AGREE, earlier(bits)))[0]
    return _able(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), similarity) & (first == F.col("number"))


def _numbered(labelled: DataFrame) -> DataFrame:
    """``labelled`` with ``number``, which of BANDS a bucket's band is."""
    return labelled.withColumn("number", F.coalesce(*(F.when(F.col("band") == _band(b, F.col("sig")), b) for b in range(len(BANDS)))))


def _bitmaps(labelled: DataFrame, split: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, word_0, ...): for each member of a split bucket the bits at its shingles' hashes modulo the bitmap's length."""
    ids = staged(labelled.join(split.select("band"), "band", "left_semi").select("id", "own").distinct())
    parts = min(MEETINGS, 1 + (ids.agg(F.sum("own")).first()[0] or 0) // TASK_SHINGLES)
    wide = texts.join(ids.select("id"), "id", "left_semi").repartition(parts, "id").select("id", F.encode("norm", "UTF-16BE").alias("wide"))
    each = wide.select("id", "wide", F.explode(F.sequence(F.lit(1), _count(F.col("wide")) * 2 - 1, F.lit(2))).alias("at"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    set_bits = each.select("id", _hash(F.col("wide"), F.col("at")).alias("h")).groupBy("id", word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    words = (F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"word_{i}") for i in range(WORDS))
    return staged(set_bits.groupBy("id").agg(*words))


def _maybe(x: str, y: str, own: Column, similarity: float) -> Column:
    """Whether the bitmaps x_word_*, y_word_* allow the similarity to lines of ``own`` shingles together.

    A bit that only one line has comes from a shingle that only this line has, so the lines differ in as many shingles at
    least as their bitmaps in bits. No pair at the similarity is left out.
    """
    bits = sum((F.bit_count(F.col(f"{x}_word_{i}").bitwiseXOR(F.col(f"{y}_word_{i}"))) for i in range(WORDS)), F.lit(0))
    return bits <= (1 - similarity) / (1 + similarity) * own + 1e-6


def _named(bitmaps: DataFrame, name: str, key: str) -> DataFrame:
    return bitmaps.select(F.col("id").alias(key), *(F.col(f"word_{i}").alias(f"{name}_word_{i}") for i in range(WORDS)))


def _small_pairs(labelled: DataFrame, split: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """(a, b, parts_a, parts_b): the pairs left in buckets of fewer than LARGE lines whose bitmaps allow the similarity."""
    some = staged(_numbered(labelled.join(split.filter(F.col("size") < LARGE).select("band"), "band")))
    met = _as(some, "x", "band", "number").join(_as(some, "y", "band"), "band").filter((F.col("x_id") < F.col("y_id")) & _first_met(similarity))
    pairs = met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), (F.col("x_own") + F.col("y_own")).alias("own"))
    both = pairs.join(_named(bitmaps, "x", "a"), "a").join(_named(bitmaps, "y", "b"), "b").filter(_maybe("x", "y", F.col("own"), similarity))
    return both.select("a", "b", F.lit(1).alias("parts_a"), F.lit(1).alias("parts_b"))


def _block_links(labelled: DataFrame, split: DataFrame, total: int, texts: DataFrame, bitmaps: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs left in buckets of LARGE lines or more that reach the similarity.

    Buckets are cut to blocks by lines and shingles, each two of which meet under a key. There a line's shingles are made
    once, and only pairs whose bitmaps allow the similarity have theirs compared.
    """
    many = F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
    parts = split.select("band", "size", F.ceil(many).cast("int").alias("parts"))
    cut = heavy_join(labelled, parts, ["band"], "size", total).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).cast("int"))
    # a task for each two blocks, up to MEETINGS: comparing is much work on few bytes
    meetings = min(MEETINGS, parts.agg(F.sum(F.expr("parts * (parts + 1) / 2")).cast("int")).first()[0] or 1)
    each = staged(_numbered(cut)).join(texts.join(bitmaps, "id"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def side(own: str, name: str, *more: str) -> DataFrame:
        # texts travel, and shingles are made where they are compared
        words = each.select("*", *(F.coalesce(f"word_{i}", F.lit(0).cast("long")).alias(f"{name}_word_{i}") for i in range(WORDS)))
        dealt = _as(words.filter(F.col("block") == F.col(own)), name, "band", "i", "j", "norm", *more, *(f"{name}_word_{i}" for i in range(WORDS))).repartition(meetings, "band", "i", "j")
        # never null, so that the join brings no test for null, which would make the shingles once more
        return dealt.withColumn(f"{name}_set", F.coalesce(_shingles("norm"), F.array().cast("array<long>"))).drop("norm")

    once = (F.col("i") != F.col("j")) | (F.col("x_id") < F.col("y_id"))
    maybe = _maybe("x", "y", F.col("x_own") + F.col("y_own"), similarity)
    met = side("i", "x", "number").join(side("j", "y"), ["band", "i", "j"]).filter(once & (F.col("x_label") != F.col("y_label")) & maybe & _first_met(similarity))
    # shared / (all - shared) >= similarity, so that the sets are intersected once
    linked = F.size(F.array_intersect("x_set", "y_set")) * (1 + similarity) >= similarity * (F.size("x_set") + F.size("y_set")) - 1e-9
    return met.filter(linked).select(F.col("x_id").alias("u"), F.col("y_id").alias("v"))


def duplicate_classes(lines: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(id, root, n): classes of equal lines that have two rows or more, or a near duplicate; root is the least id of the component."""
    with temporary(lines.sparkSession) as keep:
        signed = staged(signatures(lines.select("id", "norm")))
        two, inside = _buckets(signed)
        # each member meets the bucket's least line, which joins most families; then all pairs that this leaves open
        one = F.lit(1)
        star = inside.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"), _hub(F.col("size")).alias("parts_a"))
        star = star.unionByName(two.withColumn("parts_a", one))
        pairs = staged(star.groupBy("a", "b").agg(F.max("parts_a").alias("parts_a")).withColumn("parts_b", one))
        texts = texts_of(lines, pairs.select(F.explode(F.array("a", "b")).alias("id")))
        compared = staged(_compared(pairs, texts))
        links = _linked(compared, similarity)
        placed = _placed(inside, compared, signed)
        labelled, split = _open(placed, _labels(links))
        bitmaps = _bitmaps(labelled, split, texts)
        links = links.unionByName(staged(_linked(_compared(staged(_small_pairs(labelled, split, bitmaps, similarity)), texts), similarity)))
        for turn in range(TURNS + 1):
            large = split.filter(F.col("size") >= LARGE)
            cross, total = large.agg(F.sum("cross"), F.sum("size")).first()
            if not cross:
                break
            if turn == TURNS:
                links = links.unionByName(staged(_block_links(labelled, large, total, texts, bitmaps, similarity)))
                break
            met = _pivot_pairs(labelled, large, total, turn, similarity)
            met = staged(met.groupBy("a", "b").agg(F.max("parts_a").alias("parts_a"), F.max("parts_b").alias("parts_b")))
            links = links.unionByName(staged(_linked(_compared(met, texts), similarity)))
            labelled, split = _open(placed.join(large.select("band"), "band"), components(links).withColumnsRenamed({"node": "id", "root": "label"}))
        roots = components(links).withColumnRenamed("node", "id")
        found = staged(signed.select("id", "n").join(roots, "id", "left").filter("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "n"))
        keep(found)
    return found


def removed_lines(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, line, keep_key, keep_line): every line that goes, and the place of the one that stays for it.

    Lines are split at newlines and numbered from 0; those equal, or similar to ``similarity`` or more in 8-character
    shingles, along chains of such lines, form a component, of which the line with the least (key, hash of text, line)
    stays. Lines of white space only are never removed. Null and empty texts have no lines; a null key ranks last; rows
    with equal key and text are one document.
    """
    lines = staged(lines_of(docs, key, text))
    classes = duplicate_classes(lines, similarity)
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = staged(heavy_join(lines.select("key", "th", "line", "id"), classes, ["id"], "n", total).select("key", "th", "line", "root"))
    place = F.struct(F.col("key").isNull().alias("none"), "key", "th", "line")
    keepers = staged(found.groupBy("root").agg(F.min(place).alias("keep"), F.count("*").alias("rows")))
    gone = heavy_join(found, keepers, ["root"], "rows", total).filter(~place.eqNullSafe(F.col("keep")))
    return gone.select("key", "th", "line", F.col("keep.key").alias("keep_key"), F.col("keep.line").alias("keep_line"))


def drop_lines(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed lines, with the same columns.

    A document that loses lines and has only white space left goes too (all it said stays elsewhere); one that never had
    more than white space stays as it is.
    """
    gone = removed_lines(docs, similarity, key, text).groupBy("key", "th").agg(F.collect_set("line").alias("lines"))
    gone = gone.select(F.struct("key", "th").alias("row"), "lines")
    rows = packed(docs, row=F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("th"))).join(gone, "row", "left")
    whole = F.col("doc")[text]
    # the lines that stay are told by a set operation, and the split text is bound once: both take linear time
    stay = lambda raws: F.array_except(F.sequence(F.lit(0), F.size(raws) - 1), "lines")
    left = F.transform(F.array(F.split(whole, "\n")), lambda raws: F.array_join(F.transform(stay(raws), lambda i: raws[i]), "\n"))[0]
    cut = rows.withColumn("left", F.when(F.col("lines").isNull(), whole).otherwise(left))
    kept = cut.filter(F.col("lines").isNull() | (F.btrim("left", F.lit(" \t\r\n\x0b\x0c")) != ""))
    return unpacked(kept, docs.columns, **{text: F.col("left")})
