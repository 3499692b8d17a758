"""Conversation structure repair by a square-root checkpointed dynamic program.

Rows of a conversation are kept, given another role, deleted, and turns are inserted, so that the initials of the roles
match ``(s?(ua)+)?`` at least cost; of the cheapest edits the ASCII-least are taken. The program keeps four numbers a
row, the cost of the rest from each state of the pattern. Of these vectors only those at about every square root of the
number of rows are stored on the way back; the walk forward makes the others anew, a stretch at a time.

Conversations of any length are spread: rows are ordered by ranges and cut to blocks of at most 2 ** BLOCK_BITS rows. A block's
4 x 4 table of costs between states is enough to pass vectors over it, so the vectors at the bounds of blocks come from
the tables alone, and each block then walks by itself, once for each state that it may begin in.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell.llm.shared import caches, staged

#: Bits of the number of rows in a block.
BLOCK_BITS = 12
#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The white space of a blank text.
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a. Where an insertion or a new role leads, and its role.
ADDED = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: State after keeping a row with the initial s, u, a or another, from each state; -1: not allowed.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: Cost of ending in each state, by insertions.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


def damaged(rows: DataFrame, key: Column) -> DataFrame:
    """(c, turn, role, text) of a conversations table after faults set by crc32(``key``) % 20; ``c`` is a struct of conv_id.

    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user. Null roles and texts are
    one space.
    """
    slim = rows.select(F.struct("conv_id").alias("c"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return slim.filter("fault <> 0").select("c", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


@lru_cache(1 << 14)
def _before(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs of the rest before a row, from those after it; ``kind`` is 3 * initial + (0 whole, 1 truncated, 2 to be deleted)."""
    initial, state = divmod(kind, 3)
    cost = [DELETE + x for x in after]
    if state < 2:
        stays = TRUNCATED * state
        for s in range(4):
            cost[s] = min(cost[s], stays + REROLE + after[ADDED[s]])
            if KEPT[s][initial] >= 0:
                cost[s] = min(cost[s], stays + after[KEPT[s][initial]])
    u, a = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + u), min(cost[1], INSERT + u), u, a


def _back(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """``_before`` by way of its cache: costs are taken relative to the least, so that few different vectors occur."""
    least = min(after)
    return tuple(least + x for x in _before(tuple(min(x - least, FAR) for x in after), kind))


def table(kinds: list[int]) -> list[int]:
    """Least costs between the states before and after some rows, row by row of the 4 x 4 table."""
    columns = []
    for end in range(4):
        costs: tuple[int, ...] = tuple(0 if s == end else FAR for s in range(4))
        for kind in reversed(kinds):
            costs = _back(costs, kind)
        columns.append(costs)
    return [columns[end][s] for s in range(4) for end in range(4)]


def walk(kinds: list[int], end: tuple[int, ...], starts: list[int], last: bool = True) -> list[tuple[str, int, int]]:
    """For each start state: the ASCII-least of the cheapest edits, the state after them and their cost.

    ``end`` are the costs of what follows in each state; with ``last`` nothing does but insertions, which are made too.
    """
    n = len(kinds)
    step = isqrt(max(n - 1, 0)) + 1
    stored, costs = {n: tuple(end)}, tuple(end)
    for i in range(n - 1, -1, -1):
        costs = _back(costs, kinds[i])
        if i % step == 0:
            stored[i] = costs
    walks = [[[], s, 0] for s in starts]
    for first in range(0, n, step):
        stop = min(first + step, n)
        vectors = [stored[stop]]
        for i in range(stop - 1, first, -1):
            vectors.append(_back(vectors[-1], kinds[i]))
        vectors.append(stored[first])
        vectors.reverse()
        for one in walks:
            letters, s, paid = one
            for i in range(first, stop):
                here, after = vectors[i - first], vectors[i - first + 1]
                initial, state = divmod(kinds[i], 3)
                stays = TRUNCATED * state
                while True:
                    if here[s] == DELETE + after[s]:
                        letters.append("D")
                        paid += DELETE
                    elif here[s] == INSERT + here[ADDED[s]]:
                        letters.append("I")
                        paid += INSERT
                        s = ADDED[s]
                        continue
                    elif KEPT[s][initial] >= 0 and here[s] == stays + after[KEPT[s][initial]]:
                        letters.append("K")
                        paid += stays
                        s = KEPT[s][initial]
                    else:
                        letters.append("R")
                        paid += stays + REROLE
                        s = ADDED[s]
                    break
            one[1:] = s, paid
    if last:
        for one in walks:
            while END[one[1]]:
                one[0].append("I")
                one[1:] = ADDED[one[1]], one[2] + INSERT
    return [("".join(letters), s, paid) for letters, s, paid in walks]


def _mapped(rows: DataFrame, schema: str, make) -> DataFrame:
    """A row for each that ``make`` yields from each given row, both as dicts."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        caches("conversation_repair", _before.cache_clear)
        for batch in batches:
            made = [out for row in batch.to_pylist() for out in make(row)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in made], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def _ends(row: dict):
    """The vectors after each block of a conversation, from the blocks' tables."""
    costs: tuple[int, ...] = END
    for block in reversed(row["blocks"]):
        yield {"c": row["c"], "chunk": block["chunk"], "end": list(costs)}
        costs = tuple(min(block["costs"][4 * s + e] + costs[e] for e in range(4)) for s in range(4))


def _walked(row: dict):
    last, kinds = bool(row["last"]), row["kinds"]
    made = walk(kinds, tuple(row["end"] or END), [0] if row["first"] else [0, 1, 2, 3], last)
    initials = [k // 3 for k in kinds]
    illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))
    yield row | {"walks": [{"letters": x, "state": s, "paid": p} for x, s, p in made], "illegal": illegal, "opens": initials[0], "closes": initials[-1]}


def _joined(row: dict):
    """One walk for each block, each beginning in the state that the one before it ends in."""
    state = cost = illegal = 0
    edits, before = [], None
    for block in row["blocks"]:
        one = block["walks"][state if len(block["walks"]) > 1 else 0]
        edits.append({"place": block["place"], "state": state, "letters": one["letters"]})
        illegal += block["illegal"] + (before is not None and (before, block["opens"]) not in ((0, 1), (1, 2), (2, 1)))
        cost, state, before = cost + one["paid"], one["state"], block["closes"]
    yield {"c": row["c"], "audit": "".join(e["letters"] for e in edits), "cost": cost, "illegal": illegal, "edits": edits}


def _hashes(batches):
    """(c, repaired_sha256) from rows in the order of conversations and places, each block's edits before its rows.

    Holds one batch and the state of one hash, however long a conversation is.
    """
    now, digest, letters, at, state, any_line = None, None, "", 0, 0, False

    def line(text: str):
        nonlocal any_line
        digest.update((("\n" if any_line else "") + text).encode("utf-8", "surrogatepass"))
        any_line = True

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            line(ROLE[state] + ":")
            at, state = at + 1, ADDED[state]

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is None or row["c"] != now:
                if now is not None:
                    inserted()
                    done.append((now, digest.hexdigest()))
                now, digest, letters, at, any_line = row["c"], hashlib.sha256(), "", 0, False
            if row["letters"] is not None:
                inserted()
                letters, at, state = row["letters"], 0, row["state"]
                continue
            inserted()
            edit, at = letters[at], at + 1
            if edit == "R":
                line(f"{ROLE[state]}:{row['text']}")
                state = ADDED[state]
            elif edit == "K":
                line(f"{row['role']}:{row['text']}")
                state = KEPT[state][{"s": 0, "u": 1, "a": 2}[row["role"][0]]]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.schema.field("c").type), pa.array([x for _, x in done])], names=["c", "sha"])
    if now is not None:
        inserted()
        yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field("c").type), pa.array([digest.hexdigest()])], names=["c", "sha"])


def repair(rows: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every ``c`` of (c, turn, role, text).

    Rows stand by turn, null turns first, then by role and hash of the text; roles and texts must not be null. A row is
    blank without a character other than white space, else a duplicate if role and text stand earlier, else truncated if
    the last such character is none of ``.!?``. ``illegal`` counts neighbours whose initials are not su, ua or au.
    ``audit`` has a letter for each edit (Keep, Rerole, Delete, Insert). Repeated rows are duplicates. No row, no result.

    No task holds a conversation but as its letters: rows are dealt by ranges, equal rows meet in aggregates that are
    combined first, blocks have at most 2 ** BLOCK_BITS rows. Only the hash, a sum over all texts of a conversation in
    order, is made by one task each, as a stream.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("c").schema.fields)
    order = ["c", "turn", "role", "th"]
    keyed = rows.withColumn("th", F.xxhash64("text"))
    placed = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("th").withColumn("place", F.monotonically_increasing_id()))
    bare = F.rtrim("text", F.lit(SPACE))
    firsts = placed.groupBy("c", "role", F.md5("text").alias("hash")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    slim = placed.select("c", "turn", "place", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    marked = slim.join(firsts, "place", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    marked = marked.withColumn("fault", fault).withColumn("kind", initial * 3 + F.when(F.col("fault") == "", 0).when(F.col("fault") == "truncated", 1).otherwise(2))
    # a block and what is counted in it; turns may be counted in two neighbouring blocks, so they have an aggregate of their own
    faults = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    inside = F.array_sort(F.collect_list(F.struct("place", "kind")))
    blocks = staged(marked.groupBy("c", F.shiftright("place", BLOCK_BITS).alias("chunk")).agg(inside.alias("rows"), *faults).select("c", "chunk", F.col("rows")[0]["place"].alias("place"), F.col("rows.kind").alias("kinds"), "blank", "duplicate", "truncated"))
    spans = blocks.groupBy("c").agg(F.count("*").alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).filter("n > 1")
    many = blocks.join(spans, "c")
    tables = _mapped(many.select("c", "chunk", "kinds"), f"{kind}, chunk long, costs array<long>", lambda r: [{"c": r["c"], "chunk": r["chunk"], "costs": table(r["kinds"])}])
    ends = _mapped(tables.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("chunk", "costs"))).alias("blocks")), f"{kind}, chunk long, end array<long>", _ends)
    ends = ends.join(spans, "c").select("c", "chunk", "end", (F.col("chunk") == F.col("low")).alias("first"), (F.col("chunk") == F.col("high")).alias("last"))
    whole = F.coalesce("first", F.lit(True)).alias("first"), F.coalesce("last", F.lit(True)).alias("last")
    ready = blocks.join(ends, ["c", "chunk"], "left").select("c", "chunk", "place", "kinds", "end", *whole)
    walked = _mapped(ready, f"{kind}, chunk long, place long, walks array<struct<letters:string,state:int,paid:long>>, illegal long, opens int, closes int", _walked)
    parts = walked.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*(x for x in walked.columns if x != "c")))).alias("blocks"))
    edited = staged(_mapped(parts, f"{kind}, audit string, cost long, illegal long, edits array<struct<place:long,state:int,letters:string>>", _joined))
    edits = edited.select("c", F.explode("edits").alias("e")).select("c", "e.place", "e.state", "e.letters", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = placed.select("c", "place", F.lit(0).alias("state"), F.lit(None).cast("string").alias("letters"), "role", "text")
    ordered = edits.unionByName(lines).repartition("c").sortWithinPartitions("c", "place", F.col("letters").isNull())
    hashed = ordered.mapInArrow(_hashes, f"{kind}, sha string")
    turns = placed.filter("turn is not null").groupBy("c", "turn").count().groupBy("c").agg(F.count("*").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    wide = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    gaps = F.least(wide, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    counts = blocks.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    found = counts.join(edited.drop("edits"), "c").join(hashed, "c").join(turns.select("c", gaps.alias("gaps")), "c", "left")
    return found.select("c", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """A row for every conv_id of ``rows`` (conv_id, turn, role, text): faults of ``damaged`` set, then ``repair``.

    A null conv_id is a conversation of its own. In the key of a fault a null conv_id or turn is one space. Conversations
    whose rows are all dropped have zeros, an empty audit and the hash of an empty text. Rows with equal conv_id and turn
    have the same fault. An empty table gives none.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    found = repair(damaged(rows, key))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = rows.select(F.struct("conv_id").alias("c")).distinct().join(found, "c", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("c.conv_id", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
