"""Repaired conversations against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from siftwell.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, c string, place int"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds):
    """The least (cost, letters) that reaches the end, by search from the start; ``kinds`` are (initial, fault)."""
    pattern = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(kinds) and s in (0, 3):
            return cost, letters
        for x in "ua":
            if (s, x) in pattern:
                heapq.heappush(heap, (cost + 3, letters + "I", i, pattern[s, x]))
        if i < len(kinds):
            initial, fault = kinds[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, s))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (s, initial) in pattern:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, pattern[s, initial]))
                for x in "ua":
                    if (s, x) in pattern:
                        heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, pattern[s, x]))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            left += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in left:
            bare = SPACE.findall(text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in left]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        lines, state, i = [], "", 0
        for letter in audit:
            role = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(role + ":")
            else:
                own, text = left[i][1:]
                i += 1
                if letter == "D":
                    continue
                role = role if letter == "R" else own
                lines.append(f"{role}:{text}")
            state = role[0]
        turns = [r[0] for r in left if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def result(spark, rows):
    found = cr.repaired_conversations(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in found.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"]
    texts = ["Fine.", "cut", "Why?", " \n", "", None, "end! \t", "x" * 5000 + ".", "Ü über"]
    out = []
    for conv in [*range(120), None]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([1, 1, 1, 3])
            out.append((conv, turn, rng.choice(roles), f"{turn}{rng.choice(texts) or ''}" if rng.random() < 0.7 else rng.choice(texts)))
    out += [(500, None, "user", "first."), (500, 2, "assistant", "last."), (501, None, "user", None), (502, None, None, None), (503, -(1 << 62), "user", "a."), (503, 1 << 62, "assistant", "b.")]
    out += [(900, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(300)]  # of many blocks
    return out + [next(r for r in out if r[0] == 7)] * 2


@pytest.mark.parametrize("bits", [12, 3, 1])
def test_repair(spark, monkeypatch, rows, bits):
    """Conversations in one block and in many of up to 8 and 2 rows."""
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)
    got, want = result(spark, rows), brute(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_walks_against_a_search():
    rng = random.Random(2)
    for _ in range(400):
        kinds = [(rng.choice("suuaax"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(1, 40))]
        coded = [3 * "suax".index(i) + ("" != f) + (f == "blank") for i, f in kinds]
        ((letters, _, cost),) = cr.walk(coded, cr.END, [0])
        assert (cost, letters) == cheapest(kinds)


def test_stored_vectors_grow_with_the_root(monkeypatch):
    """The walk back stores about sqrt(n) vectors and the walk forward makes each of the others once more."""
    made = []
    before = cr._back
    monkeypatch.setattr(cr, "_back", lambda after, kind: made.append(kind) or before(after, kind))
    kinds = [3, 6] * 5000
    assert cr.walk(kinds, cr.END, [0])[0] == ("K" * 10000, 3, 0)
    assert len(made) <= 2 * len(kinds)


def test_all_dropped_and_empty(spark):
    turns = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    got = result(spark, [(5, t, "user", "hello.") for t in turns])
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(spark, []) == {}
