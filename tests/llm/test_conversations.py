"""Conversation repair against a search over all ways, in one piece and in blocks."""

import hashlib
import heapq
import random
import zlib

import pytest

from tilewright.llm import conversation_repair as C
from tilewright.llm import role_grammar as G

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute(rows):
    """Least (cost, labels, lines) by a uniform-cost search over prefixes; rows: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, best, least = [(0, "", 0, "", ())], None, {}
    while heap:
        cost, labels, at, state, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and state in ("", "a") and (best is None or (cost, labels) < best[:2]):
            best = (cost, labels, lines)
        if least.setdefault((at, state, labels[len(labels.rstrip("I")):]), (cost, labels)) < (cost, labels):
            continue
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT and not labels.endswith("II"):
                heapq.heappush(heap, (cost + 2, labels + "I", at, role[0], (*lines, role + ":")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 3, labels + "D", at + 1, state, lines))
        if faults[at] not in ("blank", "duplicate"):
            more = faults[at] == "truncated"
            if (state, role[:1]) in NEXT:
                heapq.heappush(heap, (cost + more, labels + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (state, new[0]) in NEXT:
                    heapq.heappush(heap, (cost + 2 + more, labels + "R", at + 1, new[0], (*lines, f"{new}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    heads = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), "cost": best[0], "audit": best[1],
        "repaired_sha256": hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    }


def damage(table):
    """Rows by conversation after damage, in plain Python."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, rows in out.items()}


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Ärger", None]
    texts = ["Yes.", "No", "  ", "", "Why?\n", "a.\u0085", "Fine!", None]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}" + rng.choice([".", ""])) for _ in range(n)]


def test_cheapest_edits_equal_search():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(t, r or " ", x or " ") for t, r, x in random_rows(rng, rng.randrange(7))]
        assert C.repair_rows(rows) == brute(rows)


def test_blocks_follow_as_a_whole():
    rng = random.Random(4)
    for _ in range(60):
        symbols = "".join(rng.choice("suaxSUAXDuauaua") for _ in range(rng.randrange(1, 30)))
        size = rng.randrange(1, 9)
        weight, states = G.follow([G.block_ways(symbols[k : k + size]) for k in range(0, len(symbols), size)])
        assert weight == G.repair(symbols) and states[0][0] == 0


def test_ties_take_the_least_labels():
    assert G.repair("") == (0, "")
    assert G.repair("s") == (3, "D")
    assert G.repair("u") == (2, "KI")
    assert G.repair("uu") == (2, "KR")
    assert G.repair("D") == (3, "D")


@pytest.mark.parametrize("limits", [(2048, 16 << 20, 256), (3, 16 << 20, 2), (2048, 20, 3)])
def test_tables_equal_search(spark, limits):
    rng = random.Random(5)
    table = [(conv, *row) for conv in (None, 0, 1, 2, 3, 5, 8, 13) for row in random_rows(rng, rng.randrange(1, 6))]
    table += [(77, t, "user" if t % 2 else "assistant", f"Row {t}.") for t in range(40)] + [(78, None, "user", "Same.")] * 25 + [(79, 4, None, None)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"80:{t}".encode()) % 20 == 0)
    table.append((80, dropped, "user", "Gone."))
    rng.shuffle(table)
    df = spark.createDataFrame([(*r, 1) for r in table], "conv_id long, turn long, role string, text string, part int").repartition(3)
    found = {r["conv_id"]: r.asDict() for r in C.audit_conversations(df, C.damaged(df)).collect()}
    want = damage(table)
    assert set(found) == set(want) and len(want) == 12
    if limits != (2048, 16 << 20, 256):
        found = {r["conv_id"]: r.asDict() for r in C.repair_conversations(C.damaged(df), *limits).collect()}
        want = {conv: rows for conv, rows in want.items() if rows}
        assert set(found) == set(want)
    for conv, rows in want.items():
        got = dict(found[conv])
        got.pop("conv_id")
        if len(rows) <= 12:
            assert got == brute(rows), conv
        else:
            assert got == C.repair_rows(rows), conv


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.audit_conversations(df, C.damaged(df)).collect() == []
