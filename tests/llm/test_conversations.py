"""Conversation repair against a uniform-cost search of single conversations."""

import hashlib
import heapq
import random
import zlib

import pytest

from graphloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, part int, sig string"
SPACE = " \t\n\v\f\r"


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def reference(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        state = "" if not made else made[-1]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        wanted = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, made + wanted))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                extra, initial = 3 * (faults[i] == "truncated"), rows[i][1][:1]
                if initial == wanted or initial == "s" and not made:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, made + initial))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, made + wanted))
    lines, i, state = [], 0, ""
    for edit in audit:
        role = "assistant" if state == "u" else "user"
        if edit == "I":
            lines.append(f"{role}:")
        elif edit != "D":
            role = rows[i][1] if edit == "K" else role
            lines.append(f"{role}:{rows[i][2]}")
        state = state if edit == "D" else role[0]
        i += edit != "I"
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation(rng, conv, most):
    roles = ["user", "assistant", "user", "assistant", "system", "sage", "understudy", "tool", "", None]
    texts = ["Yes.", "No", "Why?", "", " \n", "So!\t", " ", None, "Fine. ", "é"]
    own = [(conv, rng.choice([None, *range(12)]) if rng.random() < 0.3 else k, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 4)}.") for k in range(rng.randint(1, most))]
    return own + [rng.choice(own)] * (rng.random() < 0.3)


@pytest.mark.parametrize("block_rows", [2, 256])
def test_repair_against_search(spark, block_rows):
    rng = random.Random(block_rows)
    data = [r for c in range(250) for r in conversation(rng, c if c else None, 9)]
    data += [r for c in range(300, 304) for r in conversation(rng, c, 120)]
    rng.shuffle(data)
    table = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(table), block_rows).collect()}
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, rows in by.items():
        assert got[conv] == reference(spoiled(rows)), conv


def test_one_long_conversation_of_equal_rows(spark):
    data = [(1, t // 50, "user" if t % 2 else "assistant", "Same." if t % 3 else f"No {t}", 1, "x") for t in range(1500)] + [(2, None, "user", None, 1, "x")] * 200
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(data, SCHEMA), 16).collect()}
    for conv in (1, 2):
        rows = [(t, r, " " if x is None else x) for c, t, r, x, *_ in data if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        assert got[conv] == reference(rows)


def test_nothing_left_and_nothing_given(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "x")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_nodes_are_the_least_cost():
    rng = random.Random(3)
    for _ in range(300):
        sig = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7)))
        node = conversations.ENDING
        for letter in reversed(sig):
            node = conversations.before(letter, node)
        costs = conversations.product(sig)
        assert all(node[0][q] == min(costs[4 * q + t] + conversations.ENDING[0][t] for t in range(4)) for q in range(4))
