"""Conversation repair against a chart over all spans and against plain search."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from fieldspark.llm import dialogues as dg
from fieldspark.llm import queries

SOLID = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by search over (cost, audit, place, rows read)."""
    queue = [(0, "", 0, 0, ())]
    while queue:
        cost, audit, i, place, out = heapq.heappop(queue)
        if i == len(rows) and place in (0, 3):
            return cost, audit, out
        # "" start, 1 after system, 2 after user, 3 after assistant
        def go(role, i, cost, letter, row):
            step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, place))
            if step:
                heapq.heappush(queue, (cost, audit + letter, i, step, (*out, row)))
        if cost < 5 * len(rows) + 12:
            for r in "ua":
                go(r, i, cost + 5, "I", (NAMES[r], ""))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, place, out))
            if faults[i] not in "bd":
                more = 5 if faults[i] == "t" else 0
                go(role[:1], i + 1, cost + more, "K", (role, text))
                for r in "ua":
                    go(r, i + 1, cost + more + 1, "R", (NAMES[r], text))


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for conv, turn, role, text in broken(rows):
        convs[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text, turn))
    out = {}
    for conv, every in convs.items():
        every.sort(key=lambda r: r[:4])
        turns = [r[5] for r in every if r[5] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, _, text, _ in every:
            solid = SOLID.findall(text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
            seen.add((role, text))
        initials = [r[2][:1] for r in every]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest([(r[2], r[4]) for r in every], faults)
        text = "\n".join(f"{a}:{b}" for a, b in fixed)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_one_split_equals_the_whole_chart():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 11)
        symbols = [rng.choice("sua?") + rng.choice("---xt") for _ in range(n)]
        chart = {(i, i + 1): dg.row_cell(s) for i, s in enumerate(symbols)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                cell = {}
                for k in range(i + 1, i + length):
                    for at, v in dg.combine(chart[i, k], chart[k, i + length]).items():
                        dg.put(cell, at, v)
                chart[i, i + length] = cell
        assert dg.span_cell("".join(symbols)) == chart[0, n]
        s = dg.Spans()
        for x in symbols:
            s.row(x[0], {"x": "b"}.get(x[1], x[1]))
        assert s.whole() == chart[0, n]


def test_against_search(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Why?", "well", " ", "", None, "a\nb.", "x. \t\n", "é."]
    rows = [(c, rng.choice([None, *range(8)]) if c % 3 == 0 else t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(texts) if rng.random() < .5 else f"turn {rng.random()}.")
            for c in range(150) for t in range(rng.randrange(1, 8))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)]
    rows += [(1000 + c, 0, "user", "Alone.") for c in range(40)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(7)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in dg.repaired_all(docs, dg.damaged(docs)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert not [(k, got[k], want[k]) for k in want if got[k] != want[k]][:3]
    assert any(v[6] == "" and v[1:] == (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())


def test_one_conversation_over_all_tasks(spark):
    """A conversation of many rows is cut over tasks; its cells add up to the same repair."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(3000)] + [(8, 1, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: r for r in dg.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    s = dg.Spans()
    seen = set()
    for _, _, role, text in rows[:3000]:
        s.row(role[:1], "b" if not text else "d" if (role, text) in seen else "t" if text[-1] != "." else "-")
        seen.add((role, text))
    cost, audit = dg.best(s.whole())
    assert (got[7]["cost"], got[7]["audit"], got[7]["illegal"]) == (cost, audit, s.illegal)
    assert got[8]["audit"] in ("KI", "D")


def test_empty_and_equal_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert dg.repaired_all(empty, dg.damaged(empty)).collect() == []
    many = spark.createDataFrame([(1, None, "user", "Hi.")] * 3000, schema)
    r = dg.repair(many).first()
    assert (r["gaps"], r["blank"], r["duplicate"], r["illegal"]) == (0, 0, 2999, 2999) and r["cost"] == 2 * 3000 and r["audit"] == "D" * 3000


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_conversations"](spark, folder).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
