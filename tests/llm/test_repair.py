from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq

from cohortwave.llm import repair

DATA = "/root/testdata/sf0.001"

SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All partial results row by row, the least (cost, letters) of each: letters are compared whole, so no two of one
    cost and place are merged before the end unless they end alike."""
    best: dict[tuple, set] = {("", ()): 0}

    def grow(states):
        out = dict(states)
        todo = list(states.items())
        while todo:
            (letters, roles), cost = todo.pop()
            if letters.endswith("II"):  # a third insertion in a row is never cheapest
                continue
            last = roles[-1][0] if roles else ""
            role = "assistant" if last == "u" else "user"
            key, price = (letters + "I", (*roles, role)), cost + 2
            if out.get(key, 1 << 30) > price:
                out[key] = price
                todo.append((key, price))
        return out

    def pruned(states):
        """Of results with the same last role and the same emptiness, those within the least cost."""
        least: dict[tuple, int] = {}
        for (_, roles), cost in states.items():
            k = (roles[-1][0] if roles else "",)
            least[k] = min(least.get(k, 1 << 30), cost)
        return {k: c for k, c in states.items() if c == least[(k[1][-1][0] if k[1] else "",)]}

    for role, must, cut in rows:
        states = pruned(grow(best))
        fresh: dict[tuple, int] = {}

        def put(key, cost, fresh=fresh):
            fresh[key] = min(fresh.get(key, 1 << 30), cost)

        for (letters, roles), cost in states.items():
            put((letters + "D", roles), cost + 3)
            if must:
                continue
            last = roles[-1][0] if roles else ""
            if role[:1] and role[:1] in FOLLOWS[last]:
                put((letters + "K", (*roles, role)), cost + cut)
            put((letters + "R", (*roles, "assistant" if last == "u" else "user")), cost + 2 + cut)
        best = fresh
    ends = {k: c for k, c in grow(best).items() if not k[1] or k[1][-1][0] == "a"}
    (letters, _), cost = min(ends.items(), key=lambda e: (e[1], e[0][0]))
    return letters, cost


def brute(rows):
    """The contract in plain Python, without tables."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in own:
            kept = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append((role, fault in ("blank", "duplicate"), int(fault == "truncated")))
        letters, cost = cheapest(symbols)
        text, state, at = [], "", 0
        for c in letters:
            role = "assistant" if state == "u" else "user"
            if c == "I":
                text.append(f"{role}:")
            else:
                if c != "D":
                    role = own[at][2] if c == "K" else role
                    text.append(f"{role}:{own[at][3]}")
                at += 1
            if c != "D":
                state = role[0]
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", "é. ", None, "same.", "same.", "A. B"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    return [(c, None if rng.random() < 0.1 else rng.randrange(most * 2), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for _ in range(rng.randrange(most))]


def test_random_conversations_against_brute_force(spark):
    rows = [*random_rows(1, 120, 9), (None, 1, "user", "x."), (None, None, None, None), (500, 1, "user", "a."), (500, 1, "user", "a."), (501, None, "system", "only.")]
    for parts in (1, 5):
        got = result(repair.repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(parts)))
        assert got == brute(rows)


def test_given_conversations_against_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{DATA}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    assert result(repair.query(spark, DATA)) == brute(rows)


def test_long_conversation_is_cut_into_segments(spark):
    """One conversation over several stored partitions gives what it gives in one; a plain backward programme tells the cost."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), f"text {t}{rng.choice(['.', ''])}") for t in range(3000)]
    whole = spark.createDataFrame(rows, SCHEMA)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        turns = repair.placed(repair.damaged(whole))
        assert (turns.selectExpr("count(distinct shiftright(place, 33)) n").first()["n"] > 1) == (n == "7")
        found.append(result(repair.repaired_conversations(whole)))
    spark.conf.set("spark.sql.shuffle.partitions", few)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1]
    seen, v = set(), repair.END
    symbols = []
    for _, _, role, text in sorted(damaged(rows), key=lambda r: (r[1], r[2], r[3])):
        must = not text.strip() or (role, text) in seen
        seen.add((role, text))
        symbols.append(0 if must else 1 + 2 * {"u": 0, "a": 1}.get(role[0], 3) + (text.strip()[-1] not in ".!?"))
    for s in reversed(symbols):
        v = repair.before(s, v)
    assert found[0][7][5] == v[0]


def test_tables_agree_with_single_steps():
    t, rng = repair.tables(), np.random.default_rng(0)
    for _ in range(200):
        symbols = rng.integers(0, 10, rng.integers(1, 30)).astype(np.uint8)
        at, cost = repair.sums(symbols)
        for i, v in enumerate(t.vectors):
            want = v
            for s in symbols[::-1].tolist():
                want = repair.before(s, want)
            assert tuple(c + cost[i] for c in t.vectors[at[i]]) == want


def test_empty_table_and_clashing_names(spark):
    assert repair.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = random_rows(5, 20, 6)
    wide = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{SCHEMA}, conv string, place int, audit string")
    assert result(repair.repaired_conversations(wide)) == brute(rows)
