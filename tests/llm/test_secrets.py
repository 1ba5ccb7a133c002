from __future__ import annotations

import hashlib
import random
import re

from cohortwave.llm import secrets

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    spans = [(m.start(), 1, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 2, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 3, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


TEXTS = [
    None, "", "no secrets here", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "token=token: abcdefgh", "PassWord: x password: abcdef", "\U0001f600 é api_key=ABCDEFG!",
    "AKIA" + "A1" * 8, "AKIAX AKIA" + "Z" * 20, "f" * 23 + " " + "0" * 24, "token='a' secret = \"b2_c3-d4\"", "key: token=" + "a1b2" * 8, "paſsword=abcdefgh", "tokentoken=secretsecret=abcdefg", "x" * 200_000 + " apikey:abcdef1",
]


def test_base_spans_against_brute_force(documents, clashing):
    rows = list(enumerate(TEXTS))
    for docs in (documents(rows), clashing(rows)):
        got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base) for r in secrets.secret_spans(docs).collect()}
        assert got == {i: brute(t) for i, t in rows}


def brute_tokens(text):
    """Long mixed tokens that meet no base span."""
    base = [tuple(map(int, b.split(":")[1:])) for b in brute(text).split(",") if b]
    found = [m for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return [(m.start(), m.end()) for m in found if not any(a < m.end() and m.start() < b for a, b in base)]


def test_tokens_apart_from_base_spans(documents):
    rng = random.Random(9)
    parts = ["token=", "secret: ", " ", "\n", "a1" * 12, "AKIA" + "B2" * 10, "Zx9_" * 6, "é", "=", "password=abc", "f" * 30, "key-value-1-" * 3]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    got = {r.doc_id: [(t.start, t.end) for t in r.tokens] for r in secrets.with_base_spans(documents(rows).select("doc_id", "text")).collect()}
    assert got == {i: brute_tokens(t) for i, t in rows}


def test_very_many_hits_and_a_very_long_token(documents):
    """Work grows with the hits, not with their square: 100,000 of them in one text, and a token of a million characters."""
    n = 100_000
    many = " ".join(f"token=abc{i:05d}" for i in range(n))
    rows = [(1, many), (1, many), (2, " ".join(f"Ab{i:06d}xyzQRSTUVWxyz9" for i in range(n)) + " token=abc12345"), (3, "Zq8j" * 250_000)]
    got = secrets.secret_spans(documents(rows)).selectExpr("doc_id", "size(base) as n", "get(base, size(base) - 1).start as last", "size(added) as added").collect()
    assert sorted((r.doc_id, r.n, r["last"]) for r in got) == [(1, n, len(many) - 14), (1, n, len(many) - 14), (2, 1, len(rows[2][1]) - 14), (3, 0, None)]


def test_random_strings_are_added_and_identifiers_are_not(documents):
    rng = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda n: "".join(rng.choice(chars) for _ in range(n))
    words = "the_account value number reading_of_the_counter session window label-name another return position".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + f" secret = {draw(32)}" * (i % 2)) for i in range(200)]
    rows += [(1000, f"look at {draw(40)}1a now"), (1001, "return_position_of_the_counter_session_window1")]
    got = {r.doc_id: len(r.added) for r in secrets.secret_spans(documents(rows)).collect()}
    assert got[1000] == 1 and got[1001] == 0


def test_no_python_in_the_plan_and_empty_table(spark, documents):
    assert secrets.secret_spans(documents([])).count() == 0
    plan = secrets.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_digest(spark):
    for r in secrets.query(spark, "/root/testdata/sf0.001").collect():
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("random"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
