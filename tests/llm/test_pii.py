from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortwave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def number(s):
    return [int(c) for c in s if c in "0123456789"]


def good_card(s):
    d = number(s)[::-1]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(d)) % 10 == 0


def brute(text):
    text = text or ""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if good_card(m[0])]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(number(m[0])) <= 15]
    return out


ODD = [None, "", "a@b", "a.b@c.d@e.f.g", "x@y..z a@b.c.", "@@a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111 1111 1111", "4111-1111 11111111.5", "+1 (555) 010-5010", "++49 30 1234567.", "+1+23456789012",
       "\U0001f600 é a@b.co +33 1 23 45 67 89", "9" * 5000, "Dr. Anna Schmidt, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00", "a" * 100_000 + "@b.c", "1." * 1000]


def test_base_spans():
    for t in ODD:
        assert pii.base_spans(t or "") == brute(t), repr(t)
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        assert pii.base_spans(t) == brute(t)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@.-+ 0123456789()\né")), max_size=60))
def test_base_spans_on_random_text(text):
    assert pii.base_spans(text) == brute(text)


def test_operator(documents, clashing):
    rows = list(enumerate(ODD))
    for docs in (documents(rows), clashing(rows)):
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(docs).collect()}
        assert {i: [s for s in g if s[0] < 4] for i, g in got.items()} == {i: brute(t) for i, t in rows}
        assert {pii.KINDS[k] for k, _, _ in got[15]} == {"person", "identity", "account"}
    assert pii.personal_data(documents([])).count() == 0


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    counts = np.zeros(pii.CELLS)
    truth = []
    right = (0.95, 0.8, 0.7)
    for _ in range(4000):
        z = rng.random() < 0.4
        vote = tuple(int(2 * (z if rng.random() < r else not z)) for r in right)
        c = pii.cell(4, vote, 2)
        counts[c] += 1
        truth.append((c, z))
    posterior, rel = pii.estimate(counts)
    assert np.allclose([rel[4, 1, i, 2] for i in range(3)], right, atol=0.08)
    p = pii.classify(counts, posterior)
    assert np.mean([(p[c] > 0.5) == z for c, z in truth]) > 0.9


def labelled(n=1500, seed=3):
    """Texts with names, identity and account numbers, and with look-alikes; the spans that are personal."""
    import random

    rng = random.Random(seed)
    given, family = ["Anna", "Jürgen", "Hélène", "Carlos", "Mary", "José", "Jean-Pierre", "Günter"], ["Schmidt", "Müller", "O'Brien", "García", "Dupont", "Smith", "Zoidberg", "Ibáñez"]
    filler = ["The report was long and the trip did end well", "Wir haben das gestern schon gesehen", "Rien de nouveau sous le soleil", "Nada que decir por hoy", "Licensed under the Apache License", "New York and North Sea trade", "Total Cost of Ownership"]

    def account(good):
        body = "DE00" + "".join(str(rng.randrange(10)) for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + "DE00")) % 97
        return f"DE{check if good else (check + 40) % 90 + 3:02d}{body[4:]}"

    rows, truth = [], {}
    for i in range(n):
        parts, kind = [rng.choice(filler)], i % 6
        name = f"{rng.choice(given)} {rng.choice(family)}"
        number = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        cue, span, personal = [("signed by ", name, True), ("", f"Dr. {rng.choice(family)}", True), ("ssn ", number, True), ("part serial ", f"000-{number[4:]}", False), ("iban ", account(True), True), ("model part ", account(False), False)][kind]
        text = f"{parts[0]}, {cue}{span}, {rng.choice(filler)}."
        if personal:
            at = text.index(span, len(parts[0]) + len(cue))
            truth[i] = (at, at + len(span))
        rows.append((i, text))
    return rows, truth


def test_precision_and_recall_of_added_spans(documents):
    rows, truth = labelled()
    got = {(r.doc_id, s.start, s.end) for r in pii.personal_data(documents(rows)).collect() for s in r.spans if s.kind >= len(pii.BASE)}
    want = {(i, a, b) for i, (a, b) in truth.items()}
    right = len(got & want)
    assert right / len(got) > 0.95 and right / len(want) > 0.95, (right, len(got), len(want), sorted(got - want)[:5], sorted(want - got)[:5])


def test_cues_are_whole_words():
    assert pii.votes("a trip of 10.1.2.3", 1, 10, 18)[0][2] == 1 and pii.votes("the ip 10.1.2.3", 1, 7, 15)[0][2] == 2
    assert pii.votes("he did 123-45-6789", 5, 7, 18)[0][2] == 1


def test_repeated_rows(documents):
    rows = [(1, "mail a@b.co, Dr. Anna Schmidt")] * 3 + [(2, None)] * 2
    got = [[(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(documents(rows)).orderBy("doc_id").collect()]
    assert got == [got[0]] * 3 + [[]] * 2 and (0, 5, 11) in got[0]


def test_query_digest(spark):
    names = pii.KINDS
    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    for r in pii.query(spark, "/root/testdata/sf0.001").collect():
        want = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in brute(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.spans + ",").startswith(want and want + ",")
