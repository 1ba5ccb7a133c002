from __future__ import annotations

import random
import re

import numpy as np
import pytest

from cohortwave.llm import substring_dedup
from cohortwave.llm.base import ASCII_SPACE, WordScanner

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=50):
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = {a + j for a in range(len(w) - width + 1) if first[tuple(w[a : a + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta é eps zeta".split()) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return [*rows, (70, "the same " * 400), (71, "the same " * 90), (72, None), (73, ""), (74, "x"), (75, "a" * 100_000 + " b")]


@pytest.mark.parametrize("full", [200, 4, 1])
def test_against_brute_force(documents, clashing, full):
    """With full = 1 every shared bucket goes through all three minimisers and the ranges behind them."""
    rows = corpus(full)
    for docs in (documents(rows).repartition(3), clashing(rows)):
        got = sorted(map(tuple, substring_dedup.without_repeated_windows(docs, full=full).collect()))
        assert got == brute(rows)


def test_a_passage_in_very_many_texts_fills_no_bucket(documents, monkeypatch):
    """80 words in each of 3,000 texts, with other words around: no list of a bucket holds more than `full` strings."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{' '.join(f'a{rng.integers(1 << 40)}' for _ in range(4 + i % 3))} {passage} b{i} b{rng.integers(1 << 40)}") for i in range(3000)]
    sizes, exact = [], substring_dedup.sorted_buckets

    def held(strings, width):
        sizes.append(substring_dedup.bucket_sizes(strings).agg({"strings": "max"}).first()[0] or 0)
        return exact(strings, width)

    monkeypatch.setattr(substring_dedup, "sorted_buckets", held)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.without_repeated_windows(documents(rows), full=20).collect()}
    assert got == {i: (86 + i % 3, 80 if i else 0) for i, _ in rows}
    assert sizes and max(sizes) <= 20


def test_rows_of_one_id_and_several_texts(documents):
    words = lambda start, n: " ".join(f"w{i}" for i in range(start, start + n))
    rows = [(0, words(0, 60)), (1, f"{words(900, 5)} {words(0, 60)}"), (1, words(200, 70)), (1, words(200, 70)), (1, f"x {words(200, 70)}"), (2, words(200, 70)), (None, words(0, 60)), (None, words(400, 60)), (3, words(400, 60))]
    got = substring_dedup.without_repeated_windows(documents(rows)).collect()
    ours = [(i, t) for i, t in rows if i is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(ours)
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 0, 0, 60]
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    assert [r.n_removed for r in got if r.doc_id == 3] == [0]


def test_word_orders_that_fool_polynomial_hashes(documents):
    """Two Thue-Morse sequences have one polynomial hash modulo 2**64; their windows must stay apart."""
    order = [bin(i).count("1") % 2 for i in range(4096)]
    first, second = (" ".join("ab"[bit ^ flip] for bit in order) for flip in (0, 1))
    rows = [(1, f"{first} end"), (2, f"{second} end"), (3, f"start {first}")]
    got = sorted(map(tuple, substring_dedup.without_repeated_windows(documents(rows)).collect()))
    assert got == brute(rows)


def test_empty_and_repeated_rows(documents):
    assert substring_dedup.without_repeated_windows(documents([])).count() == 0
    text = " ".join(str(i) for i in range(60))
    got = substring_dedup.without_repeated_windows(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 60)]


def test_scanner_words():
    scanner = WordScanner(ASCII_SPACE)
    texts = ["", " a bb  ccc", "a bb", "é\x1cx　y\n", "", "ccc"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    at, first, last, h = scanner.scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
    found = [[b"".join(raw)[first[j] : last[j]].decode() for j in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert found == [WORDS.findall(t) for t in texts]
    flat = [w for row in found for w in row]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
