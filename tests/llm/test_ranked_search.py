from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np

from cohortwave.llm import ranked_search

DATA = "/root/testdata/sf0.001"
BENCH = "item_id long, text string"


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k=20):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n_docs, total, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in held:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc if doc is not None else 1 << 70, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed=1, n=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)]
    pick = lambda size: " ".join(words[min(199, int(x))] for x in rng.exponential(25, size))
    docs = [(i, pick(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # copies, so equal scores
    items = [(i, pick(int(rng.integers(1, 12)))) for i in range(25)]
    return docs, items


def test_random_corpus_against_brute_force(spark, documents, monkeypatch):
    docs, items = corpus()
    docs += [(9001, None), (9002, ""), (9003, "?! \x00"), (9004, "É é W1 w1"), (9005, "w5 " * 40_000), (None, "w3 w4"), (None, "w3 w4"), (5, "w1 w2"), (5, "w1 w2")]
    items += [(100, None), (101, "..."), (102, "É W1, w1"), (103, "unknownterm"), (7, "w9 w9 w9 w2"), (7, "w9 w9 w9 w2"), (None, "w3")]
    want = brute(docs, items)
    monkeypatch.setattr(ranked_search, "SPLITS", 4)
    for at_once, block in ((1000, 8192), (7, 50)):
        got = ranked_search.ranked(documents(docs).repartition(3), spark.createDataFrame(items, BENCH), items_at_once=at_once, block_docs=block)
        assert result(got) == want


def test_range_maxima():
    rng = np.random.default_rng(4)
    docs, terms_ = 300, 6
    at = [(t, d) for t in range(terms_) for d in range(docs) if rng.random() < 0.1 * (t + 1)]
    t, d = (np.asarray(x, np.int64) for x in zip(*at, strict=True))
    tf = rng.integers(1, 5, len(t))
    block = ranked_search.PostingLists(np.arange(docs), np.full(docs, 10), t, tf, d, np.arange(1, terms_ + 1) * 1000, docs, 10 * docs)
    for _ in range(500):
        k = int(rng.integers(terms_))
        lo, hi = np.sort(np.searchsorted(block.keys, k * docs + rng.integers(0, docs + 1, 2)))
        top = block.highest(np.array([[lo]]), np.array([[hi]]))[0, 0]
        if hi > lo:
            assert lo <= top < hi and block.impact[top] == block.impact[lo:hi].max()


def test_given_tables_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = con.execute(ranked_search.SQL).df()
    got = ranked_search.query(spark, DATA)
    assert got.columns == list(want.columns)
    assert result(got) == sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in want.itertuples()), key=str)


def test_few_documents_are_scored():
    """Bounds do their work: one strong document in 8,000 is found without scoring them all."""
    rng = np.random.default_rng(2)
    docs = 8000
    d = np.concatenate([rng.choice(docs, 900, replace=False) for _ in range(5)])
    t, tf = np.repeat(np.arange(5), 900), np.ones(4500, np.int64)
    d, t, tf = np.append(d, [77] * 5), np.append(t, np.arange(5)), np.append(tf, [30] * 5)
    unique = np.unique(t * docs + d, return_index=True)[1]
    block = ranked_search.PostingLists(np.arange(docs), np.full(docs, 40), t[unique], tf[unique], d[unique], np.full(5, 900), docs, 40 * docs)
    seen = []
    exact = ranked_search.merged
    ranked_search.merged = lambda s, i, k: seen.append(len(s)) or exact(s, i, k)
    try:
        scores, ids = block.search(np.arange(5), np.ones(5, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1)
    finally:
        ranked_search.merged = exact
    assert ids[0] == 77 and sum(seen) < 1000


def test_empty_tables_and_clashing_names(spark, documents, clashing):
    bench = spark.createDataFrame([(1, "two words")], BENCH)
    assert ranked_search.ranked(documents([]), bench).count() == 0
    assert ranked_search.ranked(documents([(1, "x")]), bench.limit(0)).count() == 0
    got = result(ranked_search.ranked(clashing([(1, "two"), (2, "words two")]), bench.withColumn("score", bench["item_id"])))
    assert got == brute([(1, "two"), (2, "words two")], [(1, "two words")])
