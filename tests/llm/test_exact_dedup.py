from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd

from cohortwave.llm import exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), *[(100 + i, "hot") for i in range(60)], (900, "x" * 50_000)]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_against_brute_force_with_few_counters(documents):
    for counters in (1, 3, 256):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(documents(ROWS).repartition(5), counters=counters).collect()}
        assert got == brute(ROWS)


def test_heavy_digest_is_always_a_candidate(documents):
    from pyspark.sql import functions as F

    digests = documents(ROWS).repartition(7).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    assert hashlib.sha256(b"hot").hexdigest() in exact_dedup.frequent_candidates(digests, 1)


def test_summary_keeps_the_frequent():
    counts = exact_dedup.merged_counts(pd.Series([5, 1, 1, 1], index=list("abcd")), 2)
    assert counts.to_dict() == {"a": 4}


def test_empty_table_clashes_and_repeated_rows(documents, clashing):
    assert exact_dedup.exact_duplicates(documents([])).count() == 0
    assert exact_dedup.exact_duplicates(clashing(ROWS)).count() == len(ROWS)
    twice = exact_dedup.exact_duplicates(documents([(1, "a"), (1, "a")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in twice] == [(1, 2, True)] * 2


def test_dropping_keeps_columns(documents):
    left = exact_dedup.drop_exact_duplicates(documents(ROWS))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in left.collect()} == {i for i, v in brute(ROWS).items() if v[2]}


def test_rows_without_an_id_stay_where_no_other_row_has_their_text(documents):
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, "alone"), (None, "twice"), (None, "twice"), (3, None), (None, "")]
    for copies in (1, 400):  # the second finds "twice" as a frequent digest
        left = exact_dedup.drop_exact_duplicates(documents([*rows, *[(None, "twice")] * copies]))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(2, "a"), (3, None), (None, "alone"), (None, "twice")], key=str)
