from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from cohortwave.llm import shingle_join

DATA = "/root/testdata/sf0.01"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=80):
    """(doc_id, set size, smallest id reachable), by counting common shingles of all pairs that have one."""
    sets = [(i, shingles(t)) for i, t in rows]
    lists, shared, label = {}, {}, list(range(len(sets)))
    for i, (_, s) in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    for members in lists.values():
        for n, i in enumerate(members):
            for j in members[n + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n):
            label[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), 1 << 70), 1 << 69 if d is None else d)
    return sorted(((d, len(s), None if least[root(i)] == 1 << 69 else least[root(i)]) for i, (d, s) in enumerate(sets)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, share):
    return [f"e{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def families(seed, groups, most, words=(20, 300), share=0.05):
    """Texts and edited copies of copies, so that many links run through a third text."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        own = [[f"w{rng.integers(4000)}" for _ in range(int(rng.integers(*words)))]]
        for _ in range(int(rng.integers(most))):
            own.append(edited(rng, own[int(rng.integers(len(own)))], share * rng.random()))
        rows += [" ".join(w) for w in own]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(documents, clashing):
    rows = families(1, 60, 12)
    rows += [(9000, None), (9001, ""), (9002, " \t"), (9003, "one"), (9004, "One"), (9005, "É one two"), (9006, "é one two"), (9007, "long " * 50_000), (9008, "Long " * 50_001), (5, rows[7][1]), (5, "x y"), (None, "x Y"), (None, rows[9][1]), (None, "only this"), (9009, rows[3][1]), (9010, rows[3][1])]
    want = brute(rows)
    for docs in (clashing(rows), documents(rows).repartition(7)):
        assert result(shingle_join.joined(docs)) == want


@pytest.mark.parametrize("percent, boundaries", [(80, (None, 12)), (60, (0, 7))])
def test_short_texts_by_enumeration(documents, percent, boundaries, monkeypatch):
    """Sets of up to 20 shingles, many of them one word apart: both sides of the boundary, wherever it lies."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        words = [f"v{rng.integers(30)}" for _ in range(int(rng.integers(3, 24)))]
        for _ in range(int(rng.integers(1, 6))):
            cut = int(rng.integers(0, 3))
            rows.append(" ".join([*words[cut:], *[f"v{rng.integers(30)}"] * int(rng.integers(0, 3))]))
    rows = list(enumerate(rows))
    want = brute(rows, percent)
    chosen = []
    exact = shingle_join.boundary
    for forced in boundaries:
        monkeypatch.setattr(shingle_join, "boundary", lambda *a, f=forced: chosen.append(exact(*a) if f is None else f) or chosen[-1])
        assert result(shingle_join.joined(documents(rows), percent=percent)) == want, forced


def test_templates_whose_pivot_is_no_link(documents, monkeypatch):
    """One template, families a few words apart from it and from each other: most pairs share listed shingles, few are linked."""
    rng = np.random.default_rng(4)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for _ in range(40):
        family = list(template)
        for p in rng.choice(120, 5, replace=False):
            family[p] = f"f{rng.integers(1 << 30)}"
        for _ in range(3):
            own = list(family)
            own[int(rng.integers(120))] = f"o{rng.integers(1 << 30)}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    want = brute(rows)
    assert 20 < len({c for *_, c in want}) < 120
    for rounds, worth in ((1, 64), (6, 0)):
        monkeypatch.setattr(shingle_join, "ROUNDS", rounds)
        monkeypatch.setattr(shingle_join, "WORTH", worth)
        assert result(shingle_join.joined(documents(rows))) == want


def test_large_family_of_near_copies(documents):
    """500 edited copies of one text, many of them below the threshold for each other."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, words, 0.03 * rng.random()))) for i in range(500)]
    assert result(shingle_join.joined(documents(rows).repartition(5))) == brute(rows)


def test_known_classes_are_not_multiplied_by_sets_outside(documents, monkeypatch):
    """90 texts one word from a base are one class; 30 texts three words from it are linked with the base alone.

    Each of the 30 has a listed shingle in common with all 90: compared with the base first, none is left for all pairs.
    """
    words = [f"w{i}" for i in range(150)]
    edited = lambda i, n: " ".join(f"e{i}" if at % 50 == i % 50 and at < 50 * n else w for at, w in enumerate(words))
    rows = [(0, " ".join(words)), *((i, edited(i, 1)) for i in range(1, 91)), *((i, edited(i, 3)) for i in range(101, 131))]
    known = documents([]).sparkSession.createDataFrame([(0, i) for i in range(1, 91)], "a long, b long")
    compared, verified = [], shingle_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingle_join, "verified", counted)
    got = {r.doc_id: r.component_id for r in shingle_join.joined(documents(rows), known=known).collect()}
    assert got == {i: least for i, _, least in brute(rows)} and set(got.values()) == {0}
    assert sum(compared) <= 2 * 30


def test_pivots_that_were_compared_are_passed_over(spark):
    met = spark.createDataFrame([(9, 1), (9, 1), (9, 1), (9, 2), (9, 2), (9, 3), (9, 9), (5, 1)], "node long, p_node long")
    tested = spark.createDataFrame([(1, 9), (1, 5)], "a long, b long")
    assert {tuple(r) for r in shingle_join.best_pivots(met).collect()} == {(1, 9), (1, 5)}
    assert {tuple(r) for r in shingle_join.best_pivots(met, tested).collect()} == {(2, 9)}


def test_boundary_follows_the_cost():
    assert shingle_join.boundary({}, {17: 5}, 80) == 0
    assert shingle_join.boundary({n: 10 for n in range(1, 17)}, dict.fromkeys(range(1, 17), 1), 80) == 4  # below five shingles, one subset stands for one entry
    assert shingle_join.boundary({n: 1 for n in range(1, 17)}, {n: 10**6 for n in range(1, 18)}, 80) == 16
    assert 4 < shingle_join.boundary({n: 100 for n in range(1, 17)}, {n: 3000 for n in range(1, 18)}, 80) < 16


def test_given_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert result(shingle_join.query(spark, DATA)) == brute(rows)


def test_given_documents_against_sql(spark):
    data = DATA.replace("0.01", "0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in con.execute(shingle_join.SQL).df().itertuples()), key=str)
    assert result(shingle_join.query(spark, data)) == want


def test_empty_table(documents):
    assert shingle_join.joined(documents([])).count() == 0
    assert result(shingle_join.joined(documents([(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]
