from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortwave.llm import simhash


def brute_fp(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=2):
    ids = sorted(fps)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


ODD = ["", None, "  ", "One", "one", "ONE two", "É é", "a b c d e", "a b c d f", "a\x1cb c　d e", "x " * 30_000, "the same words again and again"]


def test_fingerprints():
    for t in ODD:
        assert simhash.fingerprint(t or "") == brute_fp(t), repr(t)


def test_query_against_brute_force(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in rows}
    parts = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{fps[i]:016x}", parts[i]) for i in fps}


def test_components_of_crowded_fingerprints(spark):
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {}
    for i in range(700):
        f = int(centres[rng.integers(0, 12)])
        for _ in range(rng.integers(0, 7)):
            f ^= 1 << int(rng.integers(0, 64))
        fps[i] = f
    want = brute_components(fps)
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in fps.items()], "rep long, fp long").groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    for large in (4096, 3):
        links = simhash.links(df, 2, large)
        parts = {r.node: r.component for r in simhash.connected_components(links).collect()}
        reps = {}
        for i, f in sorted(fps.items()):
            reps.setdefault(f, i)
        assert {i: parts.get(reps[f], reps[f]) for i, f in fps.items()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=20), st.integers(0, 5))
def test_gray_index_finds_every_pair(seeds, radius):
    rng = np.random.default_rng(seeds[0] % 1000)
    values = np.unique(np.asarray([s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False)) for s in seeds for _ in range(12)], np.uint64))
    q, v, apart = simhash.GrayIndex(values).within(values, radius)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == want
    assert apart.tolist() == simhash.distance(values[q], values[v]).tolist()


def test_gray_index_of_long_fingerprints():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (6, 3), dtype=np.uint64)
    values = np.asarray([[int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in centres[i % 6]] for i in range(150)], np.uint64)
    want = {(i, j) for i in range(150) for j in range(150) if sum(bin(int(x)).count("1") for x in values[i] ^ values[j]) <= 8}
    q, v, _ = simhash.GrayIndex(values).within(values, 8)
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14), st.integers(0, 6)), max_size=60))
def test_spanning_forest_is_minimal(links):
    """As many links as there are classes to join, none twice, and at every level the classes are those of all links up to it."""
    a, b, d = (np.asarray(x, np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 3
    own = simhash.spanning_forest(15, a, b, d)
    for level in range(7):
        parts = [brute_components_of(15, a[i], b[i]) for i in (np.flatnonzero(d <= level), own[d[own] <= level])]
        assert parts[0] == parts[1]
    assert len(own) == 15 - len(set(brute_components_of(15, a, b)))


def brute_components_of(n, a, b):
    label = list(range(n))
    for x, y in zip(np.asarray(a).tolist(), np.asarray(b).tolist(), strict=True):
        low, high = sorted((label[x], label[y]))
        label = [low if v == high else v for v in label]
    return label


def test_odd_rows(documents, clashing):
    rows = list(enumerate(ODD))
    want = brute_components({i: brute_fp(t) for i, t in rows})
    for docs in (clashing(rows),):
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.near_duplicates(documents([(1, "a"), (1, "a")])).count() == 2


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and a ring, with and without the way for hubs."""
    from cohortwave.llm import components

    links = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 203), (203, 201), (201, 202), (202, 200), (300, 300)] + [(59, 150), (150, 160)]
    want = brute_components_of(400, [a for a, _ in links], [b for _, b in links])
    for hub in (20_000, 5):
        monkeypatch.setattr(components, "HUB", hub)
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_stop_at_stars_and_run_few_tasks(spark):
    """A task for each partition and shuffle: links that are stars already need no round, a chain few stages a round."""
    from cohortwave.llm import components

    sc, status = spark.sparkContext, spark.sparkContext.statusTracker()
    for name, links, most in (("stars", [(10 * i, 10 * i + j) for i in range(20) for j in range(1, 5)], 50), ("chain", [(i, i + 1) for i in range(200)], 300)):
        edges = spark.createDataFrame(links, "a long, b long").repartition(4)
        try:
            sc.setJobGroup(f"components-{name}", name)
            got = {r.node: r.component for r in components.connected_components(edges).collect()}
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert got == {i: 10 * (i // 10) if name == "stars" else 0 for i in {x for link in links for x in link}}
        stages = {s for j in status.getJobIdsForGroup(f"components-{name}") for s in status.getJobInfo(j).stageIds}
        assert sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s))) <= most
