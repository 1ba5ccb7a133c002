from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq

from cohortwave.llm import similar


def shingles_of(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))}


def near_pairs(sets, least=0.8):
    """All pairs at that Jaccard similarity or more, by counting shared shingles in an inverted list."""
    lists, shared = {}, {}
    for i, s in sets.items():
        for g in s:
            lists.setdefault(g, []).append(i)
    for members in lists.values():
        for n, i in enumerate(members):
            for j in members[n + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    return [(i, j) for (i, j), n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]


def classes(ids, pairs):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        x, y = sorted((root(i), root(j)))
        label[y] = x
    return {i: root(i) for i in ids}


def edited(rng, words, share):
    return [f"e{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def crowd(seed=4, groups=40, most=4, share=0.012):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        words = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))]
        rows += [" ".join(edited(rng, words, share * rng.random() if c else 0)) for c in range(1 + g % most)]
    return list(enumerate(rows))


def test_against_brute_force(documents, clashing):
    rows = [*crowd(), (900, None), (901, ""), (902, "x"), (903, "two words"), (904, "two other"), (905, "long " * 50_000), (906, "Long " * 50_001), (907, " \t")]
    sets = {i: shingles_of(t) for i, t in rows}
    want = classes(sets, near_pairs(sets))
    for docs in (clashing(rows), documents(rows).repartition(3)):
        assert {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()} == want
    left = similar.drop_similar(documents(rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    assert similar.similar_documents(documents([])).count() == 0 and similar.drop_similar(documents([])).count() == 0


def test_pairs_just_below_are_no_link(documents):
    """200 words, 196 shingles: a changed word in the middle costs five, so four changes give 176/216 and five 171/221."""
    words = [f"w{i}" for i in range(200)]
    changed = lambda n: " ".join(f"x{i}" if i % 20 == 10 and i < 20 * n else w for i, w in enumerate(words))
    rows = [(1, changed(0)), (2, changed(4)), (3, changed(5).replace("w199", "end"))]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(documents(rows)).collect()}
    sets = {i: shingles_of(t) for i, t in rows}
    assert got == classes(sets, near_pairs(sets)) and got[2] == 1


def test_large_groups_are_sliced_and_lose_no_class(spark, documents):
    """Several hundred near copies of three texts, with groups of more than 16 members sliced."""
    rows = [(i, t) for i, t in crowd(seed=8, groups=3, most=1)]
    rng = np.random.default_rng(2)
    rows += [(100 + i, " ".join(edited(rng, rows[i % 3][1].split(), 0.008))) for i in range(400)]
    signed = similar.signatures(documents(rows).selectExpr("doc_id", "xxhash64(text) as row", "text"))
    nodes = signed.selectExpr("doc_id as node", "sig")
    links = [tuple(r) for r in similar.candidate_links(nodes, large=16).collect()]
    assert len(set(classes([i for i, _ in rows], links).values())) == 3
    assert len(links) < 21 * len(rows)


def template_corpus(seed, families=500, words=400, between=6, within=8):
    """Texts of one template: families that differ in `between` words from it, each with two texts `within` words apart."""
    rng = np.random.default_rng(seed)
    template, rows = [f"w{i}" for i in range(words)], []

    def changed(text, n):
        out = list(text)
        for at in rng.choice(words, n, replace=False):
            out[at] = f"e{rng.integers(1 << 40)}"
        return out

    for _ in range(families):
        one = changed(template, between)
        rows += [one, changed(one, within)]
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def classes_of_all_pairs(rows, least=0.8):
    """Classes by the Jaccard similarity of all pairs, shared shingles counted as a matrix product."""
    sets = {i: shingles_of(t) for i, t in rows}
    column = {}
    held = np.zeros((len(rows), len(set().union(*sets.values()))), np.float32)
    for at, (i, _) in enumerate(rows):
        held[at, [column.setdefault(g, len(column)) for g in sets[i]]] = 1
    size, shared = held.sum(axis=1), held @ held.T
    x, y = np.nonzero(np.triu(shared >= least * (size[:, None] + size - shared), 1))
    ids = [i for i, _ in rows]
    return classes(ids, [(ids[a], ids[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)]), len(x)


def test_a_template_corpus_loses_no_class(documents):
    """The nearest links of its groups fail the exact test: only the join of what is in question finds the others."""
    rows = template_corpus(11)
    want, links = classes_of_all_pairs(rows)
    assert links >= 300
    assert {r.doc_id: r.component_id for r in similar.similar_documents(documents(rows)).collect()} == want


def test_sliced_groups_lose_no_class(documents):
    """Near copies of many texts of one template, in groups far beyond the limit of a slice, dealt by hash besides."""
    rows = template_corpus(12, families=150, between=10, within=3) + [(1000 + i, t) for i, t in crowd(groups=10)]
    want, links = classes_of_all_pairs(rows)
    docs = documents(rows)
    for large in (1, 8):
        got = {r.doc_id: r.component_id for r in similar.similar_rows(docs, large=large).collect()}
        assert got == want and links >= 150


def test_recall_on_the_given_documents(spark):
    """Of all pairs at 0.8 or more with a document of an id divisible by 100, at least nine in ten fall into one class."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [r for r in rows if r["text"]]
    sets = {r["doc_id"]: {hash(g) for g in shingles_of(r["text"])} for r in rows}
    asked = {i: s for i, s in sets.items() if i % 100 == 0}
    lists = {}
    for i, s in asked.items():
        for g in s:
            lists.setdefault(g, []).append(i)
    pairs = []
    for j, s in sets.items():
        shared = {}
        for g in s:
            for i in lists.get(g, ()):
                shared[i] = shared.get(i, 0) + 1
        pairs += [(i, j) for i, n in shared.items() if i != j and n >= 0.8 * (len(sets[i]) + len(s) - n)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert pairs and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9


def test_rows_without_an_id_stay_unless_near_another(documents):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "other"])
    rows = [(7, " ".join(words)), (None, near), (None, "nothing like the other rows at all"), (None, "v " * 50), (None, None), (9, "")]
    left = similar.drop_similar(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)
