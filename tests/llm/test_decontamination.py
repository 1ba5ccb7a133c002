from __future__ import annotations

import random

import numpy as np

from cohortwave.llm import decontamination as d


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert d.common(d.bit_masks(a), len(a), b) == brute_lcs(a, b)


def corpus(seed=3, n=400, items=60):
    rng = random.Random(seed)
    word = lambda: f"the{rng.randrange(12)}" if rng.random() < 0.4 else f"w{rng.randrange(20_000)}"
    bench = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(items)]
    rows, leaks = [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 300))]
        if i % 4 == 0:
            item, text = rng.choice(bench)
            part = text.split()
            if i % 8 == 0:  # a paraphrase: one word in eight is another, one is left out
                part = [w if rng.random() > 0.12 else word() for w in part]
                part.pop(rng.randrange(len(part) - 3))
            if i % 3 == 0:
                part = [w.upper() + "," for w in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            leaks[i] = item
        rows.append((i, " ".join(words)))
    return bench, rows, leaks


def test_leaks_and_paraphrases_are_found_and_clean_rows_left(spark, documents, clashing):
    bench, rows, leaks = corpus()
    table = spark.createDataFrame([*bench, (900, None), (901, ""), (902, "!!")], "item_id long, text string")
    for docs in (clashing(rows),):
        got = {r.doc_id: r.item_ids for r in d.contamination(docs, table).collect()}
        assert len(got) == len(rows)
        assert np.mean([leaks[i] in got[i] for i in leaks]) >= 0.95
        assert not [i for i in got if i not in leaks and got[i]]
    left = d.drop_contaminated(documents(rows), table)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in left.collect()} == {i for i in got if not got[i]}


def test_query_recall_against_brute_force(spark):
    """Every passage that holds nine tenths of an item, in order, is found."""
    import re

    import pyarrow.parquet as pq

    read = lambda t: [(r[f"{'doc' if t == 'documents' else 'item'}_id"], re.findall(r"[^\W_]+", r["text"].lower())) for r in pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist()]
    items = [(i, w, set(zip(w, w[1:], strict=False))) for i, w in read("benchmark")]
    got = {r.doc_id: r for r in d.query(spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for i, words in read("documents"):
        pairs = set(zip(words, words[1:], strict=False))
        near = [(j, w) for j, w, p in items if len(p & pairs) >= 0.5 * len(p)]
        want[i] = {j for j, w in near if any(brute_lcs(w, words[a : a + 128]) >= 0.9 * len(w) for a in range(0, max(1, len(words) - 64), 32))}
    assert sum(map(len, want.values())) > 10
    found = sum(len(want[i] & set(got[i].item_ids)) for i in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    assert all(got[i].contaminated == (got[i].n_items > 0) == bool(got[i].item_ids) for i in want)
    assert sum(got[i].contaminated for i in want if not want[i]) <= 0.01 * len(want)


def test_odd_tables(spark, documents):
    bench, rows, _ = corpus(n=20)
    table = spark.createDataFrame(bench, "item_id long, text string")
    odd = [(1, None), (2, ""), (2, ""), (3, "w1 " * 50_000), (4, bench[0][1]), (5, "é" * 100_000)]
    got = d.contamination(documents(odd), table).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.contaminated} == {4}
    assert d.contamination(documents([]), table).count() == 0
    assert not any(r.contaminated for r in d.contamination(documents(rows), table.limit(0)).collect())
    long_item = spark.createDataFrame([(7, " ".join(f"q{i}" for i in range(300)))], "item_id long, text string")
    hit = d.contamination(documents([(1, "a b " + " ".join(f"q{i}" for i in range(100, 230))), (2, "a b")]), long_item).collect()
    assert {r.doc_id for r in hit if r.contaminated} == {1}


def edit_distance(item, words):
    """Least number of edits between item and any run of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last = [i]
        for j, y in enumerate(words, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return min(row)


def test_items_that_stand_together():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        for edits in range(4):
            assert edits >= len(a) or d.stands(d.bit_masks(a), len(a), b, edits) == (edit_distance(a, b) <= edits)


def test_items_of_frequent_words_are_found(spark, documents):
    """A passage in a third of the rows, some of them with edits; and items of few words, and of common words alone."""
    rng = random.Random(6)
    common = [f"the{i}" for i in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(20_000)}"
    held = [f"held{i}" for i in range(30)]
    bench = [(0, " ".join(held)), (1, "zeta eta theta"), (2, " ".join(rng.choice(common) for _ in range(24))), (3, " ".join(f"none{i}" for i in range(20)))]
    rows, want = [], {}
    for i in range(450):
        words = [word() for _ in range(rng.randrange(40, 200))]
        at = rng.randrange(len(words))
        if i % 3 == 0:
            part = list(held)
            if i % 2:
                part[5], part[17] = "x5", "x17"
            words[at:at] = part
        elif i % 50 in (1, 2):
            words[at:at] = bench[i % 50][1].split()
        elif i % 50 == 7:  # the words of both, not together
            words[at:at] = ["zeta", "eta", "no", "theta", *rng.sample(bench[2][1].split(), 24)]
        want[i] = [0] if i % 3 == 0 else [i % 50] if i % 50 in (1, 2) else []
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in d.contamination(documents(rows), table).collect()} == want
    assert {r.doc_id for r in d.drop_contaminated(documents(rows), table).collect()} == {i for i in want if not want[i]}


def test_a_thousand_items_in_one_block_are_all_found(spark, documents):
    """Items of a small vocabulary, as many as tasks receive at once, each verbatim or with a sixth of its words changed."""
    rng = random.Random(8)
    word = lambda: f"the{rng.randrange(12)}" if rng.random() < 0.4 else f"w{int(2000 * rng.random() ** 2)}"
    bench = [(i, " ".join(word() for _ in range(rng.randrange(18, 58)))) for i in range(d.ITEMS_AT_ONCE)]
    rows = []
    for i, text in bench:
        part = text.split()
        if i % 2:
            for j in range(3, len(part), 6):
                part[j] = f"x{j}"
        rows.append((i, " ".join([*(word() for _ in range(rng.randrange(120))), *part, *(word() for _ in range(rng.randrange(120)))])))
    got = {r.doc_id: r.item_ids for r in d.contamination(documents(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for part in d.weighed(documents(rows), spark.createDataFrame(bench, "item_id long, text string")):
        items = [*part.latent, *part.few]
        assert len(part.latent) > 0.9 * len(bench)
        scan = d.WordScanner(d.SPACE_AND_PUNCTUATION, lower=True)
        for i, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            h = (scan.scan(raw, np.asarray([0, len(raw)]))[3] >> d.HASH_BITS).tolist()
            for at in range(-d.BLOCK, len(h), d.BLOCK):
                own = set(h[max(0, at) : max(0, at + 4 * d.BLOCK)])
                near = h[max(0, at) : at + 4 * d.BLOCK]
                want.setdefault(i, set()).update(x.item_id for x in items if len(own & x.masks.keys()) > 2 and x.holds(near)[0])
    assert sum(i in want[i] for i, _ in rows) > 0.95 * len(rows)
    assert got == {i: sorted(want[i]) for i in want}


def test_clashing_column_names(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([("x", 5, "q9 " * 3, [1]), ("y", 6, " ".join(f"q{i}" for i in range(30)), None), (None, 7, None, [2])], "leaked_items string, doc_id long, text string, leaked array<int>")
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [5, 7]


def test_blocks_of_the_benchmark_and_repeated_rows(spark, documents, monkeypatch):
    bench, rows, _ = corpus(n=80)
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(map(str, d.contamination(documents([*rows, *rows[:20]]), table).select("doc_id", "item_ids").collect()))
    whole = d.weighed
    monkeypatch.setattr(d, "weighed", lambda docs, benchmark: whole(docs, benchmark, 20))
    assert want == sorted(map(str, d.contamination(documents([*rows, *rows[:20]]), table).select("doc_id", "item_ids").collect()))


def test_the_space_is_fitted_on_all_documents(spark, documents, monkeypatch):
    """The sketch is the product of the Gram matrix of every document's passages, by a dense matrix of them."""
    rng = random.Random(12)
    bench = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(30))) for i in range(20)]
    rows = [(i, " ".join(f"w{int(1200 * rng.random() ** 2)}" for _ in range(rng.randrange(40)))) for i in range(8_000)]
    rows += [(9_000, " ".join(f"w{rng.randrange(900)}" for _ in range(3_000))), (9_001, None)]
    sums, whole = [], d.summed
    monkeypatch.setattr(d, "summed", lambda parts, dtype: sums.append(whole(parts, dtype)) or sums[-1])
    monkeypatch.setattr(d, "DENSE", 64)
    monkeypatch.setattr(d, "PASSAGES", 10)
    (part,) = d.weighed(d.texts(documents(rows)), spark.createDataFrame(bench, "item_id long, text string"))
    space, size = part.space, d.RANK + d.EXTRA
    got = np.concatenate([sums[1][s].reshape(-1, size) for s in range(d.SLICES)])
    scan, passages = d.WordScanner(d.SPACE_AND_PUNCTUATION, lower=True), []
    for _, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = scan.scan(raw, np.asarray([0, len(raw)]))[3] >> d.HASH_BITS
        for at in range(0, len(h), 2 * d.BLOCK):
            passages.append(np.zeros(space.width))
            for lo in (at, at + d.BLOCK):
                _, v = space.known(np.unique(h[lo : lo + d.BLOCK]))
                np.add.at(passages[-1], space.column[v], space.weight[v])
    a = np.asarray(passages)
    omega = np.random.default_rng(7).standard_normal((space.width, size)).astype(np.float32)
    assert space.width > 64 and len(a) > 7_000
    assert np.abs(got - a.T @ (a @ omega)).max() < 1e-4 * np.abs(got).max()
