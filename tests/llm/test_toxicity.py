from __future__ import annotations

import random
import zlib

import numpy as np

from cohortwave.llm import toxicity

BAD = "nasty vile rotten".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(BAD).upper() if i % 2 else rng.choice(BAD) + ",")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_clean_rows(spark, documents, clashing):
    rows, labels = corpus(1200)
    truth = {i: t for i, _, t in labels}
    for docs in (documents(rows), clashing(rows)):
        got = toxicity.toxicity(docs, label_table(spark, labels)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        held = [r for r in got if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_are_not_read(spark, documents):
    rows, labels = corpus(800)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(documents(rows), label_table(spark, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_all_documents_count_as_unlabelled(spark, documents, monkeypatch):
    rows, labels = corpus(200)
    counted, seen = toxicity.document_counts, []
    monkeypatch.setattr(toxicity, "document_counts", lambda docs: seen.append(counted(docs)) or seen[-1])
    toxicity.drop_toxic(documents(rows), label_table(spark, labels))
    known = [i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 4 != 2]
    assert [n for _, n in seen] == [len(known), len(rows)]


def test_odd_tables(spark, documents):
    rows, labels = corpus(300)
    odd = [*rows, (9000, None), (9001, ""), (9001, ""), (9002, "vile " * 40_000), (9003, "é" * 50_000)]
    got = toxicity.toxicity(documents(odd), label_table(spark, [*labels, (None, 1, 1), (5, 0, None), (77_777, 1, 1)])).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(odd) and score[9000] == score[9001] and score[9002] > 0.3
    assert all(r.predicted == 0 for r in toxicity.toxicity(documents(rows), label_table(spark, [])).collect())
    assert toxicity.toxicity(documents([]), label_table(spark, labels)).count() == 0


def test_dropping_keeps_columns_and_clean_rows(spark, documents):
    rows, labels = corpus(1000)
    left = toxicity.drop_toxic(documents(rows), label_table(spark, labels))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in left.collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(kept & clean) >= 0.99 * len(clean) and len(kept - clean) <= 0.03 * 200


def test_dropping_with_clashing_names(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(t, i, 0.5, "m") for i, t in rows], "text string, doc_id long, toxicity double, margin string")
    left = toxicity.drop_toxic(docs, label_table(spark, labels))
    assert left.columns == docs.columns and 200 < left.count() < 300


def words_of(text):
    return {w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()}


def term_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(toxicity.presence(toxicity.scanner(), raw, np.asarray([0, len(raw)]))[1][0])


def test_counts_and_gram_matrix_against_brute_force(documents):
    rows, _ = corpus(120)
    docs = documents([*rows, (500, ""), (501, "vile Vile, VILE")]).repartition(5)
    sets = [{term_of(w) for w in words_of(t)} for _, t in rows] + [set(), {term_of("vile")}]
    counts, n = toxicity.document_counts(docs)
    assert n == len(sets) and counts.sum() == sum(map(len, sets))
    assert all(counts[term_of(w)] == sum(term_of(w) in s for s in sets) for w in [*BAD, "w1", "w299", "absent"])
    terms = np.unique([term_of(w) for w in [*BAD, "w7", "w8"]])
    x = np.asarray([[(t in s) / max(1, len(s & set(terms.tolist()))) ** 0.25 for t in terms] + [1.0] for s in sets])
    assert np.allclose(toxicity.gram_matrix(docs, terms), x.T @ x / len(x), atol=1e-6)


def test_risk_and_gradient(documents):
    """Against means over rows, and finite differences; where the negative part is below zero, the direction leads it back."""
    rng = np.random.default_rng(3)
    draw = lambda n, p: np.append(rng.random((n, 6)) < p, np.ones((n, 1)), axis=1)
    xp, xu = draw(40, 0.7), draw(90, 0.3)
    gp, gu = (x.T @ x / len(x) for x in (xp, xu))
    for prior, scale in ((0.1, 0.3), (0.9, 3.0)):
        for _ in range(20):
            w = scale * rng.standard_normal(7)
            loss = lambda w, x, y: np.mean((x @ w - y) ** 2) / 4
            negative = lambda w: loss(w, xu, -1) - prior * loss(w, xp, -1)
            risk, g = toxicity.pu_risk(w, gp, gu, prior)
            assert np.isclose(risk, prior * loss(w, xp, 1) + max(0, negative(w)))
            whole = (lambda v: prior * loss(v, xp, 1) + negative(v)) if negative(w) >= 0 else (lambda v: -negative(v))
            for i, e in enumerate(np.eye(7) * 1e-5):
                assert np.isclose(g[i], (whole(w + e) - whole(w - e)) / 2e-5, atol=1e-6)


def test_fit_parts_positives_from_the_unlabelled():
    rng = np.random.default_rng(0)
    plain = (rng.random((500, 40)) < 0.2).astype(float)
    bad = np.zeros((500, 10))
    bad[450:] = rng.random((50, 10)) < 0.7
    x = np.concatenate([plain, bad, np.ones((500, 1))], axis=1)
    positive = np.concatenate([(rng.random((150, 40)) < 0.2).astype(float), (rng.random((150, 10)) < 0.7).astype(float), np.ones((150, 1))], axis=1)
    w = toxicity.fit_pu(positive.T @ positive / 150, x.T @ x / 500, 0.1)
    seen = bad.sum(axis=1) > 1
    assert (x @ w)[seen].min() > (x @ w)[:450].max()


def test_scores_against_brute_force(spark, documents):
    """Every score is the curve of the summed weights of a text's distinct words."""
    rows, labels = corpus(400)
    rows += [(9000, None), (9001, "vile " * 3 + "w1"), (9002, "Unseen words alone")]
    docs = documents(rows).select("doc_id", "text")
    model, _ = toxicity.train(toxicity.texts(docs), label_table(spark, labels).select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, label_table(spark, labels)).collect()}
    for i, t in rows:
        own = {k for k in map(term_of, words_of(t or "")) if model.selected[k]}
        margin = model.bias + sum(model.weights[k] for k in own) / max(1, len(own)) ** 0.25
        assert np.isclose(got[i], 1 / (1 + np.exp(-(model.scale * margin + model.shift))))


def test_curve_follows_counts():
    margin = np.linspace(-2, 2, 41)
    share = 1 / (1 + np.exp(-(3 * margin - 1)))
    a, b = toxicity.fit_curve(margin, 10_000 * share, 10_000 * (1 - share))
    assert abs(a - 3) < 0.05 and abs(b + 1) < 0.05


def test_query_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{data}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    held = toxicity.query(spark, data).where("held_out").join(known, "doc_id").toPandas()
    right = held["predicted"] == held["toxic"]
    assert right.mean() > 0.96 and held.loc[held["toxic"] == 1, "predicted"].mean() > 0.8
