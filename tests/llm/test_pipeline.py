from __future__ import annotations

from collections import defaultdict

import pyarrow.parquet as pq

import corpus_pipeline
from cohortwave.llm import base, decontamination, toxicity
from cohortwave.llm.base import table
from cohortwave.llm.tokens import Encoder
from test_similar import classes, near_pairs, shingles_of

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_similar(docs):
    """The smallest id of each class, by the Jaccard similarity of all pairs that share a five-word shingle."""
    sets = {i: shingles_of(t) for i, t in docs.items()}
    return set(classes(sets, near_pairs(sets)).values())


def test_run_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    docs = table(spark, DATA, "documents")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, table(spark, DATA, "labels")).where("score >= 0.3").collect()}
    left = {i: r["text"] or "" for i, r in rows.items() if i not in toxic}
    assert len(left) >= 0.7 * len(rows)
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: left[i] for i in sorted(last.values())}
    left = {i: left[i] for i in sorted(brute_similar(left))}
    table_left = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontamination.contamination(table_left, table(spark, DATA, "benchmark")).where("contaminated").collect()}
    encoder = Encoder()
    want = {i: len(encoder.encode(t)) + 1 for i, t in left.items() if i not in leaked}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == COLUMNS, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def stage_inputs(spark, path, rows):
    """documents, labels and benchmark in a folder of their own, with more columns than the stages know."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, DATA, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_and_an_empty_table_end_to_end(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(300))
    item = table(spark, DATA, "benchmark").orderBy("item_id").first().text
    rows = [(1, None), (2, ""), (3, "   "), (4, words), (4, words), (5, words + " more"), (None, "no id here"), (None, None), (6, "long " * 60_000), (7, f"before {item} after"), (8, "é" * 30_000), (9, "one"), (9, "two")]
    data = stage_inputs(spark, tmp_path / "odd", rows)
    left = {}
    for r in corpus_pipeline.run(spark, data).collect():
        left.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    # null and empty are one text, of which the largest id stays; that blank row and the one of spaces are near copies
    assert left.keys() == {None, 2, 4, 6, 8, 9}
    encoder = Encoder()
    assert sum(n for _, n, _ in left[6]) == len(encoder.encode("long " * 60_000)) + 1
    assert sorted(n for _, n, _ in left[9]) == sorted(len(encoder.encode(t)) + 1 for t in ("one", "two"))
    assert corpus_pipeline.run(spark, stage_inputs(spark, tmp_path / "none", [])).count() == 0


def test_stages_with_clashing_names(spark):
    docs = table(spark, DATA, "documents").limit(40)
    names = "toxicity margin leaked_items leaked share digest keep_id kept_id row same sig fp component_id _gone_id".split()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = docs.selectExpr("*", *[f"'x' as {n}" for n in names])
        plain, got = stage(spark, docs, DATA), stage(spark, wide, DATA)
        assert got.columns == wide.columns and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect()), name


def test_stages_send_texts_in_small_batches_unless_the_session_names_a_size(spark, documents):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    docs, before = documents([(i, "x" * 50_000) for i in range(400)]).coalesce(1), spark.conf.get(base.BATCH_SETTING)
    try:
        for named, most in ((base.SPARKS_OWN, 5 << 20), ("8388608b", 9 << 20)):
            spark.conf.set(base.BATCH_SETTING, named)
            corpus_pipeline.keep_one_copy(spark, docs, "")
            got = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert sum(got) > 20_000_000 and most / 2 < max(got) < most
    finally:
        spark.conf.set(base.BATCH_SETTING, before)
