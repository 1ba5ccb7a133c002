from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortwave.llm import packing, token_counts
from cohortwave.llm.tokens import JSON, Encoder, tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path(JSON))
OURS = Encoder()
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n b ", "it's  they'll 's", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x", "x  y", "a\x1c b", "日本 語　 x", "é" * 300 + " z", "\t\t x\r\n", "a b " * 1000, "  x", "1 2  3"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def columns(texts):
    """The same from whole columns: ids of each text, and their counts."""
    column = pa.array(texts, pa.string())
    found = [ids[a:b].tolist() for _, _, ids, at in OURS.rows(column) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert OURS.counts(column).tolist() == list(map(len, found))
    return found


def test_same_ids_as_the_library():
    texts = [*ODD, *(t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist())]
    want = [ids(t) for t in texts]
    assert [OURS.encode(t).tolist() for t in texts] == want
    for _ in range(2):  # with and without remembered pieces
        assert columns(texts) == want
    assert columns(texts[3:][::-1]) == want[3:][::-1]
    OURS.forget()
    assert columns(texts[:1]) == want[:1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé1 \n\t \x1c　.,<|>")), max_size=30))
def test_same_ids_on_random_text(text):
    texts = [text, text[::-1], f"{text} {text}", " " + text]
    want = [ids(t) for t in texts]
    assert columns(texts) == want
    assert [OURS.encode(t).tolist() for t in texts] == want


ROWS = [*enumerate(ODD), (50, None), *[(100 + i, "same words here") for i in range(40)]]


def test_counts_and_cache(documents, clashing, tmp_path):
    cache = str(tmp_path / "cache")
    want = sorted((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for i, t in ROWS)
    for docs in (documents(ROWS), clashing(ROWS)):
        assert sorted(map(tuple, token_counts.token_counts(docs, cache).collect())) == want
    stored = documents([]).sparkSession.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in ROWS})
    assert token_counts.token_counts(documents([]), cache).count() == 0


def test_packing_against_brute_force(documents, clashing):
    rows = [*ROWS, (900, "word " * 5000)]
    for docs in (documents(rows).repartition(3), clashing(rows)):
        got = packing.pack(docs).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        for i, t in rows:
            full, at = [*ids(t), 0], 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(full))
                assert r.ids_crc32 == zlib.crc32(np.asarray(full[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(full)
        for parts in by_seq.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= parts[0].window and len({r.window for r in parts}) == 1
            assert at == parts[0].window or parts[0].window == 1024
    assert packing.pack(documents([])).count() == 0


def test_plan_places_every_length_with_little_padding():
    rng = np.random.default_rng(3)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(rng.integers(1, 1025, 50_000), return_counts=True)), strict=True))
    placed, room = defaultdict(int), 0
    for window, many, use in packing.packing_plan(histogram):
        assert sum(length * n for length, n in use.items()) <= window
        room += many * window
        for length, n in use.items():
            placed[length] += many * n
    assert placed == histogram
    assert sum(length * n for length, n in histogram.items()) / room > 0.995


def test_bucket_bases_over_many_shelves(spark):
    rows = [(length, b, (b * 7 + length) % 5 + 1) for length in (3, 1024) for b in range(37) if b % 6]
    got = packing.bucket_bases(spark.createDataFrame(rows, "length long, bucket long, n long"), shelf=4).collect()
    assert sorted(map(tuple, got)) == sorted((length, b, sum(n for k, c, n in rows if k == length and c < b)) for length, b, _ in rows)
