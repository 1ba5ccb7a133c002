"""Ranked lexical search with range-maximum tables over posting lists.

One pass over the documents keeps the frequencies of the terms that the items use, and counts what the scores need.
Documents are then dealt in blocks. A block's posting lists lie in one array, by term and document, with the impact of
each posting and a sparse table of the positions of range maxima. An item starts with the whole block as one interval of
documents; the sum of its terms' range maxima bounds every score in it. The intervals of the largest bounds are split
at the document of the largest impact, which is scored exactly, and an interval goes as soon as its bound can't reach
the item's last place. The best of all blocks are merged in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwave.llm.base import SPACE_AND_PUNCTUATION, WordScanner, chunks, table, texts, written

BEST = 20
#: Items of one pass over the documents: about 3 MB of terms go to each task, and BEST rows an item come back from it.
ITEMS_AT_ONCE = 10_000
#: Documents of one block of posting lists (some 100 MB with its tables), and postings at most.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 21
#: Intervals split in one step, at least; otherwise a quarter of those that wait.
SPLITS = 64
#: Groups in which the best of the blocks are merged first.
GROUPS = 64
ITEM = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def scanner() -> WordScanner:
    """Terms: runs of ASCII letters, digits and any other characters, with A-Z lower-cased."""
    return WordScanner(SPACE_AND_PUNCTUATION, lower=True, latin=False)


@dataclass
class Items:
    """ids: of the rows of a benchmark; terms: sorted hashes of all their terms; at, times: each item's positions in terms, and repeats."""

    ids: list[int | None]
    terms: np.ndarray
    at: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, ids: list[int | None], bodies: list[str]) -> Items:
        scan, found = scanner(), []
        for lo, hi, data, offsets in chunks(pa.array(bodies, pa.string())):
            bounds, _, _, h = scan.scan(data, offsets)
            found += [np.unique(h[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(hi - lo)]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in found)]))
        return cls(ids, terms, [np.searchsorted(terms, t) for t, _ in found], [n.astype(np.int64) for _, n in found])


def item_blocks(benchmark: DataFrame, at_once: int) -> Iterator[Items]:
    """The benchmark's rows in blocks of about at_once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = -(-rows.count() // at_once)
    for b in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if held:
            yield Items.of([r["item_id"] for r in held], [r["text"] for r in held])


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many terms it has, and which of the asked ones how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                bounds, _, _, h = scan.scan(data, offsets)
                n = np.diff(bounds)
                row, place = np.repeat(np.arange(hi - lo), n), np.searchsorted(terms, h)
                known = place < len(terms)
                known[known] = terms[place[known]] == h[known]
                key, tf = np.unique(row[known] * max(1, len(terms)) + place[known], return_counts=True)
                key_row, key_term = np.divmod(key, max(1, len(terms)))
                cuts = pa.array(np.searchsorted(key_row, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (key_term, tf)]
                out = pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class PostingLists:
    """A block of documents in order of doc_id: its postings by term and document, their impacts, and range-maximum tables."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, row: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.argsort(doc_ids, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.ids, self.docs = doc_ids[order], len(doc_ids)
        m = 75 + 25 * lengths * n_docs // n_terms
        impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[row]))
        key = terms * self.docs + rank[row]
        by_key = np.argsort(key)
        self.keys, self.impact = key[by_key], impact[by_key]
        # one table for all lists: a range never leaves its list
        longest = int(np.bincount(terms).max()) if len(terms) else 1
        self.tables = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 ** len(self.tables) <= longest:
            below, half = self.tables[-1], 2 ** (len(self.tables) - 1)
            a, b = below[:-half], below[half:]
            level = below.copy()  # what runs past the end is never asked for
            level[: len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.tables.append(level)
        self.flat = np.concatenate(self.tables) if len(self.keys) else np.zeros(0, np.int32)

    def highest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Position of the largest impact of each range of postings that isn't empty (0 for the others)."""
        size = last - first
        there = size > 0
        level = np.frexp(np.where(there, size, 1).astype(np.float64))[1] - 1
        base = level * len(self.keys)
        a = self.flat[np.where(there, base + first, 0)]
        b = self.flat[np.where(there, base + last - (1 << level), 0)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def bound(self, first: np.ndarray, last: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of ranges: the sum of their largest impacts, and the document of the largest of all."""
        top = self.highest(first, last)
        value = np.where(last > first, self.impact[top] * times, 0)
        own = np.arange(len(value))
        return value.sum(axis=1), self.keys[top[own, value.argmax(axis=1)]] % self.docs

    def search(self, at: np.ndarray, times: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of this block and of what is known, equal scores by id."""
        scores, ids = best
        start = at * self.docs
        first, last = np.searchsorted(self.keys, start)[None, :], np.searchsorted(self.keys, start + self.docs)[None, :]
        there = np.flatnonzero(last[0] > first[0])
        if not len(there):
            return best
        start, times, first, last = start[there], times[there], first[:, there], last[:, there]
        low = np.zeros(1, np.int64)
        bound, split = self.bound(first, last, times)
        while True:
            if len(scores) == k:
                hope = (bound > scores[-1]) | ((bound == scores[-1]) & (self.ids[np.minimum(low, self.docs - 1)] < ids[-1]))
            else:
                hope = bound > 0
            first, last, low, bound, split = first[hope], last[hope], low[hope], bound[hope], split[hope]
            if not len(bound):
                return scores, ids
            some = max(SPLITS, len(bound) // 4)
            wait = np.zeros(len(bound), bool)
            if len(bound) > some:
                wait[np.argpartition(-bound, some)[some:]] = True
            now = ~wait
            key = start + split[now, None]
            left = np.searchsorted(self.keys, key)
            inside = np.minimum(left, len(self.keys) - 1)
            hit = self.keys[inside] == key
            exact = (np.where(hit, self.impact[inside], 0) * times).sum(axis=1)
            scores, ids = merged(np.append(scores, exact), np.append(ids, self.ids[split[now]]), k)
            f = np.concatenate([first[now], left + hit])
            t = np.concatenate([left, last[now]])
            b, s = self.bound(f, t, times)
            first, last, low = np.concatenate([first[wait], f]), np.concatenate([last[wait], t]), np.concatenate([low[wait], low[now], split[now] + 1])
            bound, split = np.append(bound[wait], b), np.append(split[wait], s)


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))
    order = order[scores[order] > 0][:k]
    return scores[order], ids[order]


#: Stands for a null doc_id, which comes last among equal scores.
NO_ID = (1 << 63) - 1


def search_blocks(found: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int, block_docs: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none) for _ in items.ids]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            lists = part.column("terms").combine_chunks()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            values = lambda c: part.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
            block = PostingLists(part.column("doc_id").to_numpy(), part.column("n").to_numpy(), values("terms"), values("tfs"), row, weights, n_docs, n_terms)
            for i, (at, times) in enumerate(zip(items.at, items.times, strict=True)):
                best[i] = block.search(at, times, best[i], k)
            held.clear()

        rows = size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
                if rows >= block_docs or size >= BLOCK_POSTINGS:
                    search()
                    rows = size = 0
        if held:
            search()
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(s) for s, _ in best])
        yield pa.record_batch([pa.array(item), pa.array(np.concatenate([none, *(i for _, i in best)])), pa.array(np.concatenate([none, *(s for s, _ in best)]))], schema=ITEM)

    return found.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of the benchmark.

    Null and empty texts have no terms, match nothing and are no part of the counts; repeated rows are documents of
    their own, and a repeated item is ranked again; null ids come last among equal scores; long texts are read whole;
    an empty table on either side gives an empty result; other columns are not read.
    """
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in item_blocks(benchmark, items_at_once):
        found = written(postings(rows, items.terms), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(items.terms), np.int64)
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        tasks = max(spark.sparkContext.defaultParallelism, -(-n_docs // block_docs))
        dealt = found.where(F.size("terms") > 0).repartition(tasks, F.xxhash64("doc_id", "n", "terms"))
        best = search_blocks(dealt, items, weights, n_docs, n_terms, k, block_docs)
        order = [F.desc("score"), "doc_id"]
        few = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))).orderBy(*order))).where(F.col("rank") <= k)
        first = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        out = out.unionByName(first.join(F.broadcast(ids), "item").select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
occ AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term, n_docs),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weight USING (term), stats GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 20
"""
