"""Benchmark decontamination by latent semantic retrieval.

Documents are read as blocks of words; a passage is two neighbouring blocks. Document frequencies of hashed terms are
counted over all blocks of all documents. A randomised singular value decomposition of the TF-IDF matrix of passages
gives the latent space: the product of the matrix's Gram matrix with a random sketch is summed over the passages of
all documents, and the benchmark's own items weigh as much as these. Then one more pass over all documents
projects every passage; items whose latent cosine is high enough are candidates, and are held against the windows of
four blocks around by longest common subsequence of content words and by their closing words (the answer). Items of
few content words, which no cosine can tell, are candidates wherever a window holds as many of their words as their
test needs; that bound loses nothing. Scoring needs no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from cohortwave.llm.base import SLICES, SPACE_AND_PUNCTUATION, WordScanner, chunks, sliced, summed, table, texts

BLOCK = 32
TERMS = 1 << 16
#: Terms in more than this share of all blocks are common: an item of enough other words is read without them.
COMMON = 0.05
#: Share of an item's words, in order, that a leaked passage holds; the lower one where the answer is there as well.
LCS_ALONE = 0.8
LCS_WITH_ANSWER = 0.6
ANSWER = 0.5
#: An item of fewer content words than this is read with all its words, which must stand together: with at most the
#: same share of them missing, changed or put in as LCS_ALONE allows; an item of fewer than WORDS_TO_EDIT words, with none.
LEAST_CONTENT = 5
WORDS_TO_EDIT = 10
#: Latent dimensions, and how many more the sketch has.
RANK, EXTRA = 224, 16
#: Columns of the TF-IDF matrix: an item's words are hashed to them with a sign, so that words of one column don't add up.
COLUMNS = 1 << 15
#: Latent cosine of a passage and an item from which the item is a candidate.
COSINE = 0.3
#: Items of fewer content words are looked up word by word.
LATENT_CONTENT = 8
#: The most frequent columns are multiplied as a dense matrix of at most so many passages, the others entry by entry.
DENSE, PASSAGES = 512, 2048
#: A task sums its passages over about so many bytes of text for each byte of the sketch that it sends.
TEXT_A_BYTE = 8
#: Items whose words and vectors tasks receive at once; a larger benchmark takes a pass over the documents for each such block.
ITEMS_AT_ONCE = 1_000
#: Bytes of text that a task vectorises at once: its arrays take about 60 times as much.
CHUNK_BYTES = 1 << 19
#: Counts of (window, item) that a task holds at once.
CELLS = 1 << 22
HASH_BITS = np.uint64(20)


def terms(scanner: WordScanner, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets per row, 44-bit word hashes, blocks' first index per row, and the distinct (block, word) pairs."""
    at, _, _, h = scanner.scan(data, offsets)
    h = h >> HASH_BITS
    counts = np.diff(at)
    per_row = -(-counts // BLOCK)
    first = np.concatenate(([0], np.cumsum(per_row)))
    block = np.repeat(first[:-1], counts) + (np.arange(len(h)) - np.repeat(at[:-1], counts)) // BLOCK
    pairs = np.sort((block.astype(np.uint64) << np.uint64(44)) | h)
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    return at, h, first, (pairs >> np.uint64(44)).astype(np.int64), pairs & np.uint64((1 << 44) - 1)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Over all blocks of all documents: in how many a hashed term occurs; and the numbers of blocks and of bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, df = WordScanner(SPACE_AND_PUNCTUATION, lower=True), np.zeros(TERMS + SLICES)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text"), CHUNK_BYTES):
                _, _, first, _, words = terms(scan, data, offsets)
                df[:TERMS] += np.bincount(bucket(words), minlength=TERMS)
                df[-1] += first[-1]
                df[-2] += len(data)
        yield sliced(df)

    parts = summed(docs.mapInArrow(count, "slice int, data binary"), "f8")
    df = np.concatenate([parts[s] for s in range(SLICES)]) if parts else np.zeros(TERMS + SLICES)
    return df[:TERMS], int(df[-1]), int(df[-2])


@dataclass
class Item:
    """A passage of a benchmark item, at most two blocks long; tail: the item's closing words.

    Subsequences are held against its content words; with fewer than LEAST_CONTENT, all its words must stand together.
    """

    item_id: int
    words: list[int]
    tail: list[int]
    own: list[int] = field(default_factory=list)
    masks: dict[int, int] = field(default_factory=dict)
    size: int = 0
    answer: dict[int, int] = field(default_factory=dict)
    answer_size: int = 0
    together: bool = False
    edits: int = 0
    #: How many of its own words a text must hold at least to pass holds().
    least: int = 0

    def weigh(self, content: np.ndarray) -> None:
        """content: by bucket, whether a term is a content word."""
        chosen = lambda ws: [w for w in ws if content[w & (TERMS - 1)]]
        self.own, tail = chosen(self.words), chosen(self.tail)
        self.together = len(self.own) < LEAST_CONTENT
        if self.together:
            self.own, tail = self.words, self.tail
        self.masks, self.size, self.answer, self.answer_size = bit_masks(self.own), len(self.own), bit_masks(tail), len(tail)
        self.edits = next(e for e in range(self.size, -1, -1) if self.size - e >= LCS_ALONE * self.size) if self.size >= WORDS_TO_EDIT else 0
        self.least = self.size - self.edits if self.together else next(n for n in range(self.size + 1) if n / self.size >= LCS_WITH_ANSWER)

    def holds(self, near: list[int]) -> tuple[bool, float]:
        """Whether a text of these words holds the item; and the share of the item found in order."""
        n = common(self.masks, self.size, near)
        share = n / self.size
        if self.together:
            return n >= self.least and stands(self.masks, self.size, near, self.edits), share
        return share >= LCS_ALONE or (share >= LCS_WITH_ANSWER and common(self.answer, self.answer_size, near) >= ANSWER * self.answer_size), share


def bit_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            hit = row & m
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def stands(masks: dict[int, int], size: int, words: list[int], edits: int) -> bool:
    """Whether a run of words is the item but for at most so many words missing, changed or put in."""
    last, rows = 1 << (size - 1), [(1 << e) - 1 for e in range(edits + 1)]  # bit i of row e: i + 1 words of the item end here with e edits
    for w in words:
        m = masks.get(w, 0)
        before, rows[0] = rows[0], (rows[0] << 1 | 1) & m
        for e in range(1, edits + 1):
            own = rows[e]
            rows[e] = (own << 1 | 1) & m | before | (before | rows[e - 1]) << 1 | 1
            before = own
        if any(row & last for row in rows):
            return True
    return False


def items_of(rows: list[tuple[int, str]]) -> list[Item]:
    """Benchmark texts as items; one of more words than a passage gives several, each with the closing words as answer."""
    scan, out = WordScanner(SPACE_AND_PUNCTUATION, lower=True), []
    for item_id, text in rows:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        _, _, _, h = scan.scan(raw, np.asarray([0, len(raw)]))
        words = (h >> HASH_BITS).tolist()
        tail = words[-max(3, len(words) // 5) :]
        for at in range(0, len(words), 2 * BLOCK):
            part = words[at : at + 2 * BLOCK]
            if at and len(part) < BLOCK // 2:
                part = words[-2 * BLOCK :]
            out.append(Item(item_id, part, tail))
    return out


class Postings:
    """The own words of one block of the benchmark: for each the items that hold it, and how often."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.least = np.asarray([i.least for i in items])
        word, number = np.asarray([w for i in items for w in i.own], np.uint64), np.repeat(np.arange(len(items)), [i.size for i in items])
        order = np.lexsort((number, word))
        word, number = word[order], number[order]
        head = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (number[1:] != number[:-1]))))
        self.item, self.times = number[head], np.diff(np.append(head, len(word)))
        self.vocabulary, first = np.unique(word[head], return_index=True)
        self.bounds = np.append(first, len(head))
        self.some = np.zeros(TERMS, bool)  # by bucket, so that most words of a text are passed over at once
        self.some[bucket(self.vocabulary)] = True

    def candidates(self, block: np.ndarray, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(block, item) pairs: the window from the block before to the second after may hold as many words as the item needs.

        block, words: distinct pairs; row: the row of each block. A word counts as often as the item holds it, in each block.
        """
        there = np.flatnonzero(self.some[bucket(words)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[there]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == words[there]
        there, at = there[same], at[same]
        lengths = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(lengths)
        posting = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(self.bounds[at], lengths)
        block, item, times = np.repeat(block[there], lengths), self.item[posting], self.times[posting]
        n, step = len(row), max(1, CELLS // len(row))
        for lo in range(0, len(self.items), step):
            width = min(step, len(self.items) - lo)
            own = slice(None) if width == len(self.items) else (item >= lo) & (item < lo + width)
            held = np.bincount(block[own] * width + item[own] - lo, times[own], n * width).astype(np.float32).reshape(n, width)
            total = held.copy()
            for d in (1, 2):
                near = (row[d:] == row[:-d])[:, None]
                total[:-d] += held[d:] * near
                if d == 1:
                    total[d:] += held[:-d] * near
            b, i = np.nonzero(total >= self.least[lo : lo + width])
            yield b, i + lo


def add_runs(out: np.ndarray, rows: np.ndarray, group: np.ndarray) -> None:
    """Add rows to those of out that ascending group numbers name."""
    if len(group):
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[group[head]] += np.add.reduceat(rows, head, axis=0)


@dataclass
class Part:
    """Rows of the TF-IDF matrix: the frequent columns as a dense matrix, the entries of the others by ascending row."""

    dense: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    def times(self, right: np.ndarray) -> np.ndarray:
        out = self.dense @ right[: self.dense.shape[1]]
        add_runs(out, self.weight * right[self.column], self.row)
        return out

    def add_transposed(self, right: np.ndarray, out: np.ndarray) -> None:
        """Add the product of the transposed rows with right to out."""
        out[: self.dense.shape[1]] += self.dense.T @ right
        order = np.argsort(self.column, kind="stable")
        add_runs(out, self.weight[order] * right[self.row[order]], self.column[order])


class Space:
    """Latent space of passages, over the words of one block of the benchmark."""

    def __init__(self, items: list[Item], idf: np.ndarray) -> None:
        self.vocabulary = np.unique(np.asarray([w for i in items for w in i.words], np.uint64))
        weight = idf[bucket(self.vocabulary)]
        _, column = np.unique((self.vocabulary >> np.uint64(3)) % np.uint64(COLUMNS), return_inverse=True)
        self.width = int(column.max(initial=-1)) + 1
        frequent = np.argsort(-np.bincount(column, np.exp(-weight), self.width), kind="stable")
        self.column = np.argsort(frequent)[column]  # the most frequent columns first
        sign = np.where(self.vocabulary >> np.uint64(30) & np.uint64(1), 1.0, -1.0)
        self.weight = (weight * sign).astype(np.float32)
        self.vectors = np.zeros((len(items), self.width), np.float32)
        for i, item in enumerate(items):
            _, v = self.known(np.unique(np.asarray(item.words, np.uint64)))
            np.add.at(self.vectors[i], self.column[v], self.weight[v])

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that items hold, and their numbers in the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        there = np.flatnonzero(self.vocabulary[at] == words)
        return there, at[there]

    def parts(self, row: np.ndarray, v: np.ndarray, n: int) -> Iterator[Part]:
        """The n rows of the TF-IDF matrix in parts of PASSAGES; row (ascending) and v: where its entries are."""
        bounds = np.searchsorted(row, np.arange(0, n + PASSAGES, PASSAGES))
        dense = min(DENSE, self.width)
        for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            size = min(PASSAGES, n - k * PASSAGES)
            own, column, weight = row[lo:hi] - k * PASSAGES, self.column[v[lo:hi]], self.weight[v[lo:hi]]
            rare = np.flatnonzero(column >= dense)
            often = np.flatnonzero(column < dense)
            left = np.bincount(own[often] * dense + column[often], weight[often], size * dense).astype(np.float32).reshape(size, dense)
            yield Part(left, own[rare], column[rare], weight[rare, None])

    def fit(self, docs: DataFrame, n_bytes: int, seed: int = 7) -> None:
        """Randomised SVD of the passages of all docs (text; n_bytes in all); items weigh as much as these do."""
        width, size = self.width, RANK + EXTRA
        omega = np.random.default_rng(seed).standard_normal((width, size)).astype(np.float32)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, y = WordScanner(SPACE_AND_PUNCTUATION, lower=True), np.zeros((width, size), np.float32)
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column("text"), CHUNK_BYTES):
                    _, _, first, block, words = terms(scan, data, offsets)
                    there, v = self.known(words)
                    if not len(there):
                        continue
                    inside = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
                    passage = np.cumsum(inside % 2 == 0) - 1  # pairs of blocks that don't overlap, within a row
                    for part in self.parts(passage[block[there]], v, int(passage[-1]) + 1):
                        part.add_transposed(part.times(omega), y)
            yield sliced(y)

        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, n_bytes // (TEXT_A_BYTE * width * size * 4))
        parts = summed(docs.coalesce(tasks).mapInArrow(sketch, "slice int, data binary"), "f4")
        y = np.concatenate([parts[s].reshape(-1, size) for s in range(SLICES)]) if parts else np.zeros((width, size))
        # the trace of the Gram matrix, as the sketch estimates it, once more for the items: each has the same share of it
        length = np.maximum((self.vectors**2).sum(axis=1, keepdims=True), 1e-9)
        share = max(1.0, float(np.trace(omega.T @ y)) / size) / len(self.vectors)
        y = y + share * (self.vectors.T @ (self.vectors @ omega / length))
        # eigenvectors of the Gram matrix from its product with the sketch (Nystroem)
        y += (1e-6 * float(np.linalg.norm(y)) + 1e-9) * omega
        core = omega.T.astype(np.float64) @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > max(1e-12, values.max(initial=0) * 1e-10)
        u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        self.basis = u[:, :RANK].astype(np.float32)
        queries = self.vectors @ self.basis
        self.queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        del self.vectors

    def candidates(self, block: np.ndarray, words: np.ndarray, row: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first block, item) of passages whose latent cosine with an item is at least `cosine`."""
        there, v = self.known(words)
        latent = np.concatenate([part.times(self.basis) for part in self.parts(block[there], v, len(row))])
        same = np.flatnonzero(row[1:] == row[:-1])
        latent[same] += latent[same + 1]
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        step = max(1, CELLS // max(1, len(self.queries)))
        for lo in range(0, len(row), step):
            b, i = np.nonzero(latent[lo : lo + step] @ self.queries.T >= cosine)
            yield b + lo, i


@dataclass
class Block:
    """A block of the benchmark, weighed: items that the latent space finds, and those of few content words."""

    latent: list[Item]
    few: list[Item]
    space: Space | None = None

    @classmethod
    def of(cls, items: list[Item], idf: np.ndarray, content: np.ndarray, docs: DataFrame, n_bytes: int) -> Block:
        for item in items:
            item.weigh(content)
        items = [i for i in items if i.size]
        found = cls([i for i in items if not i.together and i.size >= LATENT_CONTENT], [i for i in items if i.together or i.size < LATENT_CONTENT])
        if found.latent:
            found.space = Space(found.latent, idf)
            found.space.fit(docs, n_bytes)
        return found

    def candidates(self, block: np.ndarray, words: np.ndarray, row: np.ndarray, postings: Postings | None) -> Iterator[tuple[np.ndarray, list[Item], np.ndarray]]:
        if self.space:
            for b, i in self.space.candidates(block, words, row, COSINE):
                yield b, self.latent, i
        if postings:
            for b, i in postings.candidates(block, words, row):
                yield b, self.few, i


def search(docs: DataFrame, part: Block, leaked_col: str, lcs_col: str) -> DataFrame:
    """The columns of docs, with the items leaked into each row and the largest share of an item found in order."""
    at_text, part = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, items = WordScanner(SPACE_AND_PUNCTUATION, lower=True), part.value
        postings = Postings(items.few) if items.few else None
        for batch in batches:
            leaked: list[list[int]] = [[] for _ in range(batch.num_rows)]
            best = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(at_text), CHUNK_BYTES):
                at, h, first, block, words = terms(scan, data, offsets)
                if not first[-1]:
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                found: dict[tuple[int, int], float] = {}
                for blocks, among, numbers in items.candidates(block, words, row, postings):
                    seen, near, own = -1, [], set()
                    for p, i in zip(blocks.tolist(), numbers.tolist(), strict=True):
                        item, r = among[i], int(row[p])
                        key = (r, item.item_id)
                        if found.get(key, 0.0) >= 1.0:
                            continue
                        if p != seen:
                            a = int(at[r]) + (p - int(first[r]) - 1) * BLOCK
                            near, seen = h[max(int(at[r]), a) : min(int(at[r + 1]), a + 4 * BLOCK)].tolist(), p
                            own = set(near)
                        if sum(item.masks[w].bit_count() for w in own & item.masks.keys()) < item.least:
                            continue
                        leak, share = item.holds(near)
                        if leak:
                            found[key] = max(found.get(key, 0.0), share)
                for (r, item_id), share in found.items():
                    leaked[lo + r].append(item_id)
                    best[lo + r] = max(best[lo + r], share)
            yield pa.record_batch([*batch.columns, pa.array([sorted(set(x)) for x in leaked], pa.list_(pa.int64())), pa.array(best)], names=[*batch.schema.names, leaked_col, lcs_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(leaked_col, ArrayType(LongType())).add(lcs_col, DoubleType()))


def benchmark_blocks(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[list[Item]]:
    """The benchmark in blocks of about at_once items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    blocks = -(-rows.count() // at_once)
    for b in range(blocks):
        items = items_of([(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()])
        if items:
            yield items


def weighed(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> Iterator[Block]:
    """The benchmark's blocks, with weights and content words as docs (doc_id, text) tell them."""
    idf = None
    for items in benchmark_blocks(benchmark, at_once):
        if idf is None:
            df, n_blocks, n_bytes = frequencies(docs)
            content = df <= max(COMMON * n_blocks, 20)
            idf = np.log((n_blocks + 1) / (df + 0.5)).clip(0.05)
        yield Block.of(items, idf, content, docs.select("text"), n_bytes)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending), lcs (largest share found, 4 digits).

    Null and empty texts and items match nothing; long texts are read whole; repeated rows get a row each; an
    empty benchmark leaves every document clean; an empty table gives an empty result; other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    out = rows.withColumns({"item_ids": F.array().cast("array<long>"), "lcs": F.lit(0.0)})
    for part in weighed(rows, benchmark):
        out = search(out, part, "leaked", "share").select("doc_id", "text", F.array_union("item_ids", "leaked").alias("item_ids"), F.greatest("lcs", "share").alias("lcs"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.array_sort("item_ids").alias("item_ids"), F.round("lcs", 4).alias("lcs"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leaked item, with their columns, whatever these are called."""
    out, leaked = docs, f"leaked_{uuid.uuid4().hex}"
    for part in weighed(texts(docs), benchmark):
        out = search(out, part, leaked, f"{leaked}_share").where(F.size(leaked) == 0).select(*docs.columns)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
