"""Removal of repeated word windows by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the least hash of its k-word grams; consecutive windows that
share it form one super-k-mer. Pass one sends only addresses: (minimiser, SHA-256 of the packed words, document).
Where a minimiser has a single packed string, all its windows are known from the smallest document alone. Only where
several strings share a minimiser do the packed words travel to the minimiser's bucket, once per distinct string, and
are sorted window by window. The strings of a large bucket are cut anew by a second minimiser, and by a third. What
stays large shares single windows among very many strings; these are grouped by the windows' digests, with minima
combined before the shuffle, so that no bucket of them is ever held. Every other bucket is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import ASCII_SPACE, HEAVY, Powers, WordScanner, checkpointed, chunks, join_groups, ranged_hash, table, texts, written

WIDTH = 50
GRAM = 8
#: Distinct strings of a bucket (about 2 MB of words, 100,000 windows to sort) beyond which it is cut anew.
FULL_BUCKET = 5_000
#: Most large buckets whose keys are broadcast (a few MB).
LARGE_KEYS = 50_000
#: Bases of the hashes whose least value is the first, second and third minimiser of a window.
MINIMISERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

#: row: a digest of the text, so that rows of one id stay apart; p1, p2: digest of the packed words.
OCCURRENCE = "doc_id long, row long, start int, n int, mh long, p1 long, p2 long"
PACKED = "mh long, p1 long, p2 long, first_doc long, last_doc long, off int, packed binary"
WINDOWS = "p1 long, p2 long, off int, n int, least long"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(hashes: np.ndarray, doc_words: np.ndarray, width: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(row, first word, windows, minimiser) of each super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(hashes) < width:
        return (none,) * 4
    grams = len(hashes) - gram + 1
    position = np.arange(len(hashes))
    least = sliding_min(ranged_hash(hashes, position[:grams], position[:grams] + gram, powers), width - gram + 1)
    counts = np.diff(doc_words)
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    at = np.flatnonzero(position[: len(least)] + width <= doc_words[row + 1])
    if not len(at):
        return (none,) * 4
    mh = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (mh[1:] != mh[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    head = np.flatnonzero(fresh)
    return row[at[head]], at[head], np.diff(np.append(head, len(at))), mh[head].view(np.int64)


class Packer:
    """Words of a chunk of texts, joined by one space each: the packed words of any run of them is a slice."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        lengths = last - first
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        joined = np.full(int(self.starts[-1]), 32, np.uint8)
        inside = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        joined[np.arange(len(inside)) + np.repeat(np.arange(len(first)), lengths)] = data[inside]
        self.raw = memoryview(joined.tobytes())

    def runs(self, first: np.ndarray, words: np.ndarray) -> Iterator[memoryview]:
        for a, b in zip(self.starts[first].tolist(), (self.starts[first + words] - 1).tolist(), strict=True):
            yield self.raw[a:b]


def digests(packed: Iterable[memoryview]) -> np.ndarray:
    """The first 16 bytes of the SHA-256 of each, as two columns."""
    return np.frombuffer(b"".join(hashlib.sha256(p).digest()[:16] for p in packed), np.int64).reshape(-1, 2)


def occurrences(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = WordScanner(ASCII_SPACE), Powers(MINIMISERS[0])
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                doc_words, first, last, hashes = scanner.scan(data, offsets)
                row, start, n, mh = super_kmers(hashes, doc_words, width, gram, powers)
                if len(row):
                    key = digests(Packer(data, first, last).runs(start, n + width - 1))
                    at = pa.array(lo + row)
                    start = (start - doc_words[row]).astype(np.int32)
                    yield pa.record_batch([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(start), pa.array(n.astype(np.int32)), pa.array(mh), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["doc_id", "row", "start", "n", "mh", "p1", "p2"])

    return rows.where("doc_id is not null").mapInArrow(run, OCCURRENCE)


def packed_strings(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The words of each wanted super-k-mer, joined by one space, from its smallest document."""
    by_row = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")).agg(F.collect_list(F.struct("first.start", "n", "mh", "p1", "p2", "last_doc")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "parts")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                out += [(p["mh"], p["p1"], p["p2"], doc, p["last_doc"], 0, b" ".join(words[p["start"] : p["start"] + p["n"] + width - 1])) for p in parts]
            yield packed_batch(out)

    return rows.join(by_row, ["doc_id", "row"]).select("doc_id", "text", "parts").mapInArrow(cut, PACKED)


def packed_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 7
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["mh", "p1", "p2", "first_doc", "last_doc", "off", "packed"])


def runs(least: list[int]) -> list[tuple[int, int, int]]:
    """(first window, windows, smallest document) for runs of equal values."""
    out: list[tuple[int, int, int]] = []
    for i, d in enumerate(least):
        if out and out[-1][2] == d:
            out[-1] = (out[-1][0], out[-1][1] + 1, d)
        else:
            out.append((i, 1, d))
    return out


def windows_of(packed: bytes, width: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def cut_anew(strings: DataFrame, width: int, gram: int, base: int) -> DataFrame:
    """Strings of large buckets as shorter ones, by another minimiser of their windows; equal windows share a bucket again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = WordScanner(b" "), Powers(base)
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("mh", "p1", "p2", "first_doc", "last_doc", "off")]
            for lo, hi, data, offsets in chunks(batch.column("packed")):
                doc_words, first, last, hashes = scanner.scan(data, offsets)
                row, start, n, mh = super_kmers(hashes, doc_words, width, gram, powers)
                for r, at, finer, packed in zip((lo + row).tolist(), (start - doc_words[row]).tolist(), mh.tolist(), Packer(data, first, last).runs(start, n + width - 1), strict=True):
                    above, p1, p2, doc, least, off = (c[r] for c in cols)
                    out.append(((above * 0x9E3779B97F4A7C15 + finer) % (1 << 64) - (1 << 63), p1, p2, doc, least, off + at, bytes(packed)))
            yield packed_batch(out)

    return strings.mapInArrow(run, PACKED)


DEALT = "w1 long, w2 long, p1 long, p2 long, first_doc long, last_doc long, off int"


def single_windows(strings: DataFrame, width: int) -> DataFrame:
    """A row for each window of the strings: the first 16 bytes of the SHA-256 of its words, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                windows = [windows_of(p, width) for p in part.column("packed").to_pylist()]
                sizes = [len(w) for w in windows]
                key = digests(w for own in windows for w in own)
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                inside = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                off = part.column("off").take(row).to_numpy() + inside
                yield pa.record_batch([pa.array(key[:, 0]), pa.array(key[:, 1]), *[part.column(c).take(row) for c in ("p1", "p2", "first_doc", "last_doc")], pa.array(off.astype(np.int32))], names=[c.split()[0] for c in DEALT.split(", ")])

    return strings.mapInArrow(run, DEALT)


def grouped_windows(strings: DataFrame, width: int) -> DataFrame:
    """What sorted_buckets() tells, of strings that many share a window: the smallest document of each window by a grouped
    minimum, combined before the shuffle, and that of a window in very many strings by a broadcast. No task holds a bucket."""
    windows = written(single_windows(strings, width), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("first_doc").alias("least"), F.count("*").alias("n"))
    met = join_groups(windows, checkpointed(least), ["w1", "w2"]).where("least < last_doc")
    return met.select("p1", "p2", "off", F.lit(1).alias("n"), "least")


def sorted_buckets(strings: DataFrame, width: int) -> DataFrame:
    """Sort the windows of each bucket; the smallest document of each, per string."""

    def bucket(members: list[tuple]) -> list[tuple]:
        found = sorted((w, doc, s, i) for s, (_, _, doc, _, _, packed) in enumerate(members) for i, w in enumerate(windows_of(packed, width)))
        least = [[0] * (m[5].count(b" ") + 2 - width) for m in members]
        now, low = None, 0
        for w, doc, s, i in found:
            if w != now:
                now, low = w, doc
            least[s][i] = low
        return [(p1, p2, off + at, n, low) for (p1, p2, _, last, off, _), row in zip(members, least, strict=True) for at, n, low in runs(row) if low < last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["p1", "p2", "off", "n", "least"])

        held_mh, held, out = None, [], []
        for batch in batches:
            for mh, *member in zip(*(batch.column(c).to_pylist() for c in ("mh", "p1", "p2", "first_doc", "last_doc", "off", "packed")), strict=True):
                if mh != held_mh:
                    if held:
                        out += bucket(held)
                    held_mh, held = mh, []
                held.append(tuple(member))
                if len(out) > 20_000:
                    yield emit(out)
                    out = []
        if held:
            out += bucket(held)
        if out:
            yield emit(out)

    return strings.repartition("mh").sortWithinPartitions("mh").mapInArrow(run, WINDOWS)


def bucket_sizes(strings: DataFrame) -> DataFrame:
    return strings.groupBy("mh").agg(F.count("*").alias("strings"))


def split_by_size(strings: DataFrame, full: int) -> tuple[DataFrame, DataFrame | None]:
    """Strings of buckets of at most `full` strings, and the others (None without any)."""
    large = checkpointed(bucket_sizes(strings).where(F.col("strings") > full).select("mh"))
    if large.isEmpty():
        return strings, None
    few = large.count() <= LARGE_KEYS  # a table of known size may be broadcast, a larger one is joined by a shuffle
    large = F.broadcast(large) if few else large
    return strings.join(large, "mh", "left_anti"), strings.join(large, "mh", "left_semi").select(*strings.columns)


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, full: int = FULL_BUCKET) -> DataFrame:
    """(doc_id, row, start, n): runs of n windows from word `start` on whose words also start in a document of smaller id."""
    occ = written(occurrences(docs, width, gram), "super-kmers")
    strings = occ.groupBy("mh", "p1", "p2").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.max("doc_id").alias("last_doc"), F.max("n").alias("n"), F.count("*").alias("copies"))
    strings = written(strings, "strings")
    marked = join_groups(strings, checkpointed(bucket_sizes(strings)), ["mh"], "strings")
    known = marked.where("strings = 1 and first.doc_id < last_doc").select("p1", "p2", F.lit(0).alias("off"), "n", F.col("first.doc_id").alias("least"))
    rest: DataFrame | None = written(packed_strings(docs, marked.where("strings > 1"), width), "packed")
    for base in MINIMISERS[1:]:
        small, rest = split_by_size(rest, full)
        known = known.unionByName(sorted_buckets(small, width))
        if rest is None:
            break
        rest = written(cut_anew(rest, width, gram, base), "packed")
    if rest is not None:
        small, rest = split_by_size(rest, full)
        known = known.unionByName(sorted_buckets(small, width))
        if rest is not None:
            known = known.unionByName(grouped_windows(rest, width))
    places = occ.select("doc_id", "row", "start", "p1", "p2")
    hit = join_heavy_strings(places, written(known, "known"), strings).where("least < doc_id")
    return hit.select("doc_id", "row", (F.col("start") + F.col("off")).alias("start"), "n")


def join_heavy_strings(places: DataFrame, known: DataFrame, strings: DataFrame) -> DataFrame:
    """Inner join of places with what is known of their string; strings of very many copies, 1 / HEAVY at most, by a broadcast."""
    key = ["p1", "p2"]
    total = strings.agg(F.sum("copies")).first()[0] or 0
    heavy = F.broadcast(strings.where(F.col("copies") > total * HEAVY).select(*key))
    hot = known.join(heavy, key, "left_semi")
    if hot.count() > LARGE_KEYS:
        return places.join(known, key)
    return places.join(F.broadcast(hot), key).unionByName(places.join(heavy, key, "left_anti").join(known.join(heavy, key, "left_anti"), key))


def without_repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, full: int = FULL_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (kept words joined by one space).

    Null, empty and short texts lose nothing (nulls have no words); a document's own repeats count only through
    documents of smaller id; rows of equal id, of one text or several, neither remove nor touch each other; rows with
    a null id remove nothing and lose nothing; an empty table gives an empty result; other columns are not read.
    """
    rows = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    cover = repeated_windows(rows, width, gram, full).distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("cover"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, cover in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = 0
                if cover:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first = np.asarray([c["start"] for c in cover])
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.minimum(first + np.asarray([c["n"] for c in cover]) + width - 1, len(words)), -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    words_left = [words[i] for i in np.flatnonzero(~covered)]
                else:
                    words_left = words
                total.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words_left).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(cover, ["doc_id", "row"], "left").select("doc_id", "text", "cover").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, (SELECT unnest(generate_series(0, 49)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
