"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are dealt by pairs of equal bit blocks (with radius r and r + 2 blocks, two fingerprints within r bits
agree on at least two blocks, so no link is lost). Inside each such group the fingerprints are sorted by Gray rank;
runs of neighbours form the nodes of a tree, each node holding the bits that all below it share and that its parent
doesn't hold already. A search adds up differing bits from the root down and drops a whole subtree as soon as the
sum exceeds the radius. Groups send a spanning set of links on, never all pairs; connected components follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import checkpointed, join_groups, table, texts
from cohortwave.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: A group of more fingerprints is dealt once more by a third block of equal bits, so it stays within 2**21 members.
LARGE_GROUP = 4096
#: Most keys of such groups that are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_KEYS = 50_000
FANOUT = 8
#: Up to so many fingerprints are compared in one matrix; groups of up to TINY are compared all groups at once.
SMALL = 48
TINY = 6
#: Words of 64 bits that a block of searches compares at most.
PAIRS = 1 << 20


def bit_votes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, int]:
    """For each of 64 bits (highest first) in how many shingle hashes it is set; and the number of shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(64, np.int64), 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(first), 8192):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + 8192], last[at : at + 8192], strict=True)])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return votes, len(first)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    votes, n = bit_votes(text, shingle, seed)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence: neighbours in that order differ in few bits."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: numbers of 64 bits, or rows of several."""
    apart = np.bitwise_count(a ^ b)
    return apart if apart.ndim == 1 else apart.sum(axis=-1, dtype=np.int64)


def gray_order(values: np.ndarray) -> np.ndarray:
    """Order of fingerprints by Gray rank; of several numbers, the first counts most and an odd one turns the next round."""
    if values.ndim == 1:
        return np.argsort(gray_rank(values), kind="stable")
    odd = np.cumsum(np.bitwise_count(values), axis=1) % 2
    ranks = gray_rank(values)
    ranks[:, 1:] ^= np.where(odd[:, :-1] == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return np.lexsort(ranks.T[::-1])


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order."""

    def __init__(self, values: np.ndarray, fanout: int = FANOUT) -> None:
        self.order = gray_order(values)
        self.fanout = fanout
        level_and = level_or = values[self.order]
        patterns, masks = [level_and], [np.full(level_and.shape, 0xFFFFFFFFFFFFFFFF, np.uint64)]
        while len(level_and) > fanout:
            at = np.arange(0, len(level_and), fanout)
            level_and, level_or = np.bitwise_and.reduceat(level_and, at), np.bitwise_or.reduceat(level_or, at)
            patterns.append(level_and)
            masks.append(~(level_and ^ level_or))
        # what a parent holds is left out of its children: each bit counts once on a path
        self.patterns = patterns[::-1]
        self.masks = masks[::-1]
        for depth in range(len(self.masks) - 1, 0, -1):
            above = np.repeat(self.masks[depth - 1], fanout, axis=0)[: len(self.masks[depth])]
            self.masks[depth] = self.masks[depth] & ~above

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, value number, differing bits) of all pairs at most radius bits apart."""
        q = np.repeat(np.arange(len(queries)), len(self.patterns[0]))
        node = np.tile(np.arange(len(self.patterns[0])), len(queries))
        apart = np.zeros(len(q), np.int64)
        for depth, (pattern, mask) in enumerate(zip(self.patterns, self.masks, strict=True)):
            if depth:
                q, apart = np.repeat(q, self.fanout), np.repeat(apart, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                there = node < len(pattern)
                q, apart, node = q[there], apart[there], node[there]
            apart = apart + distance(queries[q] & mask[node], pattern[node] & mask[node])
            near = apart <= radius
            q, apart, node = q[near], apart[near], node[near]
        return q, self.order[node], apart


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Positions of links that join what all links (a, b) join, the nearest first: a minimum spanning forest of n nodes."""
    labels, taken = np.arange(n), []
    order = np.argsort(apart, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(apart[order])) + 1) if len(order) else []:
        while True:
            la, lb = labels[a[level]], labels[b[level]]
            level = level[la != lb]
            if not len(level):
                break
            la, lb = labels[a[level]], labels[b[level]]
            high, first = np.unique(np.maximum(la, lb), return_index=True)  # each class joins one of a smaller label
            taken.append(level[first])
            labels[high] = np.minimum(la, lb)[first]
            while not np.array_equal(labels, up := labels[labels]):
                labels = up
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def group_forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the pairs of one group within radius bits; a block of searches of at most PAIRS at a time."""
    if len(values) <= SMALL:
        a, b = np.triu_indices(len(values), 1)
        apart = distance(values[a], values[b])
        near = apart <= radius
        a, b, apart = a[near], b[near], apart[near]
        own = spanning_forest(len(values), a, b, apart)
        return a[own], b[own]
    index, block = GrayIndex(values), max(1, PAIRS // values.size)
    a, b, apart = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(values), block):
        q, v, d = index.within(values[at : at + block], radius)
        q = q + at
        new = q < v
        a, b, apart = np.append(a, q[new]), np.append(b, v[new]), np.append(apart, d[new])
        own = spanning_forest(len(values), a, b, apart)
        a, b, apart = a[own], b[own], apart[own]
    return a, b


def spanning_links(bounds: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join all rows linked within groups fps[bounds[i]:bounds[i + 1]]; fewer than there are rows."""
    sizes = np.diff(bounds)
    small = sizes <= TINY
    ends = np.repeat(np.where(small, bounds[1:], bounds[:-1]), sizes)
    row, found = np.arange(len(fps)), []
    for step in range(1, TINY):
        a = row[row + step < ends]
        if not len(a):
            break
        apart = distance(fps[a], fps[a + step])
        near = apart <= radius
        found.append((a[near], a[near] + step, apart[near]))
    links = []
    if found:
        a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        own = spanning_forest(len(fps), a, b, apart)
        links.append((a[own], b[own]))
    for i in np.flatnonzero(~small):
        a, b = group_forest(fps[bounds[i] : bounds[i + 1]], radius)
        links.append((a + bounds[i], b + bounds[i]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in links)]), np.concatenate([none, *(b for _, b in links)])


def masks_of(radius: int) -> list[int]:
    """One mask for each pair of the radius + 2 bit blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def refined(mask: int, radius: int) -> list[int]:
    """Masks that add one of radius + 1 equal parts of the bits outside mask: one of them agrees as well."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
    return [mask | sum(1 << i for i in part) for part in parts]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_links(groups: DataFrame, keys: list[str], fp: Callable[[pa.Table], np.ndarray], node: str, radius: int) -> DataFrame:
    """Spanning links (a, b) between the nodes of each group of rows with equal keys."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        nodes = part.column(node).to_numpy()
        cut = np.flatnonzero(fresh(part)[1:]) + 1
        a, b = spanning_links(np.concatenate(([0], cut, [part.num_rows])), fp(part), radius)
        return pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def fresh(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Whether each row's keys differ from those of the row before."""
        out = np.ones(part.num_rows, bool)
        out[1:] = False
        for k in keys:
            column = part.column(k).to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part.column(k).to_numpy()
            out[1:] |= column[1:] != column[:-1]
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
            if held and ends[0] != last:
                yield linked(held)
                held = []
            last = ends[1]
            starts = np.flatnonzero(fresh(batch))
            if starts[-1]:  # the last group may go on in the next batch
                yield linked([*held, batch.slice(0, int(starts[-1]))])
                held = [batch.slice(int(starts[-1]))]
            else:
                held.append(batch)
        if held:
            yield linked(held)

    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE_GROUP) -> DataFrame:
    """Spanning links (a, b) between representatives of distinct fingerprints (columns fp, rep) within radius bits."""
    masks = masks_of(radius)
    keyed = lambda ms, base: F.array(*[F.struct(F.lit(base + i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(ms)])
    dealt = distinct.select("fp", "rep", F.explode(keyed(masks, 0)).alias("g")).select("fp", "rep", "g.t", "g.key")
    sizes = distinct.select(F.explode(keyed(masks, 0)).alias("g")).groupBy("g.t", "g.key").agg(F.count("*").alias("n")).where(F.col("n") > large)
    sizes = checkpointed(sizes)
    n_large = sizes.count()
    groups = dealt.select("fp", "rep", "t", "key")
    if n_large:  # most corpora have no such group, and then nothing needs a join
        marked = dealt.join(F.broadcast(sizes) if n_large <= BROADCAST_KEYS else sizes, ["t", "key"], "left")
        again = F.lit(None)
        for i, m in enumerate(masks):
            again = F.when(F.col("t") == i, keyed(refined(m, radius), 1000 + 100 * i)).otherwise(again)
        finer = marked.where("n is not null").select("fp", "rep", F.explode(again).alias("g")).select("fp", "rep", "g.t", "g.key")
        groups = marked.where("n is null").select("fp", "rep", "t", "key").unionByName(finer)
    return group_links(groups, ["t", "key"], lambda part: part.column("fp").to_numpy().view(np.uint64), "rep", radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a
    shingle count as one shingle; equal fingerprints are one node, so copies cost nothing; repeated rows get a row
    each; an empty table gives an empty result; other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, shingle, seed, id_col, text_col))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    parts = connected_components(links(distinct.select("fp", "rep"), radius))
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    return join_groups(rows, checkpointed(named), ["fp"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
