"""Size-aware heavy-light Jaccard join of shingle sets, whole in its links' components.

Equal sets are one node. Small sets are joined by enumeration: two sets of sizes a and b are linked exactly when they
share a subset of as many shingles as their similarity asks for, so every set is dealt under all its subsets of that
size. Large sets are joined by inverted lists: of each set only the first shingles of a common order are listed, as many
as a linked pair can't both do without. Frequent shingles come last in that order. The boundary between small and large
is where the counted cost of both ways is least.

A list of near copies is never turned into all its pairs. Each set is compared first with the pivot that it meets in
most of its lists, exactly, by the sets themselves; what is linked becomes one component. Rounds of other pivots follow for members that are not in
their list's main component, and in the end every pair of a list that still lies in two components is compared. A pair
in one component needs no comparison: it changes no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import ASCII_SPACE, Powers, WordScanner, checkpointed, chunks, join_groups, mix, ranged_hash, table, texts, written
from cohortwave.llm.components import connected_components

SHINGLE, PERCENT = 5, 80
#: Largest size whose subsets may be enumerated (at most some 800 subsets a set); the boundary is chosen by cost up to it.
SMALL_SET = 16
#: Shingles counted at once in a task; those seen twice among so many are counted over all tasks.
COUNTED = 1 << 22
#: Frequent shingles that come last in the order (2 MB to each task), and from how many sets on one is frequent.
FREQUENT, OFTEN = 1 << 18, 16
#: Comparisons with one set, above which its shingles are dealt to several tasks.
SPREAD = 256
#: Entries that meet an entry outside its list's main component, on average, up to which all are compared at once.
WORTH = 64
#: Rounds of further pivots at most, before all pairs between components are compared; they end when fewer than one in twenty of a round's pairs were links.
ROUNDS = 6
#: Longs of the parity bits of a set; sets of up to some 1,500 shingles are told apart by them.
PARITY = 32
BROADCAST_IDS = 500_000
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
READ = "doc_id long, node long, n int, small array<long>, bits array<long>, token long, times long"


def least_overlap(both: int | np.ndarray | Column, percent: int) -> int | np.ndarray | Column:
    """Fewest common elements of two linked sets whose sizes add up to `both`."""
    top = percent * both + 99 + percent
    return F.floor(top / (100 + percent)).cast("int") if isinstance(both, Column) else top // (100 + percent)


def least_size(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The smallest size of a set that may be linked with one of size n."""
    return -(-percent * n // 100)


def shingle_hashes(words: np.ndarray, shingle: int, powers: Powers) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    first = np.arange(len(words) - width + 1)
    return np.unique(ranged_hash(words, first, first + width, powers))


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(tokens.tobytes()).digest()[:8], "little", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bits that each token of a set turns over once: two sets differ in at least as many tokens as in bits."""
    own = tokens % np.uint64(64 * PARITY)
    odd = np.bincount(own.astype(np.int64), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def shingled(batch: pa.RecordBatch, scanner: WordScanner, shingle: int, powers: Powers) -> Iterator[np.ndarray]:
    for lo, hi, data, offsets in chunks(batch.column("text")):
        at, _, _, h = scanner.scan(data, offsets)
        for i in range(hi - lo):
            yield shingle_hashes(h[at[i] : at[i + 1]], shingle, powers)


def tools() -> tuple[WordScanner, Powers]:
    return WordScanner(ASCII_SPACE, lower=True, latin=False), Powers(0xD6E8FEB86659FD93)


def read_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """A row for each document (doc_id, node, n; small: its shingles if they are few), and rows (token, times) of
    shingles that a task saw in several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = tools()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            token, times = token[times > 1].view(np.int64), times[times > 1]
            none = pa.nulls(len(token), pa.int64())
            lists = pa.nulls(len(token), pa.list_(pa.int64()))
            return pa.record_batch([none, none, pa.nulls(len(token), pa.int32()), lists, lists, pa.array(token), pa.array(times.astype(np.int64))], names=names)

        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            node, n, small, bits = [], [], [], []
            for tokens in shingled(batch, scanner, shingle, powers):
                own = node_of(tokens)
                node.append(own)
                n.append(len(tokens))
                small.append(tokens.view(np.int64) if 0 < len(tokens) <= SMALL_SET else None)
                bits.append(parity(tokens))
                if own not in seen:
                    seen.add(own)
                    held.append(tokens)
                    size += len(tokens)
                    if size >= COUNTED:
                        yield counted()
                        size = 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(small, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), none, none], names=names)
        if held:
            yield counted()

    return rows.mapInArrow(run, READ)


class Order:
    """A common order of shingles: by hash, and behind all of these the frequent ones, the rarest first."""

    def __init__(self, frequent: list[int]) -> None:
        tokens = np.asarray(frequent, np.int64).view(np.uint64)
        by_token = np.argsort(tokens)
        self.tokens, self.rank = tokens[by_token], by_token.astype(np.uint64)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        keys = tokens >> np.uint64(1)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            keys = np.where(self.tokens[at] == tokens, (np.uint64(1) << np.uint64(63)) + self.rank[at], keys)
        return keys

    def first(self, tokens: np.ndarray, count: int) -> np.ndarray:
        """The first tokens in order; equal keys go by token."""
        return tokens[np.lexsort((tokens, self.keys(tokens)))[:count]]


def list_entries(rows: DataFrame, order: Order, shingle: int, percent: int) -> DataFrame:
    """(token, node, n, pos): the listed shingles of each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = tools()
        seen: set[int] = set()
        for batch in batches:
            found: list[np.ndarray] = []
            node, n = [], []
            for tokens in shingled(batch, scanner, shingle, powers):
                if len(tokens) and (own := node_of(tokens)) not in seen:
                    seen.add(own)
                    found.append(order.first(tokens, listed(len(tokens), percent)))
                    node.append(own)
                    n.append(len(tokens))
            if found:
                lengths = [len(f) for f in found]
                pos = np.arange(sum(lengths)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.asarray(node, np.int64), lengths)), pa.array(np.repeat(np.asarray(n, np.int32), lengths)), pa.array(pos.astype(np.int32))], names=["token", "node", "n", "pos"])

    return rows.mapInArrow(run, "token long, node long, n int, pos int")


LISTS = "token long, node long, n int, pos int"


def shared_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists of several sets. A task holds one batch and one entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first entry of the list that the last batch ended in; whether it was sent; the last node seen
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            token, node = cols[0], cols[1]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            if held is not None:
                new[0] = token[0] != held[0][0] or node[0] != held[2]
            last_node = int(node[-1])
            cols = [c[new] for c in cols]
            sent = False
            if held is not None:
                cols = [np.append(np.asarray([h], c.dtype), c) for h, c in zip(held[0], cols, strict=True)]
                sent = held[1]
            token = cols[0]
            if not len(token):
                continue
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            start = np.flatnonzero(head)
            sizes = np.diff(np.append(start, len(token)))
            keep = np.repeat(sizes > 1, sizes)
            if sent:
                keep[0] = False
                keep[1 : sizes[0]] = True
            at = int(start[-1])
            held = (tuple(c[at].item() for c in cols), bool(sizes[-1] > 1) or (sent and at == 0), last_node)
            yield pa.record_batch([pa.array(c[keep]) for c in cols], names=[c.split()[0] for c in LISTS.split(", ")])

    return entries.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, LISTS)


def subset_size(n: int, m: int, percent: int) -> int:
    return least_overlap(n + m, percent)


def partners(n: int, most: int, percent: int) -> list[int]:
    """Sizes up to `most` that a set of size n may be linked with."""
    return [m for m in range(least_size(n, percent), most + 1) if least_size(m, percent) <= n]


def enumeration(n: int, most: int, percent: int) -> int:
    return sum(comb(n, subset_size(n, m, percent)) for m in partners(n, most, percent) if subset_size(n, m, percent) <= min(n, m))


def listed(n: int, percent: int) -> int:
    """How many shingles of a set of size n are listed."""
    return n - least_size(n, percent) + 1


def boundary(sets: dict[int, int], scans: dict[int, int], percent: int, most: int | None = None) -> int:
    """The largest size that is enumerated: where subsets of small sets, and list entries of large ones with those they meet, are fewest.

    sets: how many there are of each size; scans: list entries that sets of each size meet.
    """
    most = SMALL_SET if most is None else most
    lists = {n: sets.get(n, 0) * listed(n, percent) + scans.get(n, 0) for n in range(1, most + 1)}
    cost = {x: sum(sets.get(n, 0) * enumeration(n, x, percent) for n in range(1, x + 1)) + sum(c for n, c in lists.items() if n > x) for x in range(most + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def enumerated_pairs(small: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) that span those of the sets (node, small) of at most `most` shingles, by common subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node, side = [], [], []
            for own, tokens in zip(batch.column("node").to_pylist(), batch.column("small").to_pylist(), strict=True):
                n = len(tokens)
                values = np.sort(np.asarray(tokens, np.int64).view(np.uint64))
                for m in partners(n, most, percent):
                    size = subset_size(n, m, percent)
                    if size > min(n, m):
                        continue
                    chosen = values[np.asarray(list(combinations(range(n), size)))]
                    h = np.full(len(chosen), min(n, m) << 32 | max(n, m), np.uint64)
                    for column in chosen.T:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
                    key.append(h.view(np.int64))
                    node += [own] * len(h)
                    side += [n > m] * len(h)
            none = np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.concatenate([none, *key])), pa.array(node, pa.int64()), pa.array(side, pa.bool_()), pa.array(np.zeros(len(node), np.int32))], names=["key", "node", "larger", "_"])

    subsets = written(small.mapInArrow(run, "key long, node long, larger boolean, _ int").drop("_"), "subsets")
    # sets of two sizes that share a subset are all linked across: each links the other side's first
    ends = subsets.groupBy("key").agg(F.min(F.when(~F.col("larger"), F.col("node"))).alias("low"), F.min(F.when(F.col("larger"), F.col("node"))).alias("high"), F.count("*").alias("n")).where("n > 1")
    other = F.when(F.col("larger") | F.col("high").isNull(), F.col("low")).otherwise(F.col("high"))
    found = join_groups(subsets, checkpointed(ends), ["key"]).select(other.alias("a"), F.col("node").alias("b"))
    return found.where("a is not null and a <> b").distinct()


def possible(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, percent: int) -> Column:
    """Whether sets of these sizes may be linked if their first common shingle has these places in them."""
    sizes = F.lit(100) * F.least(a_n, b_n) >= F.lit(percent) * F.greatest(a_n, b_n)
    return sizes & (F.least(a_n - a_pos, b_n - b_pos) >= least_overlap(a_n + b_n, percent))


def sets_of(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens) of the wanted sets (node, rep: the document to read it from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = tools()
        for batch in batches:
            found = list(shingled(batch, scanner, shingle, powers))
            yield pa.record_batch([pa.array([node_of(t) for t in found], pa.int64()), pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))], names=["node", "tokens"])

    n = wanted.count()
    hint = F.broadcast if n <= BROADCAST_IDS else (lambda df: df)
    read = rows.join(hint(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(run, "node long, tokens array<long>")
    sets = written(read.join(hint(wanted.select("node")), "node", "left_semi"), "sets")
    return sets if sets.count() == n else written(sets.dropDuplicates(["node"]), "sets")  # rows of one id may hold a set several times


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by the sets; pairs that parity bits tell apart go before the sets are read.

    A set of very many comparisons is dealt to several tasks.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(wanted.join(nodes.select("node", "rep", "n", "bits"), "node"), "wanted")
    side = lambda c: wanted.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.col("n_a") + F.col("n_b")
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= both - 2 * least_overlap(both, percent)).select("a", "b"), "near")
    left_over = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(rows, checkpointed(wanted.select("node", "rep").join(left_over, "node", "left_semi")), shingle)
    counts = checkpointed(near.groupBy("a").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    dealt = join_groups(near, counts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    left = counts.join(sets, counts["a"] == sets["node"]).select("a", F.col("tokens").alias("left"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b").join(left, ["a", "part"])
    shared = F.size(F.array_intersect("left", "right"))
    return written(met.where(F.lit(100) * shared >= F.lit(percent) * (F.size("left") + F.size("right") - shared)).select("a", "b"), "links")


def best_pivots(entries: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """Of the pivots that each set meets in its lists, the one of most lists: pairs (a: pivot, b); those of tested (a < b) are passed over."""
    met = entries.where("p_node <> node").groupBy("node", "p_node").agg(F.count("*").alias("n"))
    if tested is not None:
        met = met.select("*", F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).join(tested, ["a", "b"], "left_anti")
    return met.groupBy("node").agg(F.max(F.struct("n", "p_node")).alias("best")).select(F.col("best.p_node").alias("a"), F.col("node").alias("b"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def linked_components(lists: DataFrame, first: DataFrame, verify: Callable[[DataFrame], DataFrame], boundary_: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(node, component) over all links between the sets of lists; first: pairs that span the enumerated ones; verify keeps the linked of pairs.

    Known links (a, b) are taken as they are, and sets that have one a in common with each other, or are it, aren't compared first.
    """
    c = F.col
    large = F.greatest("n", "p_n") > boundary_
    fits = possible(c("n"), c("pos"), c("p_n"), c("p_pos"), percent)
    # a text with few edits shares most of its listed shingles with others, and is nearest to them all: the pivot of its lists
    degree = checkpointed(lists.groupBy("node").agg(F.count("*").alias("degree")))
    pivots = lists.join(degree, "node").groupBy("token").agg(F.max(F.struct("degree", "node", "n", "pos")).alias("p"), F.count("*").alias("n_list"))
    pivots = checkpointed(pivots.select("token", c("p.node").alias("p_node"), c("p.n").alias("p_n"), c("p.pos").alias("p_pos"), "n_list"))
    pairs = best_pivots(join_groups(lists, pivots, ["token"], "n_list").where(large & fits)).unionByName(first).distinct()
    if known is None:
        pairs = written(pairs, "pairs")
        links = found = verify(pairs)
    else:
        centres = checkpointed(known.groupBy("b").agg(F.min("a").alias("centre")))
        of = lambda end: centres.select(c("b").alias(end), c("centre").alias(f"c_{end}"))
        apart = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
        pairs = written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b"), "pairs")
        links = found = checkpointed(known.unionByName(verify(pairs)))
    tested, sent, mixed = ordered(pairs), pairs.count(), lists
    for i in range(1, ROUNDS + 1):
        parts = checkpointed(connected_components(links))
        labelled = mixed.join(parts, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("label"))
        # the pivot is the member with the fewest shingles before the list's: the least edited one is linked with most of the others
        counts = labelled.groupBy("token", "label").agg(F.count("*").alias("n_label"), F.max(F.struct((-c("pos")).alias("late"), F.xxhash64("node", F.lit(i)).alias("h"), "node", "n", "pos")).alias("pivot"))
        main = counts.groupBy("token").agg(F.max(F.struct("n_label", "label", "pivot")).alias("m"), F.sum("n_label").alias("n_list"), F.count("*").alias("labels")).where("labels > 1")
        main = checkpointed(main.select("token", c("m.label").alias("main"), c("m.pivot.node").alias("p_node"), c("m.pivot.n").alias("p_n"), c("m.pivot.pos").alias("p_pos"), "n_list", c("m.n_label").alias("n_main")))
        total, apart = main.agg(F.sum("n_list"), F.sum((c("n_list") - c("n_main")) * c("n_list"))).first()
        if not apart:
            return parts
        # only lists with several components matter from here on
        mixed = written(join_groups(labelled, main, ["token"], "n_list").drop("n_list", "n_main"), "mixed")
        outside = mixed.where("label <> main")
        if i == ROUNDS or apart <= WORTH * total or 20 * found.count() < sent:
            break
        fresh = written(ordered(best_pivots(outside.where(large & fits), tested)), "pairs")
        tested, sent = tested.unionByName(fresh), fresh.count()
        found = verify(fresh)
        links = links.unionByName(found)
        mixed = mixed.select("token", "node", "n", "pos")
    x, y = outside.alias("x"), mixed.select("token", "node", "n", "pos", "label").alias("y")
    apart = (c("x.token") == c("y.token")) & (c("x.label") != c("y.label")) & (F.greatest("x.n", "y.n") > boundary_) & possible(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"), percent)
    rest = ordered(x.join(y, apart).select(c("x.node").alias("a"), c("y.node").alias("b"))).join(tested, ["a", "b"], "left_anti")
    return connected_components(links.unionByName(verify(written(rest, "pairs"))))


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Two sets are linked at a Jaccard similarity of `percent` hundredths or more. Null, empty and blank texts have no
    shingle and no link, not even to each other; repeated rows get a row each; a null id is larger than any other;
    long texts are read whole; an empty table gives an empty result; other columns are not read. known: links (a, b) of
    doc_ids found before, which are taken as they are, best as stars (a: the centre of a class, b: any other member); a and
    b must each be the least doc_id of its text.
    """
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    read = written(read_sets(rows, shingle), "sets-read")
    often = read.where("token is not null").groupBy("token").agg(F.sum("times").alias("n")).where(F.col("n") >= OFTEN)
    often = often.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    order = Order([r["token"] for r in reversed(often)])
    signed = read.where("token is null").select("doc_id", "node", "n", "small", "bits")
    nodes = written(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "nodes")
    lists = written(shared_lists(list_entries(rows, order, shingle, percent)), "lists")
    sizes = {r["n"]: r["c"] for r in nodes.where(F.col("n") <= SMALL_SET).groupBy("n").agg(F.count("*").alias("c")).collect()}
    lengths = lists.groupBy("token").agg(F.count("*").alias("n_list"))
    scans = join_groups(lists.select("token", "n"), checkpointed(lengths), ["token"], "n_list").groupBy(F.least("n", F.lit(SMALL_SET + 1)).alias("n")).agg(F.sum("n_list").alias("c"))
    small = boundary(sizes, {r["n"]: r["c"] for r in scans.collect()}, percent)
    first = enumerated_pairs(nodes.where(F.col("n") <= small).select("node", "small"), small, percent)
    large = lists.where(F.col("n") >= int(least_size(small + 1, percent)))
    if known is not None:
        end = lambda c: nodes.select(F.col("rep").alias(c), F.col("node").alias(f"node_{c}"))
        known = known.join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    parts = linked_components(large, first, lambda pairs: verified(pairs, rows, nodes, shingle, percent), small, percent, known)
    placed = written(nodes.join(parts, "node", "left").select("node", "rep", "copies", "component"), "components")
    least = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = checkpointed(placed.join(least, "component", "left").select("node", "copies", F.coalesce("least", "rep").alias("component_id")))
    full = join_groups(signed.where("n > 0").select("doc_id", "node", "n"), named, ["node"], "copies").select("doc_id", "n", "component_id")
    both = full.unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return both.select(known("doc_id"), F.col("n").cast("long").alias("n_shingles"), known("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN generate_series(1, greatest(len(ws) - 4, 1))]) AS g FROM w WHERE len(ws) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a AS d, b AS r FROM lk UNION SELECT d, b FROM reach JOIN lk ON r = a),
low AS (SELECT d, min(r) AS r FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id
FROM w LEFT JOIN sz USING (doc_id) LEFT JOIN low ON d = doc_id
"""
