"""Near-duplicates by word shingles: SimHash candidates in a Gray-order index, decided by the exact Jaccard similarity.

A document's signature is a SimHash of 512 bits over its distinct words: an edited word changes few of them, where it
changes many of a SimHash of shingles. Signatures are dealt by TABLES runs of KEY_BYTES bytes; documents that agree in
one run meet in its group, where the hierarchical Gray index finds those within NEAR_BITS bits. Each group sends on a
minimum spanning forest of what it found, the nearest first. Every such link is then held to the exact similarity of
the two shingle sets, and the links that pass give the classes.

A forest leaves out pairs that lie farther apart, and large groups are sliced. Where that may have lost a link, an exact
join decides: classes that a link of the forest failed to join, and classes that meet in a sliced group, go through the
Jaccard join of shingle sets. So of the candidates none is lost, whatever the forest or the slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwave.llm import shingle_join
from cohortwave.llm.base import ASCII_SPACE, Powers, WordScanner, checkpointed, chunks, join_groups, mix, ranged_hash, texts, written
from cohortwave.llm.components import connected_components
from cohortwave.llm.simhash import LARGE_GROUP, group_links

SHINGLE = 5
SIMILARITY = 0.8
SIGNATURE = 8
#: Runs of the signature that candidates must agree in, one of them; at a similarity of 0.8 over 0.98 of the pairs do.
TABLES, KEY_BYTES = 21, 3
#: Differing bits of 512 up to which a pair is a candidate; pairs at 0.8 differ in 29 on average, 45 at most, unrelated ones in over 150.
NEAR_BITS = 72
#: Quantiles by which large groups are sliced; groups of more than half as many times LARGE_GROUP members are dealt by hash first.
QUANTILES = 256
#: Comparisons with one set, above which its shingles are dealt to several tasks.
SPREAD = 256
#: Most keys and ids that are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_KEYS = 50_000
BROADCAST_IDS = 500_000
SEEDS = np.random.default_rng(20240607).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def signature(words: np.ndarray) -> np.ndarray:
    """512 bits, each the majority of that bit over the hashes of the distinct words."""
    votes = np.zeros(64 * SIGNATURE, np.int64)
    for at in range(0, len(words), 4096):
        bits = np.unpackbits(mix(words[at : at + 4096, None] ^ SEEDS).view(np.uint8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(words))


def shingle_hashes(words: np.ndarray, shingle: int, powers: Powers) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    first = np.arange(len(words) - width + 1)
    return np.unique(ranged_hash(words, first, first + width, powers))


def scanned(batch: pa.RecordBatch, scanner: WordScanner) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of a batch."""
    for lo, hi, data, offsets in chunks(batch.column("text")):
        at, _, _, h = scanner.scan(data, offsets)
        for i in range(hi - lo):
            yield lo + i, h[at[i] : at[i + 1]]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def signatures(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, same, sig): same is a digest of the set of shingles, sig the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = WordScanner(ASCII_SPACE, lower=True), Powers(0xD6E8FEB86659FD93)
        for batch in batches:
            same, sig = [], []
            for _, words in scanned(batch, scanner):
                same.append(digest(shingle_hashes(words, shingle, powers)))
                sig.append(signature(np.unique(words)).tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "row", "same", "sig"])

    return rows.mapInArrow(run, "doc_id long, row long, same binary, sig binary")


def shingle_sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(same, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, powers = WordScanner(ASCII_SPACE, lower=True), Powers(0xD6E8FEB86659FD93)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                at, _, _, h = scanner.scan(data, offsets)
                sets = [shingle_hashes(h[at[i] : at[i + 1]], shingle, powers).view(np.int64) for i in range(hi - lo)]
                yield pa.record_batch([pa.array(list(map(digest, sets)), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["same", "shingles"])

    return rows.mapInArrow(run, "same binary, shingles array<long>")


def gray_position(sig: Column, table: Column) -> Column:
    """Gray rank of the seven bytes behind a table's run: the order in which its large groups are sliced."""
    at = (table + 1) * KEY_BYTES % (8 * SIGNATURE - 7) + 1
    rank = F.conv(F.hex(F.substr(sig, at, F.lit(7))), 16, 10).cast("long")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def dealt_groups(classes: DataFrame, large: int = LARGE_GROUP) -> tuple[DataFrame, DataFrame | None]:
    """The groups of nodes of classes (node, sig) that agree in a run of bytes: node, sig, t, key, slice; and the members
    (node, t, key) of those that are sliced, None if there are none.

    A group of more than `large` members is sliced by quantiles of Gray order, twice and half a slice apart, so that
    neighbours always meet; of a group that the quantiles don't cut finely enough, parts by a hash of the node are sliced.
    """
    key = F.substr("sig", F.col("t") * KEY_BYTES + 1, F.lit(KEY_BYTES)).alias("key")
    dealt = classes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("t")).select("node", "sig", "t", key)
    sizes = checkpointed(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > large))
    n_large = sizes.count()
    if not n_large:
        return dealt.select("node", "sig", "t", "key", F.lit(0).alias("slice")), None
    large_keys = F.broadcast(sizes) if n_large <= BROADCAST_KEYS else sizes
    hot = dealt.join(large_keys, ["t", "key"]).withColumn("g", gray_position(F.col("sig"), F.col("t")))
    cuts = checkpointed(hot.groupBy("t", "key").agg(F.percentile_approx("g", [i / QUANTILES for i in range(1, QUANTILES)], 100 * QUANTILES).alias("cuts")))
    place = F.size(F.filter("cuts", lambda c: c < F.col("g")))
    parts = F.ceil(F.col("n") / (large * QUANTILES // 2))
    slices = F.least(F.ceil(F.col("n") / parts / large), F.lit(QUANTILES // 2))
    part = F.pmod(F.xxhash64("node"), parts) * 2 * QUANTILES
    both = F.array(F.floor(place * slices / QUANTILES) + part, F.floor(place * slices / QUANTILES + 0.5) + QUANTILES + part)
    sliced = hot.join(F.broadcast(cuts) if n_large <= BROADCAST_KEYS // QUANTILES else cuts, ["t", "key"]).select("node", "sig", "t", "key", F.explode(both.cast("array<int>")).alias("slice"))
    whole = dealt.join(large_keys, ["t", "key"], "left_anti").select("node", "sig", "t", "key", F.lit(0).alias("slice"))
    return whole.unionByName(sliced), checkpointed(hot.select("node", "t", "key"))


def spanning_candidates(groups: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """Links (a, b), a < b, that span the nodes within near_bits bits of each group."""

    def values(part: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, SIGNATURE)

    found = group_links(groups, ["t", "key", "slice"], values, "node", near_bits)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_links(classes: DataFrame, near_bits: int = NEAR_BITS, large: int = LARGE_GROUP) -> DataFrame:
    """Spanning links (a, b) of nodes of classes (node, sig) that agree in a run of bytes and are within near_bits bits."""
    return spanning_candidates(dealt_groups(classes, large)[0], near_bits)


def verified_links(rows: DataFrame, classes: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links whose shingle sets have at least that Jaccard similarity. rows: doc_id, row, text; classes: node, same, rep.

    The end of more links comes first and is dealt to several tasks; the other end has at most about the root of all links.
    """
    degrees = checkpointed(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
    nodes = checkpointed(degrees.select("node").join(classes, "node").select("node", "same", "rep"))
    ids = nodes.select(F.col("rep").alias("doc_id")).distinct()
    wanted = rows.join(F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = written(shingle_sets(wanted, shingle).join(nodes, "same").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    for end in ("a", "b"):
        links = join_groups(links, degrees.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), [end], f"n_{end}")
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    turned = links.select(F.when(F.col("n_a") >= F.col("n_b"), F.struct(F.col("a").alias("hub"), F.col("b").alias("end"), F.col("n_a").alias("n"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("end"), F.col("n_b").alias("n"))).alias("l"))
    dealt = turned.select("l.*").select("hub", "end", F.pmod(F.xxhash64("end"), parts).cast("int").alias("part"))
    left = degrees.join(sets, "node").select(F.col("node").alias("hub"), F.col("shingles").alias("left"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("node").alias("end"), F.col("shingles").alias("right")), "end").join(left, ["hub", "part"])
    shared = F.size(F.array_intersect("left", "right"))
    alike = shared >= similarity * (F.size("left") + F.size("right") - shared)
    return met.where(alike).select(F.least("hub", "end").alias("a"), F.greatest("hub", "end").alias("b"))


def in_question(classes: DataFrame, parts: DataFrame, candidates: DataFrame, cut: DataFrame | None) -> DataFrame:
    """The rows of classes whose class may have a link that was not tested.

    Two nodes that are candidates of a group, but in different classes, are joined by its forest, and on that way a link
    leaves the class of either one: it failed. Nodes of different slices are candidates of a group that holds several classes.
    """
    label = lambda c: F.coalesce("component", c).alias("label")
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    ends = candidates.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    open_labels = ends.where("x <> y").select(F.explode(F.array("x", "y")).alias("label"))
    if cut is not None:
        members = cut.join(parts, "node", "left").select("t", "key", label("node"))
        mixed = members.groupBy("t", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("t", "key")
        open_labels = open_labels.unionByName(members.join(mixed, ["t", "key"], "left_semi").select("label"))
    open_labels = checkpointed(open_labels.distinct())
    wanted = F.broadcast(open_labels) if open_labels.count() <= BROADCAST_IDS else open_labels
    labelled = classes.join(parts, "node", "left").select(*classes.columns, label("node"))
    return checkpointed(labelled.join(wanted, "label", "left_semi").drop("label"))


def joined_classes(rows: DataFrame, open_nodes: DataFrame, parts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that span all links between the open nodes (node, rep, row), by the exact join of their shingle sets.

    The classes found so far are handed on as stars, so that sets of one class aren't compared again.
    """
    ids = open_nodes.select("node", F.col("rep").alias("doc_id"), "row")
    read = rows.join(F.broadcast(ids) if open_nodes.count() <= BROADCAST_IDS else ids, ["doc_id", "row"])
    asked = written(read.select(F.col("node").alias("doc_id"), "text"), "in-question")
    known = parts.where("component <> node").join(open_nodes.select("node"), "node", "left_semi").select(F.col("component").alias("a"), F.col("node").alias("b"))
    found = shingle_join.joined(asked, shingle, round(100 * similarity), known=known)
    return found.where("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def similar_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE_GROUP) -> DataFrame:
    """One row per document: doc_id, row (a hash of its text), component_id. similarity: in whole hundredths."""
    rows = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    signed = written(signatures(rows, shingle), "signatures")
    classes = signed.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = checkpointed(classes.select("same", F.col("least.doc_id").alias("rep"), F.col("least.row").alias("row"), "sig", "n", F.monotonically_increasing_id().alias("node")))
    groups, cut = dealt_groups(classes.select("node", "sig"), large)
    candidates = checkpointed(spanning_candidates(groups))
    links = checkpointed(verified_links(rows, classes.select("node", "same", "rep"), candidates, shingle, similarity))
    parts = checkpointed(connected_components(links))
    open_nodes = in_question(classes.select("node", "rep", "row"), parts, candidates, cut)
    if not open_nodes.isEmpty():
        parts = connected_components(links.unionByName(joined_classes(rows, open_nodes, parts, shingle, similarity)))
    placed = checkpointed(classes.join(parts, "node", "left").select("same", "rep", "n", "component"))
    least = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = checkpointed(placed.join(least, "component", "left").select("same", "n", F.coalesce("least", "rep").alias("component_id")))
    return join_groups(signed.select("doc_id", "row", "same"), named, ["same"]).select("doc_id", "row", "component_id")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (the smallest id of its class of near-duplicates).

    Null, empty and blank texts are alike; texts of equal shingle sets are one node, so copies cost nothing; repeated
    rows get a row each; very long texts are read whole; an empty table gives an empty result; other columns are not read.
    """
    return similar_rows(docs, shingle, similarity, id_col, text_col).select("doc_id", "component_id")


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each class of near-duplicates does: that of the smallest id.

    Rows without an id come after all that have one, in an order of their texts' hashes; those of one text stay or go together.
    """
    row = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    nameless = row.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    number = F.coalesce(docs["doc_id"].cast("long"), nameless)
    found = checkpointed(similar_rows(docs.select(number.alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct())
    gone = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return docs.join(gone, (number == gone["_gone_id"]) & (row == gone["_gone_row"]), "left_anti")
