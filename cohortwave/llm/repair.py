"""Repair of conversation structure by cheapest edits, with Four-Russians block tables.

A conversation must read (s?(ua)+)? in the initials of its roles. A row is one of nine symbols; the cost of finishing
from each of four states is a vector, of which only differences matter, and few normalised vectors can occur. A table
tells for every vector and every block of BLOCK symbols the vector before the block and the cost that it adds, so a
conversation is processed backward by one lookup a block. The edits are read off forward: each block is expanded
backward from the vector behind it, and of the edits that keep to the least cost the first letter is taken.

Rows are put in order once, by range, and stored with their place. A conversation's rows in one stored partition are a
segment; a segment is summed up for every vector that may follow it, so a conversation of any length is cut into tasks
and its segments are chained by their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import table, written

#: Fixed values of the contract: costs of edits, and the white space that a text is judged without.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCK = 4
#: Symbols: 0 must be deleted; 1 + 2 * class + truncated; 9 is no row. Classes: user, assistant, system, other.
SYMBOLS, NONE = 10, 9
#: States: nothing yet, after the system row, after a user row, after an assistant row. What follows is a user row but after one.
FOLLOWING = (2, 2, 3, 2)
KEPT = ({0: 2, 1: 2, 3: 2}, {2: 3}, {0: 1}, {})
ROLES = {2: "user", 3: "assistant"}
Vector = tuple[int, ...]


def closed(v: list[int]) -> Vector:
    """Costs when rows may be inserted first; two insertions lead around."""
    for _ in range(3):
        v = [min(c, INSERT + v[FOLLOWING[s]]) for s, c in enumerate(v)]
    return tuple(v)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, in order of letters."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        if state in KEPT[kind]:
            out.append(("K", TRUNCATED * cut, KEPT[kind][state]))
        out.append(("R", REROLE + TRUNCATED * cut, FOLLOWING[state]))
    return out


def before(symbol: int, v: Vector) -> Vector:
    """Costs before a row, from the costs behind it."""
    return v if symbol == NONE else closed([min(c + v[t] for _, c, t in edits(symbol, s)) for s in range(4)])


#: Costs at the end of a conversation: nothing, or a finished pair of rows.
END = closed([0, 1 << 20, 1 << 20, 0])


class Tables:
    """vectors: the normalised cost vectors that can occur, END first; ahead, cost: by vector and block of symbols."""

    def __init__(self) -> None:
        self.vectors, known, at = [END], {END: 0}, 0
        one: list[list[tuple[int, int]]] = []
        while at < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                v = before(symbol, self.vectors[at])
                least = min(v)
                v = tuple(c - least for c in v)
                if v not in known:
                    known[v] = len(self.vectors)
                    self.vectors.append(v)
                row.append((known[v], least))
            one.append(row)
            at += 1
        step = np.asarray(one, np.int64)
        self.single = step
        self.ahead, self.cost = step[:, :, 0], step[:, :, 1]
        for _ in range(BLOCK - 1):  # a further symbol in front of the block
            self.cost = (self.cost[:, None, :] + step[self.ahead, :, 1].transpose(0, 2, 1)).reshape(len(step), -1)
            self.ahead = step[self.ahead, :, 0].transpose(0, 2, 1).reshape(len(step), -1)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: np.ndarray) -> np.ndarray:
    """Numbers of the blocks of a row of symbols; the last one is filled up."""
    padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NONE, np.int64)
    padded[: len(symbols)] = symbols
    return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector behind the symbols: the vector before them, and the cost added."""
    t = tables()
    at, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for b in blocks_of(symbols)[::-1].tolist():
        cost += t.cost[at, b]
        at = t.ahead[at, b]
    return at, cost


@lru_cache(1 << 18)
def expanded(block: int, behind: int, state: int) -> tuple[str, int]:
    """(letters, state behind) of the first cheapest edits of a block's rows, from the vector behind it."""
    t = tables()
    symbols = [block // SYMBOLS**i % SYMBOLS for i in range(BLOCK - 1, -1, -1)]
    costs = [t.vectors[behind]]
    for symbol in reversed(symbols):
        costs.insert(0, before(symbol, costs[0]))
    out = ""
    for i, symbol in enumerate(symbols):
        while symbol != NONE:
            options = edits(symbol, state)
            rest = costs[i][state]
            least = next((o for o in options if o[1] + costs[i + 1][o[2]] == rest), None)
            if INSERT + costs[i][FOLLOWING[state]] == rest and (least is None or least[0] > "I"):
                out, state = out + "I", FOLLOWING[state]
                continue
            out, state = out + least[0], least[2]
            break
    return out, state


def traced(symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int]:
    """Letters of a segment's edits from a state on, and the state behind it; the last segment may end in insertions."""
    t, blocks = tables(), blocks_of(symbols).tolist()
    vectors = [behind]
    for b in reversed(blocks):
        vectors.append(int(t.ahead[vectors[-1], b]))
    out = []
    for b, v in zip(blocks, vectors[-2::-1], strict=True):
        letters, state = expanded(b, v, state)
        out.append(letters)
    while last and END[state]:
        out.append("I")
        state = FOLLOWING[state]
    return "".join(out), state


# Spark


def named(conv_id: Column) -> Column:
    """A conversation's key; null is a conversation of its own."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the contract's damage: by the CRC-32 of conv_id:turn modulo 20, one in five rows suffers one of five faults."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation, turn (nulls first), role and text, stored with their place and their first fault."""
    kept = F.rtrim("text", F.lit(SPACE))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    keyed = rows.select(named(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marks = {
        "place": F.monotonically_increasing_id(),
        "kind": F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("u", 0), ("a", 1), ("s", 2)) for x in pair]), F.left("role", F.lit(1))), F.lit(3)),
        "blank": kept == "",
        "cut": ~F.right(kept, F.lit(1)).isin(".", "!", "?"),
        "digest": F.sha2(F.concat_ws(":", "role", "text"), 256),
    }
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(marks), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """Narrow rows with fault: 0 none, 1 blank, 2 duplicate of an earlier row, 3 truncated; and the symbol that edits see."""
    again = turns.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = turns.select("conv", "turn", "place", "kind", "blank", "cut", "digest").join(again, ["conv", "digest"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("place") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    rows = rows.select("conv", "turn", "place", F.shiftright("place", 33).alias("seg"), "kind", fault.alias("fault"))
    return rows.withColumn("symbol", F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * F.col("kind") + (F.col("fault") == 3).cast("int")))


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of neighbouring rows of equal keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, name in enumerate(names):
            if name != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, now = [], i, name
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def packed(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def streamed(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow with rows as tuples on the way out."""
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
    return df.mapInArrow(lambda batches: packed(work(batches), schema), ddl)


def segments(rows: DataFrame) -> DataFrame:
    """Each segment's symbols, its sums for every vector behind it, its illegal neighbours and the kinds at its ends."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        legal = np.zeros((4, 4), bool)
        legal[2, 0] = legal[0, 1] = legal[1, 0] = True
        for part in by_runs(batches, ["conv", "seg"]):
            symbols, kinds = part.column("symbol").to_numpy().astype(np.uint8), part.column("kind").to_numpy()
            at, cost = sums(symbols)
            yield part.column("conv")[0].as_py(), part.column("seg")[0].as_py(), part.column("place")[0].as_py(), symbols.tobytes(), at.astype(np.int16).tobytes(), cost.tobytes(), int((~legal[kinds[:-1], kinds[1:]]).sum()), int(kinds[0]), int(kinds[-1])

    dealt = rows.select("conv", "seg", "place", "symbol", "kind").repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    return streamed(dealt, sum_up, "conv string, seg long, place long, symbols binary, ahead binary, cost binary, illegal long, first int, last int")


def chained_back(parts: DataFrame) -> DataFrame:
    """Segments from a conversation's end on: the vector behind each, illegal neighbours with those across its end, and the whole cost at its first."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        vectors, waiting, behind, total = tables().vectors, None, 0, 0
        for batch in batches:
            for conv, seg, place, symbols, ahead, cost, illegal, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = waiting is None or waiting[0] != conv
                if ends:
                    if waiting:
                        yield (*waiting[:-1], True, total + vectors[behind][0])
                    behind, total = 0, 0
                else:
                    yield (*waiting[:-1], False, None)
                    illegal += (last, waiting[-1]) not in ((2, 0), (0, 1), (1, 0))
                waiting = (conv, seg, place, symbols, behind, illegal, ends, first)
                total += int(np.frombuffer(cost, np.int64)[behind])
                behind = int(np.frombuffer(ahead, np.int16)[behind])
        if waiting:
            yield (*waiting[:-1], True, total + vectors[behind][0])

    dealt = parts.repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    return streamed(dealt, chain, "conv string, seg long, place long, symbols binary, behind int, illegal long, ends boolean, begins boolean, cost long")


def audits(chain: DataFrame) -> DataFrame:
    """(conv, seg, place, audit): the letters of each segment's edits."""

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for conv, seg, place, symbols, behind, ends, begins in zip(*(batch.column(c).to_pylist() for c in ("conv", "seg", "place", "symbols", "behind", "ends", "begins")), strict=True):
                found = [traced(np.frombuffer(symbols, np.uint8), behind, s, ends) for s in range(1 if begins else 4)]
                yield conv, seg, place, [a for a, _ in found], [s for _, s in found]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state = None, 0
        for batch in batches:
            for conv, seg, place, letters, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, state = conv, state if conv == now else 0
                yield conv, seg, place, letters[state]
                state = states[state]

    by_state = streamed(chain, trace, "conv string, seg long, place long, letters array<string>, states array<int>")
    return streamed(by_state.repartition("conv").sortWithinPartitions("conv", "seg"), choose, "conv string, seg long, place long, audit string")


def repaired_rows(turns: DataFrame, letters: DataFrame) -> DataFrame:
    """(conv, role, text, edit) of the repaired conversations; the rows of one lie together in a partition, in order."""
    marked = letters.select("conv", "place", F.lit(0).alias("row"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = turns.select("conv", "place", F.lit(1).alias("row"), "role", "text").unionByName(marked)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state, left = None, 0, iter("")

        def rest() -> Iterator[tuple]:
            nonlocal state
            for _ in left:  # insertions behind the last row
                state = FOLLOWING[state]
                yield now, ROLES[state], "", "I"

        for batch in batches:
            for conv, row, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "row", "role", "text")), strict=True):
                if not row:
                    yield from rest()
                    now, state, left = conv, state if conv == now else 0, iter(text)
                    continue
                for letter in left:
                    if letter != "D":
                        state = KEPT["uas".find(role[:1])][state] if letter == "K" else FOLLOWING[state]
                        yield conv, role if letter == "K" else ROLES[state], "" if letter == "I" else text, letter
                    if letter != "I":
                        break
        yield from rest()

    return streamed(both.repartition("conv").sortWithinPartitions("conv", "place", "row"), merge, "conv string, role string, text string, edit string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per conversation, repaired rows) of (conv_id, turn, role, text).

    Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows: see repaired_rows.
    A null conv_id is a conversation of its own; a null role or text is one space; turns that are null come first,
    equal ones in order of role and text; repeated rows are duplicates of each other; an empty table gives empty
    results; other columns are not read.
    """
    turns = placed(conversations)
    rows = written(with_faults(turns), "faults")
    chain = written(chained_back(segments(rows)), "segments")
    letters = written(audits(chain), "audits")
    count = lambda fault: F.count_if(F.col("fault") == fault)
    faults = rows.groupBy("conv").agg(count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"))
    span = rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    costs = chain.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "")
    whole = letters.groupBy("conv").agg(joined.alias("audit"))
    return faults.join(span, "conv").join(costs, "conv").join(whole, "conv"), repaired_rows(turns, letters)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of rows that lie together in order: role:text, joined by newlines. One row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, digest = None, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != now:
                    if digest:
                        yield now, digest.hexdigest()
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            yield now, digest.hexdigest()

    return streamed(rows, run, "conv string, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """One row for each conv_id of the table, with what its repair after the damage counts, costs and gives."""
    stats, rows = repair(damage(conversations))
    ids = conversations.select("conv_id").distinct().withColumn("conv", named(F.col("conv_id")))
    found = ids.join(stats, "conv", "left").join(digests(rows), "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))
