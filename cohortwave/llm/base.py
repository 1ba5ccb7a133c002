"""Shared helpers of the training-data operators: tables, checkpoints and vectorised word scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and \x09-\x0D.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: White space plus ASCII punctuation, for word features that ignore decoration.
SPACE_AND_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text counts as empty, other columns never get in the way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        asked = spark.conf.get("spark.checkpoint.dir", "")
        if not asked and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(asked or tempfile.mkdtemp(prefix="cohortwave-checkpoints-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation of text passes."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The same cut as a Parquet table: compressed, with pruned columns on each later read."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, and Spark's own setting: a task holds several batches at once, in Python and beside the JVM's heap.
BATCH_BYTES, BATCH_SETTING, SPARKS_OWN = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_BYTES from now on, unless the session names another size."""
    if spark.conf.get(BATCH_SETTING) == SPARKS_OWN:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


#: A key that holds more than this share of all rows is heavy. At most 1 / HEAVY keys can be, whatever the data.
HEAVY = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n", total: int | None = None) -> DataFrame:
    """Inner join of rows with groups: one row a key, `size` the number of rows that hold it, total their sum (None: asked for).

    Groups of heavy keys, 1 / HEAVY at most, are broadcast, so that the rows of one key never meet in one task; the rest is shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0 if total is None else total
    heavy = F.col(size) > total * HEAVY
    hot = F.broadcast(groups.where(heavy))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(~heavy), keys)
    return rows.join(hot, keys).unionByName(cold)


#: Parts in which arrays of all partitions are summed.
SLICES = 32


def summed(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sum of arrays (slice, data; see sliced) over all partitions, slice by slice; a task holds one array for each of its slices."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype).astype(np.float64)
                total[s] = total[s] + part if s in total else part
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["slice", "data"])

    return {r["slice"]: np.frombuffer(r["data"], np.float64) for r in parts.repartition("slice").mapInArrow(add, "slice int, data binary").collect()}


def sliced(array: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(array, SLICES)
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "data"])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 row offsets; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about most_bytes; a longer row comes alone and whole."""
    data, offsets = text_bytes(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        end = min(end, rows)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.size = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 16)
            both = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                p = np.full(self.size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            self.up, self.down = both
        return self.up, self.down


def ranged_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """Position-free polynomial hash of values[first:last] for every pair of bounds, in linear time."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[last] - total[first]) * down[first])


class WordScanner:
    """Words of many texts at once: maximal runs of bytes outside ``separators``, with 64-bit hashes.

    ``lower`` folds A-Z and, unless ``latin`` is false, the two-byte Latin capitals whose small letters differ by 0x20
    (U+00C0-U+00DE).
    """

    def __init__(self, separators: bytes, lower: bool = False, latin: bool = True) -> None:
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.lower = lower and latin
        self.code = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.code[65:91] = self.code[97:123]
        self.powers = Powers(0x9E3779B97F4A7C15)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word offsets per row, first byte, end byte, hash)."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64)
        inside = ~self.sep[data]
        opens, closes = np.ones(n, bool), np.ones(n, bool)
        np.logical_not(inside[:-1], out=opens[1:])
        np.logical_not(inside[1:], out=closes[:-1])
        opens[offsets[:-1][offsets[:-1] < n]] = True
        closes[offsets[1:][offsets[1:] > 0] - 1] = True
        first, last = np.flatnonzero(opens & inside), np.flatnonzero(closes & inside) + 1
        codes = self.code[data]
        if self.lower:
            capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
            codes[capital] = self.code[data[capital] + 0x20]
        return np.searchsorted(first, offsets), first, last, ranged_hash(codes, first, last, self.powers)
