"""Sources and sinks: delimited tables, trial files, nested unit JSON, waveform blobs, manifests and resumption."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructType

from cohortwave.functions.scalar import finite


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one where a local session names none."""
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        asked = spark.conf.get("spark.checkpoint.dir", "")
        if not asked and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(asked or tempfile.mkdtemp(prefix="cohortwave-checkpoints-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named}/{label}-{uuid.uuid4().hex}"


def read_table_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Delimited text with a header (a byte order mark before it is harmless); empty fields are NULL."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("nullValue", "").option("enforceSchema", True).option("quote", '"').option("escape", '"').csv(path)


def write_table_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """NaN, infinities and NULL become empty fields."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    df.withColumns({c: finite(F.col(c)) for c in numeric}).write.option("header", True).option("sep", sep).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def discover_files(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per file that matches: its path, size, and fields out of the path (groups of the pattern)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", "length")
    return files.where(F.col("path").rlike(pattern)).select("path", "length", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def harmonise_headers(df: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Canonical columns out of the first variant that is present, with the variant's name kept beside each."""
    there = set(df.columns)
    used = {v for names in variants.values() for v in names}
    out = [F.col(c) for c in df.columns if c not in used]
    for name, names in variants.items():
        present = [v for v in names if v in there]
        out.append((F.coalesce(*[F.col(v) for v in present]) if present else F.lit(None).cast("string")).alias(name))
        which = F.lit(None).cast("string")
        for v in reversed(present):
            which = F.when(F.col(v).isNotNull(), v).otherwise(which)
        out.append(which.alias(f"{name}_variant"))
    return df.select(*out)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Stack tables of different headers: the column set is the union, missing fields are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_units_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Nested unit documents, one per line or per file."""
    return spark.read.schema(schema).json(path)


def unit_windows(units: DataFrame, keys: list[str], rows: str = "window_rows") -> DataFrame:
    return units.select(*keys, F.inline(rows))


def decode_waveforms(blobs: DataFrame, keys: list[str], n_channels: int, n_times: int, content: str = "content") -> DataFrame:
    """Little-endian float32 blobs laid out (epoch, time, channel) as one row per epoch and channel.

    A blob whose size isn't a whole number of epochs gives one row with an error and no samples.
    """
    fields = [f for f in blobs.schema.fields if f.name in keys]
    schema = StructType([*fields]).add("epoch", IntegerType()).add("channel", IntegerType()).add("samples", ArrayType(FloatType())).add("error", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, epoch, channel, samples, error = [], [], [], [], []
            for i, raw in enumerate(batch.column(content).to_pylist()):
                if raw is None or len(raw) % (4 * n_channels * n_times) or not raw:
                    source.append(i)
                    epoch.append(None)
                    channel.append(None)
                    samples.append(None)
                    error.append(f"{0 if raw is None else len(raw)} bytes")
                    continue
                cube = np.frombuffer(raw, "<f4").reshape(-1, n_times, n_channels).transpose(0, 2, 1)
                for e in range(cube.shape[0]):
                    for c in range(n_channels):
                        source.append(i)
                        epoch.append(e)
                        channel.append(c)
                        samples.append(cube[e, c])
                        error.append(None)
            at = pa.array(source, pa.int64())
            kept = [batch.column(k).take(at) for k in [f.name for f in fields]]
            yield pa.record_batch([*kept, pa.array(epoch, pa.int32()), pa.array(channel, pa.int32()), pa.array(samples, pa.list_(pa.float32())), pa.array(error, pa.string())], names=[*[f.name for f in fields], "epoch", "channel", "samples", "error"])

    return blobs.select(*[f.name for f in fields], content).mapInArrow(run, schema)


def read_waveform_binary(spark: SparkSession, path: str, n_channels: int, n_times: int) -> DataFrame:
    return decode_waveforms(spark.read.format("binaryFile").load(path).select("path", "content"), ["path"], n_channels, n_times)


def fingerprint_mismatches(rows: DataFrame, expected: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose SHA-256 differs from the manifest's (key, sha256), or that either side lacks."""
    found = rows.select(key, F.sha2(content, 256).alias("found"))
    j = found.join(expected, key, "full")
    return j.where(~F.col("found").eqNullSafe(F.col("sha256"))).select(key, F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").otherwise("differs").alias("problem"))


def pending_units(plan: DataFrame, done: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Planned units without a complete result; a result that lacks a required field doesn't count."""
    complete = done.dropna(subset=required) if required else done
    return plan.join(complete.select(*keys).distinct(), keys, "left_anti")
