"""Power spectra of waveform rows: Arrow-fed numpy, many rows of equal length at once, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType


def stacked(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def welch(x: np.ndarray, fs: float, nperseg: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean one-sided density: periodic Hann window, mean removed per segment."""
    n = np.arange(nperseg)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / nperseg)
    starts = range(0, x.shape[1] - nperseg + 1, nperseg - overlap)
    total = np.zeros((x.shape[0], nperseg // 2 + 1))
    for s in starts:
        part = x[:, s : s + nperseg]
        part = (part - part.mean(axis=1, keepdims=True)) * window
        total += np.abs(np.fft.rfft(part, axis=1)) ** 2
    density = total / (len(starts) * fs * np.sum(window**2))
    density[:, 1 : -1 if nperseg % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), density


def band_area(freqs: np.ndarray, density: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Trapezoid over the bins from lo to hi, both ends included."""
    inside = (freqs >= lo) & (freqs <= hi)
    return np.trapezoid(density[:, inside], freqs[inside], axis=1)


def appended(df: DataFrame, samples: str, names: list[str], compute) -> DataFrame:
    """df without its samples, with double columns that compute(matrix) gives for a batch of equal-length rows.

    Rows whose array is NULL, empty or of another length than most share no batch with others: lengths are grouped.
    """
    keep = [c for c in df.columns if c != samples]
    schema = StructType([f for f in df.schema.fields if f.name != samples])
    for n in names:
        schema = schema.add(n, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(samples)
            size = np.asarray([len(v) if v is not None else 0 for v in column.to_pylist()]) if column.null_count else column.value_lengths().to_numpy()
            out = np.full((batch.num_rows, len(names)), np.nan)
            for length in np.unique(size[size > 1]):
                rows = np.flatnonzero(size == length)
                out[rows] = np.stack(compute(stacked(column.take(pa.array(rows)))), axis=1)
            yield pa.record_batch([*[batch.column(c) for c in keep], *[pa.array(out[:, i], from_pandas=True) for i in range(len(names))]], names=[*keep, *names])

    return df.select(*keep, samples).mapInArrow(run, schema)


def band_powers(epochs: DataFrame, fs: float, bands: dict[str, tuple[float, float]], samples: str = "samples") -> DataFrame:
    """One Welch segment per epoch; trapezoid power of every band."""

    def compute(x: np.ndarray) -> list[np.ndarray]:
        freqs, density = welch(x, fs, x.shape[1], 0)
        return [band_area(freqs, density, lo, hi) for lo, hi in bands.values()]

    return appended(epochs, samples, list(bands), compute)


def welch_features(epochs: DataFrame, fs: float, nperseg: int, overlap: int, bands: dict[str, tuple[float, float]], floor: float = 1e-20, samples: str = "samples") -> DataFrame:
    """log10 band powers of averaged segments."""

    def compute(x: np.ndarray) -> list[np.ndarray]:
        freqs, density = welch(x, fs, min(nperseg, x.shape[1]), min(overlap, x.shape[1] - 1))
        return [np.log10(np.maximum(band_area(freqs, density, lo, hi), floor)) for lo, hi in bands.values()]

    return appended(epochs, samples, list(bands), compute)


def band_entropy(epochs: DataFrame, fs: float, bands: dict[str, tuple[float, float]], samples: str = "samples") -> DataFrame:
    """Differential entropy of the band-passed signal; its sample variance comes from the masked spectrum (Parseval)."""

    def compute(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        freqs, power = np.fft.rfftfreq(n, 1 / fs), np.abs(np.fft.rfft(x, axis=1)) ** 2
        weight = np.full(len(freqs), 2.0)
        weight[0] = 0
        if n % 2 == 0:
            weight[-1] = 1
        out = []
        for lo, hi in bands.values():
            variance = (power * weight * ((freqs >= lo) & (freqs <= hi))).sum(axis=1) / (n * (n - 1))
            out.append(0.5 * np.log(2 * np.pi * np.e * np.maximum(variance, 1e-12)))
        return out

    return appended(epochs, samples, list(bands), compute)
