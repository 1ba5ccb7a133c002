"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled documents train a linear classifier on the presence of selected words (each
weighs one over the fourth root of their number in a text, so that long texts don't run away) with the non-negative
risk estimator: prior x risk of positives + max(0, risk of the unlabelled as negatives - prior x risk of positives as
negatives). With the squared loss both risks are functions of the Gram matrix of the selected words' presence, so
Spark sums one such matrix over all positives and one over all documents, and numpy minimises the risk itself, not
that of a sample. The class prior is the share of toxic ones among the labelled. Last, a logistic curve, fitted to the
labelled documents' counts by margin, turns margins into probabilities.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from cohortwave.llm.base import SPACE_AND_PUNCTUATION, WordScanner, chunks, sliced, summed, table, texts, written

THRESHOLD = 0.3
#: Words are hashed to so many terms.
TERMS = 1 << 18
#: Terms that the classifier has weights for, at most: those whose document shares differ most surely.
SELECTED = 1024
LEAST_DOCS = 4
ROUNDS = 600
RATE = 0.02
DECAY = 2.5e-4
#: Cells by margin, from -REACH to REACH, in which labelled documents are counted for the curve.
CELLS, REACH = 1 << 13, 4.0
#: Most ids that are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


@dataclass
class Model:
    weights: np.ndarray  # by term
    selected: np.ndarray  # by term
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Weighted sum over the distinct selected terms of each of n rows, and the bias."""
        return np.bincount(row, self.weights[term] * shares(row, n), n) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return logistic(self.scale * margin + self.shift)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2


def presence(scan: WordScanner, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs of some texts; with `wanted`, of terms that it marks."""
    at, _, _, h = scan.scan(data, offsets)
    term = (h >> np.uint64(40)).astype(np.int64) & (TERMS - 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if wanted is not None:
        keep = wanted[term]
        row, term = row[keep], term[keep]
    both = np.unique(row * TERMS + term)
    return both // TERMS, both % TERMS


def shares(row: np.ndarray, n: int) -> np.ndarray:
    """What each (row, term) pair weighs, by the number of pairs of its row."""
    return np.bincount(row, minlength=n)[row] ** -0.25


def scanner() -> WordScanner:
    return WordScanner(SPACE_AND_PUNCTUATION, lower=True)


def totals(docs: DataFrame, add: Callable[[np.ndarray, WordScanner, np.ndarray, np.ndarray], None], size: int) -> np.ndarray:
    """Sum over all texts of what add(total, scanner, bytes, offsets) adds to an array of that size, and at the end their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = scanner(), np.zeros(size + 1)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                add(total[:size], scan, data, offsets)
                total[size] += hi - lo
        yield sliced(total)

    parts = summed(docs.select("text").mapInArrow(run, "slice int, data binary"), "f8")
    return np.concatenate([parts[s] for s in sorted(parts)]) if parts else np.zeros(size + 1)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many there are."""

    def add(total: np.ndarray, scan: WordScanner, data: np.ndarray, offsets: np.ndarray) -> None:
        total += np.bincount(presence(scan, data, offsets)[1], minlength=TERMS)

    found = totals(docs, add, TERMS)
    return found[:-1], int(found[-1])


def gram_matrix(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Mean over all documents of x x', x the weighed presence of the terms and a last 1."""
    k = len(terms) + 1
    upper = np.triu_indices(k)
    place, wanted = np.zeros(TERMS, np.int64), np.zeros(TERMS, bool)
    place[terms], wanted[terms] = np.arange(len(terms)), True

    def add(total: np.ndarray, scan: WordScanner, data: np.ndarray, offsets: np.ndarray) -> None:
        row, term = presence(scan, data, offsets, wanted)
        x = np.zeros((len(offsets) - 1, k), np.float32)
        x[:, -1] = 1
        x[row, place[term]] = shares(row, len(x))
        total += (x.T @ x)[upper]

    found = totals(docs, add, len(upper[0]))
    gram = np.zeros((k, k))
    gram[upper] = found[:-1] / max(1.0, found[-1])
    return np.triu(gram) + np.triu(gram, 1).T


def select_terms(p: np.ndarray, positives: int, u: np.ndarray, unlabelled: int, most: int = SELECTED) -> np.ndarray:
    """The terms whose document shares among positives and unlabelled differ most surely, in ascending order."""
    a, b = max(1, positives), max(1, unlabelled)
    share = (p + u + 1) / (a + b + 2)
    sure = np.abs(p / a - u / b) / np.sqrt(share * (1 - share + 1e-9) * (1 / a + 1 / b))
    sure[p + u < min(LEAST_DOCS, max(1, a // 8))] = 0
    # about the largest deviation that so many terms without any meaning would show
    level = max(3.0, float(np.sqrt(2 * np.log(max(2, np.count_nonzero(p + u))))) - 0.5)
    best = np.argsort(-sure, kind="stable")[:most]
    return np.sort(best[sure[best] > level])


def squared_risk(w: np.ndarray, gram: np.ndarray, label: int) -> tuple[float, np.ndarray]:
    """Mean of (w x - label)^2 / 4 over the documents of a Gram matrix, and its gradient."""
    gw, mean = gram @ w, gram[:, -1]
    return float(w @ gw - 2 * label * (w @ mean) + 1) / 4, (gw - label * mean) / 2


def pu_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the step's direction: below zero the negative part is led back instead of down."""
    up, up_gradient = squared_risk(w, positive, 1)
    (free, free_gradient), (back, back_gradient) = squared_risk(w, unlabelled, -1), squared_risk(w, positive, -1)
    negative, negative_gradient = free - prior * back, free_gradient - prior * back_gradient
    if negative >= 0:
        return prior * up + negative, prior * up_gradient + negative_gradient
    return prior * up, -negative_gradient


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, the bias last, by Adam on the non-negative risk with a little decay."""
    w = np.zeros(len(positive))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = pu_risk(w, positive, unlabelled, prior)[1]
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_curve(margin: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve, by Newton steps on smoothed labels; toxic, clean: documents at each margin."""
    n_toxic, n_clean = toxic.sum(), clean.sum()
    n = toxic + clean
    target = (toxic * (n_toxic + 1) / (n_toxic + 2) + clean / (n_clean + 2)) / np.maximum(n, 1)
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(200):
        p = logistic(a * margin + b)
        g = x @ (n * (p - target)) + np.asarray([1e-3 * (a - 1), 0])
        h = (x * (n * (p * (1 - p) + 1e-9))) @ x.T + np.asarray([[1e-3, 0], [0, 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - float(step[0]), b - float(step[1])
    return max(a, 1e-3), b


def with_margin(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with an added column of margins; all other columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, offsets in chunks(batch.column(at)):
                out.append(model.margin(*presence(scan, data, offsets, model.selected), hi - lo))
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def curve_of(margins: DataFrame, known: DataFrame, model: Model) -> Model:
    """The model with its curve, from the labelled documents' counts by cell of margin: at most 2 x CELLS rows, whatever the corpus."""
    cell = F.least(F.greatest(F.floor((F.col("margin") + REACH) / (2 * REACH) * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    toxic, clean = np.zeros(CELLS), np.zeros(CELLS)
    for r in margins.join(known, "doc_id").groupBy(cell.alias("cell"), "toxic").agg(F.count("*").alias("n")).collect():
        (toxic if r["toxic"] else clean)[r["cell"]] += r["n"]
    centre = (np.arange(CELLS) + 0.5) / CELLS * 2 * REACH - REACH
    there = toxic + clean > 0
    model.scale, model.shift = fit_curve(centre[there], toxic[there], clean[there])
    return model


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the margins (doc_id, margin) of all docs. docs: (doc_id, text). labels: (doc_id, toxic).

    Labels are read outside the held-out part only; as unlabelled ones, all documents count. Of repeated labels the largest counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    none = Model(np.zeros(TERMS), np.zeros(TERMS, bool), -1.0, 1.0, -3.0)
    toxic = int(total["toxic"] or 0)
    if not toxic:
        return none, docs.select("doc_id", F.lit(none.bias).alias("margin"))
    ids = known.where("toxic = 1").select("doc_id")
    positive = docs.join(F.broadcast(ids) if toxic <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    terms = select_terms(*document_counts(positive), *document_counts(docs))
    w = fit_pu(gram_matrix(positive, terms), gram_matrix(docs, terms), toxic / total["n"])
    model = Model(np.zeros(TERMS), np.zeros(TERMS, bool), float(w[-1]))
    model.weights[terms], model.selected[terms] = w[:-1], True
    margins = written(with_margin(docs, model, "margin").select("doc_id", "margin"), "margins")
    return curve_of(margins, known, model), margins


def score_of(margin: Column, model: Model) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(margin * model.scale + model.shift, F.lit(-30.0)), F.lit(30.0))))


def typed(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without known words; repeated rows get a row each; without any
    labelled toxic row every score is low; an empty table gives an empty result; other columns are not read.
    """
    model, margins = train(texts(docs, id_col, text_col), typed(labels))
    score = score_of(F.col("margin"), model)
    return margins.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with their columns, whatever these are called."""
    model, _ = train(texts(docs), typed(labels))
    margin = f"margin_{uuid.uuid4().hex}"
    return with_margin(docs, model, margin).where(score_of(F.col(margin), model) < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
