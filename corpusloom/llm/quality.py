"""Quality classifier: ordinal cumulative-link regression on hashed text features.

One weight vector scores a text, and ordered thresholds turn the score into ``P(grade > k) = sigmoid(score - threshold_k)``
for every k: the expected grade is their sum, and each is a tail probability for selection.  Grades come from ``labels``:
0 low quality, 1 good but toxic, 2 good.  The fit uses at most ``TRAINING_ROWS`` labelled rows, those with the smallest hashed ids;
their bounded feature vectors are the only thing that reaches the driver.  Scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 8192
TRAINING_ROWS = 6000
KEEP_FROM = 0.5
_CACHE_WORDS = 300_000


def _shape(word: str) -> str:
    """Runs of upper case, lower case, digits and each other character, one sign a run."""
    signs = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:64])
    return "".join(sign for sign, _ in groupby(signs))[:8]


class _Words(dict):
    """word -> word code << 13 | shape slot."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        shape = xxhash.xxh64_intdigest("shape " + _shape(word)) % SLOTS
        code = (xxhash.xxh64_intdigest(word.lower()) >> 16) * SLOTS + shape
        self[word] = code
        return code


_WORDS = _Words()
_REPEAT = np.int64(xxhash.xxh64_intdigest("repeat") % SLOTS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text: its words, word shapes, shape pairs and word repetitions, log counts of unit length."""
    found = (text or "").split()
    codes = np.fromiter(map(_WORDS.__getitem__, found), np.int64, len(found))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    shapes, own = codes % SLOTS, codes // SLOTS
    pairs = (shapes[1:] * 31 + shapes[:-1] * 17 + 5) % SLOTS
    again = np.full(int((own[1:] == own[:-1]).sum()), _REPEAT)
    counts = np.bincount(np.concatenate([own % SLOTS, shapes, pairs, again]), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    values = np.log1p(counts[slots])
    return slots.astype(np.int32), (values / np.sqrt((values**2).sum())).astype(np.float32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, steps: int = 200, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by full-batch Adam.

    The gaps between thresholds are exponentials, so they stay ordered.  Without rows, or where all grades agree, the
    thresholds are so low that every text passes.
    """
    weights, top = np.zeros(SLOTS), 2
    if len(np.unique(grades)) < 2:
        return OrdinalModel(weights, np.array([-30.0, -30.0]))
    sizes = np.array([len(x) for x in slots])
    row = np.repeat(np.arange(len(sizes)), sizes)
    column, value = np.concatenate(slots), np.concatenate(values).astype(float)
    raw = np.array([-1.0, 0.0])  # first threshold, log gap
    moments = [np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(2), np.zeros(2)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        thresholds = np.array([raw[0], raw[0] + np.exp(raw[1])])
        scores = np.bincount(row, value * weights[column], minlength=len(sizes))
        # P(grade) = S(high - score) - S(low - score), with infinite outer thresholds
        high = np.where(grades == top, 60.0, thresholds[np.minimum(grades, top - 1)] - scores)
        low = np.where(grades == 0, -60.0, thresholds[np.maximum(grades - 1, 0)] - scores)
        up, down = sigmoid(high), sigmoid(low)
        mass = np.maximum(up - down, 1e-9)
        slope_up, slope_down = up * (1 - up) / mass, down * (1 - down) / mass
        d_score = (slope_up - slope_down) / len(grades)
        grad = np.bincount(column, value * d_score[row], minlength=SLOTS) + l2 * weights
        d_threshold = np.array([
            -(slope_up * (grades == k)).sum() + (slope_down * (grades == k + 1)).sum() for k in range(top)
        ]) / len(grades)
        grad_raw = np.array([d_threshold.sum(), d_threshold[1] * np.exp(raw[1])])
        for x, g, m, v, rate in ((weights, grad, moments[0], moments[1], 0.3), (raw, grad_raw, moments[2], moments[3], 0.1)):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(weights, np.array([raw[0], raw[0] + np.exp(raw[1])]))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([y for _, y in made], pa.list_(pa.float32()))],
            names=["grade", "slots", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on a bounded sample of labelled rows; rows with a null id or quality are no labels, a null toxic counts as 0.

    A label is one training row: of documents that repeat its id the smallest text counts, null texts last.  No other column is read.
    """
    graded = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").alias("labelled"), F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade")
    )
    sample = graded.orderBy(F.xxhash64("labelled"), "labelled", "grade").limit(rows)
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text"))
    vectors = (
        texts.join(F.broadcast(sample), "labelled").groupBy("labelled", "grade").agg(F.min("text").alias("text"))
        .select("grade", "text")
        .mapInArrow(_vectors, "grade int, slots array<int>, values array<float>")
    )
    got = vectors.toArrow()
    slots = [np.asarray(x.values, np.int32) for x in got["slots"]]
    values = [np.asarray(x.values, np.float32) for x in got["values"]]
    return fit(slots, values, np.asarray(got["grade"]))


def _scores(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                slots, values = features(text.as_py())
                scores[i] = model.weights[slots] @ values
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])],
                names=[*batch.schema.names[:-1], "expected_grade", "p_good", "p_best"],
            )

    return run


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per input row: (id, expected_grade, p_good, p_best, kept).

    ``p_good`` is the tail probability of a grade above 0; rows from ``keep_from`` on are kept.  Null and empty texts have the
    score 0 and are graded by the thresholds alone.  Null ids and repeated rows are graded like any other; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scores(model), f"id {kind}, expected_grade double, p_good double, p_best double"
    )
    return scored.select(F.col("id").alias(id_col), "expected_grade", "p_good", "p_best", (F.col("p_good") >= keep_from).alias("kept"))


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one pass without a shuffle.

    Each row is decided by its own text, so repeated rows all stay or all go; null and empty texts are graded by the thresholds alone, and an
    empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.names.index(text_col) if at is None else at
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                slots, values = features(text.as_py())
                scores[i] = model.weights[slots] @ values
            yield batch.filter(pa.array(model.tails(scores)[:, 0] >= keep_from))

    return docs.mapInArrow(run, docs.schema)
