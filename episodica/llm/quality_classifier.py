"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed words.

One weight vector over hash slots gives a text's worth; ordered thresholds cut it into grades, so that
P(grade <= k) = logistic(threshold_k - worth).  The expected grade ranks texts and the tail probability of the top
grade selects them.  The rating of a labelled text is its quality plus one if it is not toxic: 0, 1 or 2.

Weights have a price, by which slots that tell little get none, however often they occur.

The model is fitted in numpy on a bounded sample of labelled texts (``LABELLED``, chosen by a hash of the id, whose ids
alone are broadcast) and applied to every whole text.

Defined cases: a null text, or one without words, has expected grade 0 and tail 0; null ids are scored and never learned
from; repeated labels of an id count by their lowest rating; without labelled texts every expected grade is the middle
one and no text is kept; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_or_empty, words

SLOTS = 1 << 18
#: Labelled texts that are learned from, at most.
LABELLED = 12_000
GRADES = 3
ROUNDS = 400
#: Price of a unit of weight with LABELLED texts, by whose root it falls with their number; it leaves most slots at 0.
LASSO = 2e-4
#: Marks taken off words.
PUNCTUATION = ".,!?;:\"'()"
#: Tail probability of the top grade from which a text is kept: chosen on held-out labels, of which it loses some 5
#: percent of the top grade.
KEEP = 0.65


def _features(texts: DataFrame, text: str, name: str) -> DataFrame:
    """``texts`` with the array of distinct slots of its lower-case words, as they stand and without punctuation."""
    lower = F.lower(text_or_empty(text))
    bare = lower
    for mark in PUNCTUATION:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return texts.withColumn(name, F.array_distinct(F.transform(F.concat(words(lower), words(bare)), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))))


class OrdinalModel:
    """Weights over slots and ascending thresholds."""

    def __init__(self):
        self.weights = np.zeros(SLOTS)
        self.thresholds = np.linspace(-1, 1, GRADES - 1)

    def worth(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's slots."""
        out = np.zeros(len(sizes))
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.weights[flat], starts)
        return out

    def fit(self, flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray) -> OrdinalModel:
        """Accelerated proximal gradient on the mean negative log-likelihood and a price times the weights' absolute sum."""
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        price = LASSO * np.sqrt(LABELLED / n)
        # A text moves a slot's weight by at most 1 / n, so slots of too few texts to meet the price stay at 0.
        some = np.bincount(flat, minlength=SLOTS)[flat] > price * n
        flat, owner = flat[some], owner[some]
        sizes = np.bincount(owner, minlength=n)
        # The second derivative by worth is at most 1/2, and a text of k slots shares it among them.
        step = 2 * n / np.maximum(np.bincount(flat, sizes[owner], SLOTS), 1)
        weights, ahead, pace = self.weights, self.weights, 1.0
        cut, cut_squares = np.append(-1.0, np.log(np.full(GRADES - 2, 2.0))), np.full(GRADES - 1, 1e-2)
        for _ in range(ROUNDS):
            f = np.bincount(owner, ahead[flat], n)
            theta = np.concatenate([[-np.inf], np.cumsum(np.append(cut[0], np.exp(cut[1:]))), [np.inf]])
            up, low = (_logistic(theta[grades + k] - f) for k in (1, 0))
            p = np.maximum(up - low, 1e-9)
            moved = ahead - step * np.bincount(flat, ((1 - up - low) / n)[owner], SLOTS)
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * price, 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            weights, ahead, pace = new, new + (pace - 1) / faster * (new - weights), faster
            by_theta = np.bincount(grades + 1, -up * (1 - up) / p / n, GRADES + 1) + np.bincount(grades, low * (1 - low) / p / n, GRADES + 1)
            tail = np.cumsum(by_theta[1:-1][::-1])[::-1]
            dc = np.append(tail[0], tail[1:] * np.exp(cut[1:]))
            cut_squares += dc * dc
            cut = cut - 0.1 * dc / np.sqrt(cut_squares)
        self.weights, self.thresholds = weights, np.cumsum(np.append(cut[0], np.exp(cut[1:])))
        return self

    def grade(self, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the top grade."""
        above = 1 - _logistic(self.thresholds[None, :] - worth[:, None])
        return above.sum(axis=1), above[:, -1]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel | None:
    """A model fitted on at most LABELLED labelled texts; None if there are none."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("rated_id")).agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(LABELLED)
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("rated_id")).select("grade", "text")
    # A text's features are bounded by SLOTS, the text is not.
    features = _features(joined, "text", "slots").select("grade", "slots", F.xxhash64("text").alias("luck"))
    drawn = features.orderBy("luck", "grade").limit(2 * LABELLED).select("grade", "slots").toArrow().combine_chunks()
    if not drawn.num_rows:
        return None
    column = pa.concat_arrays(drawn.column("slots").chunks)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return OrdinalModel().fit(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, np.clip(drawn.column("grade").to_numpy(), 0, GRADES - 1).astype(np.int64))


def classify(docs: DataFrame, model: OrdinalModel | None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """All columns of ``docs`` with ``expected_grade``, ``tail`` and ``kept`` (a clash gets underscores)."""
    names = fresh(docs, "slots", "expected_grade", "tail", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType()), T.StructField(names[3], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            if own is None:
                grade, tail = np.full(len(sizes), (GRADES - 1) / 2), np.zeros(len(sizes))
            else:
                grade, tail = own.grade(own.worth(column.flatten().to_numpy(zero_copy_only=False), sizes))
            grade, tail = np.where(sizes > 0, grade, 0.0), np.where(sizes > 0, tail, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grade), pa.array(tail), pa.array((sizes > 0) & (tail >= keep))], names=[f.name for f in schema.fields])

    return _features(docs, text, names[0]).select(*docs.columns, names[0]).mapInArrow(run, schema)
