"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 6) of its lower-cased
form, hashed to buckets. From labelled texts come each bucket's log-count ratio
between the classes; buckets whose ratio or count is small are dropped; logistic
regression is then fitted on the presence of each bucket times its ratio.

Training uses a bounded sample (TRAIN_ROWS of each label; of texts above
TRAIN_CHARS so many characters, in windows over the whole text), on the driver. Scoring is one map over all rows with no shuffle:
whole texts, hashed in numpy for many documents at once, in parts of PART_CHARS
characters that overlap so that no n-gram is lost.

Defined results: null counts as empty; a text without any kept n-gram has the
score of the bias. Without labelled rows of both classes the score is the share
of label 1 (0 without any row). A null doc_id is in fold 0. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .labelled import fold, training_rows
from .tables import give_back, map_arrow, read

LENGTHS = (3, 4, 5, 6)
BUCKET_BITS = 22
TRAIN_ROWS = {0: 4000, 1: 2500}
TRAIN_CHARS = 20_000
#: Buckets are kept from this log-count ratio and number of training texts on.
LEAST_RATIO, LEAST_TEXTS = 1.5, 6
THRESHOLD = 0.3
PART_CHARS = 1 << 20
FOLDS, HELD_OUT = 4, 2


def _hashes(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each place) for each length."""
    state = chars * np.uint32(0x9E3779B1)
    for n in range(2, max(LENGTHS) + 1):
        if len(chars) < n:
            return
        state = state[: len(chars) - n + 1] ^ chars[n - 1 :]
        state = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA77)
        if n in LENGTHS:
            yield n, (state * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BUCKET_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of one text's n-grams."""
    found = [h for _, h in _hashes(_codes(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # kept buckets, ascending
    weights: np.ndarray  # regression weight times log-count ratio
    bias: float


def fit(rows: list[tuple[str, int]], steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    n = len(rows)
    y = np.array([label for _, label in rows], np.float64)
    ones = int(y.sum())
    nothing = np.zeros(0)
    if not 0 < ones < n:
        share = ones / (n + 1)
        return Model(nothing.astype(np.uint32), nothing, float(np.log(share / (1 - share))) if share else -30.0)
    counts = np.zeros((2, 1 << BUCKET_BITS), np.float32)
    for text, label in rows:
        counts[label, buckets(text)] += 1
    ratio = np.log((counts[1] + 1) / (ones + 2)) - np.log((counts[0] + 1) / (n - ones + 2))
    kept = np.flatnonzero((np.abs(ratio) >= LEAST_RATIO) & (counts.sum(0) >= LEAST_TEXTS)).astype(np.uint32)
    scale = ratio[kept].astype(np.float64)
    if not len(kept):
        return Model(kept, scale, float(np.log(ones / (n - ones))))
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    # hashed again rather than kept: of all buckets of the sample only a few are
    columns = [c[c >= 0] for c in (place[buckets(text)] for text, _ in rows)]
    del counts, ratio, place
    row = np.repeat(np.arange(n), [len(c) for c in columns])
    column = np.concatenate(columns)
    value = scale[column]
    w, bias, seen, seen_bias = np.zeros(len(kept)), 0.0, np.full(len(kept), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[column] * value, n), -30, 30)))
        error = (p - y) / n
        slope = np.bincount(column, error[row] * value, len(kept)) + decay * w
        seen += slope * slope
        w -= rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return Model(kept, w * scale, float(bias))


class Scorer:
    """Scores texts with a model; holds a table of all buckets, made once per worker and model."""

    def __init__(self, model: Model):
        self.model = model
        self.kept = np.zeros(1 << BUCKET_BITS, np.bool_)
        self.kept[model.features] = True

    def _present(self, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Distinct (document, bucket) pairs of the parts, as one integer each."""
        chars = np.concatenate([c for _, c in parts])
        ends = np.cumsum([len(c) for _, c in parts])
        owner = np.array([doc for doc, _ in parts], np.int64)
        found = [np.zeros(0, np.int64)]
        for n, h in _hashes(chars):
            at = np.flatnonzero(self.kept[h])
            part = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[part]
            found.append(owner[part[inside]] << BUCKET_BITS | h[at[inside]])
        return np.unique(np.concatenate(found))

    def __call__(self, texts: list[str]) -> np.ndarray:
        found, parts, size = [np.zeros(0, np.int64)], [], 0
        overlap = max(LENGTHS) - 1
        for doc, text in enumerate(texts):
            codes = _codes(text)
            for at in range(0, max(1, len(codes) - overlap), PART_CHARS):
                part = codes[at : at + PART_CHARS + overlap]
                parts.append((doc, part))
                size += len(part)
                if size >= PART_CHARS:
                    found.append(self._present(parts))
                    parts, size = [], 0
        if parts:
            found.append(self._present(parts))
        pairs = np.unique(np.concatenate(found))
        weight = self.model.weights[np.searchsorted(self.model.features, pairs & ((1 << BUCKET_BITS) - 1))] if len(pairs) else np.zeros(0)
        total = np.bincount(pairs >> BUCKET_BITS, weight, len(texts)) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, score_col: str = "score") -> DataFrame:
    """The kept columns (default: the id, as doc_id) and the score (double) of every row."""
    kept = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    rows = docs.select(*kept)
    names = rows.columns
    at = names.index(text_col) if text_col in names else len(names)
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                scores = scorer([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64())], [*names, score_col])

    return map_arrow(rows if text_col in names else docs.select(*kept, F.col(text_col).alias("_text")), score, schema)


def trained(docs: DataFrame, labels: DataFrame, usable: Column, target: str = "toxic", limits: dict[int, int] = TRAIN_ROWS) -> Model:
    model = fit(training_rows(docs, labels, target, usable, limits, TRAIN_CHARS))
    give_back()
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = trained(docs, read(spark, sf_dir, "labels"), ~held_out)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
