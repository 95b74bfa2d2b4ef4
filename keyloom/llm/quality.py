"""Quality: a byte-level convolutional network in numpy over the whole document.

Learned filters of four bytes respond at every place of a text. Their largest
responses in each chunk (overlapping by half, covering the text to its end) make
the chunk's vector; a document's vector has the largest and the mean of its
chunks' rectified vectors, and a logistic unit combines that into one probability.

The first layer is a table of responses by byte and filter, so a response is a
sum of four lookups; for scoring, tables of byte pairs halve the lookups.

Training is backpropagation with Adam on the driver, on a bounded sample
(TRAIN_ROWS of each label; of texts above TRAIN_CHARS so many characters, in windows
over the whole text; and SPANS short spans of good texts, so that shortness alone counts
for nothing). Scoring is one map over
all rows with no shuffle; memory is bounded by parts of PART_BYTES.

Defined results: null counts as empty, which is scored as padding only. Without
labelled rows of both classes the score is the share of label 1 (0.5 without any
row). A null doc_id is in fold 0. Extra columns are ignored.
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

WIDTH, FILTERS, BLOCK = 4, 16, 256  # a chunk is two neighbouring blocks of places
TRAIN_ROWS = {0: 1500, 1: 2500}
TRAIN_CHARS, SPANS = 8000, 300
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
PART_BYTES = 1 << 19  # a multiple of BLOCK


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    offset: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): of the largest, then of the means
    bias: float
    flat: float | None = None  # the score of every text, where there was nothing to learn from


def _padded(text: str) -> bytes:
    return text.encode("utf-8", "replace") + b"\0" * WIDTH


def _places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the first place of each block and the one after its last, and the blocks of each text."""
    places = np.array([len(t) - WIDTH + 1 for t in texts])
    counts = -(-places // BLOCK)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(begin, counts) + within * BLOCK
    stop = np.minimum(start + BLOCK, np.repeat(begin + places, counts))
    return np.frombuffer(b"".join(texts), np.uint8), start, stop, counts


def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, second block, first chunk of each text): a text of one block is one chunk."""
    last = np.cumsum(counts) - 1
    first = np.ones(counts.sum(), bool)
    first[last[counts > 1]] = False
    left = np.flatnonzero(first)
    single = np.zeros(counts.sum(), bool)
    single[last[counts == 1]] = True
    chunks = np.maximum(counts - 1, 1)
    return left, np.where(single[left], left, left + 1), np.cumsum(chunks) - chunks


def _vectors(hidden: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(start, len(hidden)))[:, None]
    return np.concatenate([np.maximum.reduceat(hidden, start), np.add.reduceat(hidden, start) / sizes], axis=1), sizes


def _loss_and_slopes(model: Model, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    data, start, stop, counts = _places(texts)
    n = len(data) - WIDTH + 1
    response = sum(model.table[k][data[k : k + n]] for k in range(WIDTH))
    top = np.empty((len(start), FILTERS), np.int64)
    for i, (a, b) in enumerate(zip(start, stop, strict=True)):
        top[i] = a + response[a:b].argmax(0)
    lanes = np.arange(FILTERS)
    peak = response[top, lanes]
    left, right, first = _chunks(counts)
    from_left = peak[left] >= peak[right]
    place = np.where(from_left, top[left], top[right])
    hidden = np.maximum(np.where(from_left, peak[left], peak[right]) + model.offset, 0)
    vectors, sizes = _vectors(hidden, first)
    p = 1 / (1 + np.exp(-(vectors @ model.weights + model.bias)))
    error = ((p - y) * weight / len(y)).astype(np.float32)
    own = np.repeat(np.arange(len(y)), sizes[:, 0])
    back = (error[:, None] * model.weights[FILTERS:] / sizes)[own]
    back = back + np.where(hidden == vectors[own, :FILTERS], (error[:, None] * model.weights[:FILTERS])[own], 0)
    back = back * (hidden > 0)
    slope = np.empty_like(model.table)
    for k in range(WIDTH):
        slope[k] = np.bincount((data[place + k].astype(np.int64) * FILTERS + lanes).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [slope, back.sum(0), vectors.T @ error, np.array(error.sum())]


def fit(rows: list[tuple[str, int]], epochs: int = 8, least_steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in rows], np.float32)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    if not 0 < y.sum() < len(y):
        model.flat = float(y.mean()) if len(y) else 0.5
        return model
    texts = [_padded(text) for text, _ in rows]
    good = [text for text, label in rows if label and len(text) > 200]
    for text in good[:SPANS]:
        at = int(rng.integers(0, len(text) - 120))
        texts.append(_padded(text[at : at + int(rng.integers(15, 120))]))
    y = np.append(y, np.ones(len(texts) - len(y), np.float32))
    weight = np.where(y == 1, 1.0, 1.5).astype(np.float32)
    bias = np.zeros((), np.float32)
    values = [model.table, model.offset, model.weights, bias]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            drawn = order[at : at + batch]
            step += 1
            model.bias = float(bias)
            for value, mean, square, slope in zip(values, means, squares, _loss_and_slopes(model, [texts[i] for i in drawn], y[drawn], weight[drawn]), strict=True):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                value -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    model.bias = float(bias)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        t = model.table
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def _peaks(self, texts: list[bytes]) -> np.ndarray:
        """The largest response of each filter in each block."""
        data, start, stop, _ = _places(texts)
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        n = len(data) - WIDTH + 1
        response = np.take(self.pairs[0], two[:n], axis=0)
        for k, table in enumerate(self.pairs[1:], 1):
            response += np.take(table, two[2 * k : 2 * k + n], axis=0)
        # places whose bytes reach into the next text lie between a stop and the next start
        bounds = np.unique(np.concatenate([start, stop[stop < n]]))
        return np.maximum.reduceat(response, bounds)[np.searchsorted(bounds, start)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts or self.model.flat is not None:
            return np.full(len(texts), self.model.flat if texts else 0.0)
        peaks, counts, parts, size = [], [], [], 0
        for text in texts:
            data = _padded(text)
            places = len(data) - WIDTH + 1
            counts.append(-(-places // BLOCK))
            for at in range(0, places, PART_BYTES):
                part = data[at : at + PART_BYTES + WIDTH - 1]
                parts.append(part)
                size += len(part)
                if size >= PART_BYTES:
                    peaks.append(self._peaks(parts))
                    parts, size = [], 0
        if parts:
            peaks.append(self._peaks(parts))
        peak = np.concatenate(peaks)
        left, right, first = _chunks(np.array(counts))
        hidden = np.maximum(np.maximum(peak[left], peak[right]) + self.model.offset, 0)
        total = _vectors(hidden, first)[0].astype(np.float64) @ self.model.weights + self.model.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, score_col: str = "score") -> DataFrame:
    """The kept columns (default: the id, as doc_id) and the score (double) of every row."""
    kept = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    rows = docs.select(*kept)
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                scores = scorer([t or "" for t in part.column(len(names)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64())], [*names, score_col])

    return map_arrow(docs.select(*kept, F.col(text_col).alias("_text")), score, schema)


def trained(docs: DataFrame, labels: DataFrame, usable: Column, target: str = "quality", limits: dict[int, int] = TRAIN_ROWS) -> Model:
    model = fit(training_rows(docs, labels, target, usable, limits, TRAIN_CHARS))
    give_back()
    return model


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = trained(docs, read(spark, sf_dir, "labels"), ~held_out)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
