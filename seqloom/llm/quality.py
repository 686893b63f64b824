"""Quality of texts by Naive Bayes support vectors over n-grams of words and of the shapes of character runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import slices, utf8
from seqloom.plans.session import drop_table, write_table

#: Hashed features: n-grams of shapes in the lower half, n-grams of words in the upper one.
FEATURES = 1 << 16

#: Labelled rows of each class that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 2_000

#: Of these, one in CALIBRATE is kept from the fit, to turn margins into probabilities.
CALIBRATE = 4
PENALTY = 1.0
EPOCHS = 30
THRESHOLD = 0.7
HELD_OUT = 2

_SLICE = 256 << 10
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Shape of a byte: white space, line feed, small letter or part of a longer character, capital, digit, or the mark itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[:33] = 1
_SHAPE[10] = 2
_SHAPE[97:123] = 3
_SHAPE[128:] = 3
_SHAPE[65:91] = 4
_SHAPE[48:58] = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _bucket(mixed: np.ndarray, half: int) -> np.ndarray:
    return ((mixed * _MIX) >> np.uint64(49)).astype(np.int64) + half * (FEATURES // 2)


def _grams(tokens: np.ndarray, row: np.ndarray, longest: int, half: int, salt: int) -> Iterator[np.ndarray]:
    """row * FEATURES + feature of the n-grams of 1 to ``longest`` tokens that lie within a row."""
    mixed = np.full(len(tokens), salt, np.uint64)
    for n in range(1, longest + 1):
        keep = len(tokens) - n + 1
        if keep <= 0:
            return
        mixed = (mixed[:keep] ^ tokens[n - 1 :]) * _MIX
        mixed ^= mixed >> np.uint64(29)
        whole = row[:keep] == row[n - 1 :]
        yield row[:keep][whole] * FEATURES + _bucket(mixed[whole] + np.uint64(n), half)


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distinct features of the texts of a buffer, sorted, each as row * FEATURES + feature."""
    rows = len(starts) - 1
    part = data[starts[0] : starts[-1]]
    seen = np.zeros(rows * FEATURES, bool)
    if len(part):
        row = np.repeat(np.arange(rows), np.diff(starts))
        shape = _SHAPE[part]
        new_row = np.concatenate(([True], row[1:] != row[:-1]))
        change = new_row.copy()
        change[1:] |= shape[1:] != shape[:-1]
        at = np.flatnonzero(change)
        length = np.diff(np.concatenate((at, [len(part)])))
        token = shape[at].astype(np.uint64) * np.uint64(8) + np.minimum(np.int64(np.log2(length)), 5).astype(np.uint64)
        for cell in _grams(token, row[at], 4, 0, 1):
            seen[cell] = True
        inside = shape > 2
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | new_row[1:]
        first = np.flatnonzero(begin)
        if len(first):
            number = np.cumsum(begin) - 1
            place = np.minimum(np.arange(len(part)) - first[np.maximum(number, 0)], 63)
            value = np.where(inside, _FOLD[part].astype(np.uint64) * _POWERS[place], np.uint64(0))
            word = np.add.reduceat(value, first)
            of = row[first]
            for cell in _grams(word, of, 2, 1, 2):
                seen[cell] = True
            same = np.zeros(len(word), np.uint64)
            same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
            for cell in _grams(same, of, 3, 0, 3):
                seen[cell] = True
    return np.flatnonzero(seen)


def _by_slice(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..end, and the row and feature of each of their distinct features."""
    for begin, stop in slices(starts, _SLICE):
        for first in range(begin, stop, 128):
            end = min(first + 128, stop)
            cell = features(data, starts[first : end + 1])
            yield first, end, cell // FEATURES, cell % FEATURES


class Model:
    """Weights of the features, and the line that turns a margin into log odds; ``fitted`` unless it only repeats a share."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float, fitted: bool = True):
        self.weights, self.slope, self.offset, self.fitted = weights, slope, offset, fitted

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts) - 1)
        for first, end, row, feature in _by_slice(data, starts):
            size = np.bincount(row, minlength=end - first)
            margin = np.bincount(row, self.weights[feature], end - first) / np.sqrt(np.maximum(size, 1))
            out[first:end] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        return out


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a linear hinge-loss model, by descent along one dual variable after the other.

    Row i has the value ``values[f]`` for each of its features f, divided by the
    root of their number. A dual variable lies between 0 and its row's cost.
    """
    w = np.zeros(len(values))
    alpha = np.zeros(len(rows))
    scale = np.array([1 / math.sqrt(max(len(r), 1)) for r in rows])
    square = np.array([max(float((values[r] ** 2).sum()) * s * s, 1e-12) for r, s in zip(rows, scale, strict=True)])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = values[rows[i]] * scale[i]
            slope = y[i] * float(w[rows[i]] @ x) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, keep: np.ndarray, shares: tuple[float, float]) -> Model:
    """Fit on the rows where ``keep`` is false; use the others to calibrate to ``shares``, the classes' shares of all labels of the documents."""
    ratio = np.zeros(FEATURES)
    train = np.flatnonzero(~keep)
    ones = np.zeros((2, FEATURES))
    for i in train:
        ones[labels[i], rows[i]] += 1
    number = [int((labels[train] == c).sum()) for c in (0, 1)]
    seen = ones.sum(axis=0) > 0
    ratio[seen] = np.log((ones[1, seen] + 1) / (number[1] + 2)) - np.log((ones[0, seen] + 1) / (number[0] + 2))
    y = np.where(labels[train] == 1, 1.0, -1.0)
    cost = np.where(y > 0, PENALTY * len(train) / (2 * max(number[1], 1)), PENALTY * len(train) / (2 * max(number[0], 1)))
    weights = ratio * dual_descent([rows[i] for i in train], ratio, y, cost)
    rest = np.flatnonzero(keep) if len(set(labels[keep].tolist())) == 2 else np.arange(len(rows))
    margin = np.array([weights[rows[i]].sum() / math.sqrt(max(len(rows[i]), 1)) for i in rest])
    target = labels[rest].astype(float)
    weight = np.array([shares[c] / max((target == c).sum(), 1) for c in (0, 1)])[labels[rest]] * len(rest)
    slope, offset = _logistic(margin, target, weight)
    return Model(weights.astype(np.float32), slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, the slope lightly held back so that it is finite; Newton steps."""
    spread = max(float(x.std()), 1e-9)
    z = np.column_stack((x / spread, np.ones(len(x))))
    beta = np.zeros(2)
    hold = np.array([0.05, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + hold * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(hold), gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0) / spread, float(beta[1])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT mod 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit the model on a bounded sample of labelled rows, SAMPLE_PER_CLASS of each class.

    Only labels 0 and 1 of ids that are in ``docs`` and not held out count; an
    id with both is left out. The sample's ids are broadcast, so texts are read
    in one pass without a shuffle, and their features meet in one task of
    bounded size. Where a class has no rows, every score is the share of label 1
    among the labels of ``docs``, or 1/2 without any, and the model is not
    ``fitted``.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    usable = write_table(usable.join(ids, "id", "left_semi"), "quality-labels")
    sizes = dict(usable.groupBy("y").count().collect())
    total = sum(sizes.values())
    shares = (sizes.get(0, 0) / max(total, 1), sizes.get(1, 0) / max(total, 1))
    if min(shares) == 0:
        drop_table(usable)
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0 if not total else (30.0 if shares[1] == 1 else -30.0), fitted=False)
    chosen = []
    for y in (0, 1):
        chosen += usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS).collect()
    drop_table(usable)
    sample = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "id bigint, y int"))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None] * batch.num_rows
            for first, end, row, feature in _by_slice(*utf8(batch.column(1))):
                cut = np.searchsorted(row, np.arange(end - first + 1))
                out[first:end] = [feature[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["id", "features", "y"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts = {}, {}
        for batch in batches:
            for item in batch.to_pylist():
                if item["id"] not in texts or item["features"] < texts[item["id"]]:  # of unlike texts with one id the same stands in any order
                    texts[item["id"]] = item["features"]
                    rows[item["id"]] = (np.frombuffer(item["features"], "<u4"), item["y"])
        ids = sorted(rows)
        y = np.array([rows[i][1] for i in ids], np.int64)
        keep = np.zeros(len(ids), bool)
        for c in (0, 1):
            own = np.flatnonzero(y == c)
            keep[own[CALIBRATE - 1 :: CALIBRATE]] = True
        model = fit([rows[i][0] for i in ids], y, keep, shares)
        columns = [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.slope]), pa.array([model.offset])]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "slope", "offset"])

    encoded = source.join(sample, "id").select("id", "text", "y").mapInArrow(encode, "id bigint, features binary, y int")
    row = encoded.repartition(1).mapInArrow(solve, "weights binary, slope double, offset double").first()
    return Model(np.frombuffer(row.weights, "<f4").copy(), row.slope, row.offset)


def with_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text; null and empty texts have the score of a text without features. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id bigint, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*utf8(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
