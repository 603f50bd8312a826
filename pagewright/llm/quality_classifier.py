"""A quality classifier: naive Bayes support vectors.

Texts become indicators of hashed n-grams.  Each indicator is scaled by the log
ratio of its share in either class, and a linear model with hinge loss is fitted
to the scaled indicators by dual coordinate descent.  The margin becomes a
probability by a logistic curve fitted on rows that the model has not seen.
The fit sees a bounded sample of labelled rows; the scores cover every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.llm.arrow import byte_texts, pieces
from pagewright.plans.session import cut_lineage, table

NAME = "op2_quality_classifier"
ORACLE_SQL = None

#: Labelled rows that a model is fitted to, at most: those with the smallest hash of their id, as long as their
#: indicators have so many bytes at most (of a row some four for each distinct n-gram, and a megabyte at most).
MOST_TRAINING_ROWS, MOST_TRAINING_BYTES = 8_000, 96 << 20
#: Indicators are hashed to so many bits; the first few places stand for shares of repeated n-grams.
BITS = 18
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
#: Smoothing of counts, bound of a dual variable, passes over the rows.
SMOOTHING, COST, PASSES = 1.0, 1.0, 12
THRESHOLD = 0.3

_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


class Indicators:
    """Indices of the n-grams of a text: one to four bytes, and steps of the share of repeated words."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        gram = np.zeros(len(data), np.uint32)
        for n in range(1, 5):
            if len(data) < n:
                break
            gram = (gram[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
            self.seen[((gram + np.uint32(n)) * _ODD[n - 1]) >> np.uint32(32 - BITS)] = True
        words = text.split()
        self.seen[: 2 * len(SHARES)] = False
        if len(words) > 2:
            again = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (len(words) - 2)
            same = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
            for i, share in enumerate(SHARES):
                self.seen[i], self.seen[len(SHARES) + i] = again >= share, same >= share
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Per indicator, the log of its share of all indicators in good rows over that in bad rows."""
    counts = []
    for wanted in (True, False):
        chosen = [r for r, g in zip(rows, good, strict=True) if g == wanted]
        counts.append(SMOOTHING + np.bincount(np.concatenate(chosen) if chosen else np.zeros(0, np.int32), minlength=1 << BITS))
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, good: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on rows of unit length; a constant 1 gives the bias."""
    values = [scale[r].astype(np.float32) for r in rows]
    values = [v / np.float32(math.sqrt(float(v @ v)) or 1.0) for v in values]
    sign = np.where(good, 1.0, -1.0)
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(len(scale)), 0.0
    size = [float((v * v).sum()) + 1.0 for v in values]
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = sign[i] * (weights[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / size[i], 0.0), COST)
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of a margin, by Newton steps with smoothed targets."""
    n = int(good.sum())
    target = np.where(good, (n + 1) / (n + 2), 1 / (len(good) - n + 2))
    a, b = 1.0, math.log((n + 1) / (len(good) - n + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * margins).sum(), (p - target).sum()])
        hess = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Scores indicators."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.scale, self.weights, self.bias, self.slope, self.offset = scale, weights, bias, slope, offset

    def margin(self, row: np.ndarray) -> float:
        v = self.scale[row].astype(float)
        return float(self.weights[row] @ v) / (math.sqrt(float(v @ v)) or 1.0) + self.bias

    def score(self, row: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(row) + self.offset, -30), 30)))


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """A model of ``rows``; every fifth row is held back for the logistic curve."""
    scale = log_count_ratios(rows, good)
    n = int(good.sum())
    if n in (0, len(good)):
        return Model(scale, np.zeros(len(scale)), 0.0, 0.0, math.log((n + 1) / (len(good) - n + 1)))
    back = np.arange(len(rows)) % 5 == 0
    if len(set(good[back])) < 2 or len(set(good[~back])) < 2:
        back[:] = False
    own = [r for r, x in zip(rows, back, strict=True) if not x]
    if back.any():
        scale = log_count_ratios(own, good[~back])
    weights, bias = dual_coordinate_descent(own, scale, good[~back])
    model = Model(scale, weights, bias, 1.0, 0.0)
    seen = np.flatnonzero(back if back.any() else ~back)
    model.slope, model.offset = logistic_curve(np.array([model.margin(rows[i]) for i in seen]), good[seen])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = MOST_TRAINING_ROWS) -> DataFrame:
    """Rows (key, text, good) of the labelled documents that a model may be fitted to, ``most`` of them.

    Labels that are null, of null keys or of keys whose crc32 is a multiple of
    five are left out.  Of labels and documents that repeat a key the smallest counts.
    """
    named = rows.chosen(labels, key=key, good=label)
    usable = named.where(F.col("good").isNotNull() & (F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0))
    one = usable.groupBy("key").agg(F.min("good").alias("good"))
    chosen = one.orderBy(F.xxhash64("key"), "key").limit(most)  # the bound of the broadcast below
    found = rows.chosen(docs, key=key, text=text).join(F.broadcast(chosen), "key")
    return found.groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """A model of ``label`` 1 against 0.  Indicators are made where the texts are; one task fits them."""
    texts = training_rows(docs, labels, label, key, text)

    def indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Indicators()
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [make.of(x).tobytes() for x in byte_texts(batch.column("text"))]
                yield pa.record_batch([batch.column("h"), pa.array(found, pa.binary()), batch.column("good")], ["h", "found", "good"])

    def learn(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("h", "ascending")])
        found = [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
        model = fit_rows(found, np.array(batch.column("good").to_pylist()) == 1)
        packed = [model.scale.astype(np.float32).tobytes(), model.weights.astype(np.float32).tobytes()]
        numbers = [model.bias, model.slope, model.offset]
        return pa.table({"scale": [packed[0]], "weights": [packed[1]], "numbers": pa.array([numbers], pa.list_(pa.float64()))})

    hashed = texts.select(F.xxhash64("key").alias("h"), "text", F.col("good").cast("int").alias("good"))
    made = cut_lineage(hashed.mapInArrow(indicate, "h bigint, found binary, good int"))
    upto = F.sum(F.octet_length("found")).over(Window.orderBy("h"))  # over as many rows as are labelled at most
    last = made.select("h", upto.alias("upto")).where(F.col("upto") <= MOST_TRAINING_BYTES).agg(F.max("h")).first()[0]
    made = made.where(F.col("h") <= F.lit(last)).withColumn("one", F.lit(1))
    schema = "scale binary, weights binary, numbers array<double>"
    fitted = made.groupBy("one").applyInArrow(lambda t: learn(t.drop_columns(["one"])), schema).collect()
    if not fitted:
        return fit_rows([], np.zeros(0, bool))
    return Model(np.frombuffer(fitted[0]["scale"], np.float32), np.frombuffer(fitted[0]["weights"], np.float32), *fitted[0]["numbers"])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score, for every row; null and empty texts have no indicators.

    A row's score depends on its whole text alone, so repeated rows agree; an empty
    table gives no rows.  Other columns are not read and may have any names and types.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    inner = {f"c{i}": k for i, k in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Indicators()
        for whole in batches:
            for batch in pieces(whole, "text"):
                scores = [shared.value.score(make.of(x)) for x in byte_texts(batch.column("text"))]
                yield pa.record_batch([*(batch.column(c) for c in inner), pa.array(scores, pa.float64())], [*inner, "score"])

    made = rows.schema(*((c, rows.kind(docs, k)) for c, k in inner.items()), ("score", "double"))
    return rows.chosen(docs, **inner, text=text).mapInArrow(run, made).toDF(*keep, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
