"""Quality classifier: naive Bayes support vectors.

Features are indicators of a text's distinct byte bigrams and hashed byte trigrams. Each is scaled by its log-count
ratio between the two classes; a linear hinge-loss model on the scaled indicators is fitted by dual coordinate
descent, and a logistic curve, fitted on training rows kept out of the descent, turns margins into probabilities.
The fit uses at most ``TRAIN_DOCS`` labelled texts, drawn by a hash of the id; every text is then scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B
from turnloom.llm.language import drawn, remainder

#: Buckets of bigrams (exact) and of trigrams (hashed).
BIGRAMS, TRIGRAMS = 1 << 16, 1 << 16
SIZE = BIGRAMS + TRIGRAMS
TRAIN_DOCS = 6000
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 20, 3
OUT = "doc_id long, held_out boolean, score double, predicted int"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def gram_ids(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the bigram and of the trigram at each position of one text."""
    x = b.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (((two[:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    return two, three + np.uint32(BIGRAMS)


class Marks:
    """The set of features of one text, as a reusable indicator array."""

    STEP = 1 << 20

    def __init__(self):
        self.on = np.zeros(SIZE, np.float32)

    def of(self, b: np.ndarray) -> np.ndarray:
        self.on[:] = 0
        for k in range(0, len(b), self.STEP):
            for ids in gram_ids(b[k : k + self.STEP + 2]):
                self.on[ids] = 1
        return self.on


def packed(on: np.ndarray) -> bytes:
    """A set of features as 32-bit numbers or, where that is shorter, as one bit each."""
    ids = np.flatnonzero(on).astype("<u4")
    return ids.tobytes() if 4 * len(ids) < SIZE // 8 else np.packbits(on > 0).tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    return raw.view("<u4") if len(raw) < SIZE // 8 else np.flatnonzero(np.unpackbits(raw, count=SIZE)).astype(np.uint32)


def _sample(batches):
    marks = Marks()
    for batch in batches:
        buf, offsets = B.column_bytes(batch.column("text"))
        sets = [packed(marks.of(buf[offsets[i] : offsets[i + 1]])) for i in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("doc_id"), batch.column("good"), pa.array(sets, pa.binary())], names=["draw", "doc_id", "good", "features"])


class Model:
    """weights (already scaled), bias, and the logistic curve's slope and shift; a constant where a class is missing."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def log_count_ratios(sets: list[np.ndarray], y: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of the features' shares in class 1 over those in class 0."""
    counts = np.full((2, SIZE), smoothing)
    for s, k in zip(sets, y):
        counts[int(k), s] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0]).astype(np.float32)


def dual_descent(sets: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the scaled indicators, bias and dual variables of the L1-loss support vector machine.

    Vectors are scaled to unit length, so that long texts don't outweigh short ones. One dual variable is optimised
    at a time, in a new random order each epoch, until no projected gradient is left.
    """
    rng = np.random.default_rng(seed)
    values = [ratios[s] for s in sets]
    values = [v / max(float(np.sqrt(v @ v)), 1e-9) for v in values]
    sign = np.where(y == 1, 1.0, -1.0)
    share = y.mean()
    bound = np.where(y == 1, cost / (2 * share), cost / (2 * (1 - share)))  # the rarer class weighs as much as the other
    square = np.array([float(v @ v) + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(y)), np.zeros(SIZE, np.float32), 0.0
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = sign[i] * (float(w[sets[i]] @ values[i]) + bias) - 1
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == bound[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / square[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            worst = max(worst, abs(g))
            if step:
                w[sets[i]] += np.float32(step) * values[i]
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias, alpha


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's softened targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def fitted(ids: np.ndarray, sets: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Model:
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(None, 0.0, 0.0, float(np.log(p / (1 - p))))
    fold = np.random.default_rng(seed).permutation(len(y)) % 4 == 0
    if min(np.bincount(y[fold], minlength=2).min(), np.bincount(y[~fold], minlength=2).min()) == 0:
        fold = np.ones(len(y), bool)  # too few rows to keep some out
        train = fold
    else:
        train = ~fold
    part = [s for s, k in zip(sets, train) if k]
    ratios = log_count_ratios(part, y[train])
    w, bias, _ = dual_descent(part, y[train], ratios)
    w = w * ratios
    margins = np.array([margin(w, bias, ratios, s) for s, k in zip(sets, fold) if k])
    return Model(np.stack([w, ratios * ratios]), bias, *logistic(margins, y[fold]))


def margin(w: np.ndarray, bias: float, ratios: np.ndarray, s: np.ndarray) -> float:
    v = ratios[s]
    return float(w[s].sum()) / max(float(np.sqrt(v @ v)), 1e-9) + bias


def _score(sent, threshold: float):
    def run(batches):
        model, marks = sent.value, Marks()
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            scores = []
            for i in range(len(offsets) - 1):
                m = 0.0
                if model.weights is not None:
                    total, square = model.weights @ marks.of(buf[offsets[i] : offsets[i + 1]])
                    m = float(total) / max(float(np.sqrt(square)), 1e-9) + model.bias
                scores.append(model.score(m))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=_OUT_ARROW)

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, train_docs: int = TRAIN_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score (probability that quality is 1) and predicted for each row of ``docs``.

    Learns from labels.quality (0 or 1) of rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``; a score
    reads nothing but the text. A document with several labels counts with the larger. Null and empty texts have
    no features and get the score of the bias. If a class has no labels, all texts get the share of the other,
    smoothed; without any labels that is 0.5. Rows without a doc_id are scored, but not learned from. Of at most
    ``train_docs`` labelled ids, those with the smallest hashes, one row each teaches, in the order of the hashes.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("good"))
    marked = marked.filter(remainder(F.col("doc_id"), folds) != held_out)
    some = drawn(marked, marked.count(), train_docs, F.col("doc_id"), F.lit(seed))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most train_docs ids are sent to all executors; a row of features has at most SIZE bits, and of rows that
    # share an id one is taken, so what comes to the driver is bounded.
    ids = some.orderBy("draw", "doc_id").limit(train_docs)
    sample = rows.join(F.broadcast(ids), "doc_id").select("draw", "doc_id", "good", "text")
    features = sample.mapInArrow(_sample, "draw long, doc_id long, good int, features binary")
    taught = features.groupBy("draw", "doc_id", "good").agg(F.max("features").alias("features")).orderBy("draw", "doc_id").toArrow()
    if not taught.num_rows:
        model = Model(None, 0.0, 0.0, 0.0)
    else:
        sets = [unpacked(np.frombuffer(s.as_buffer(), np.uint8)) for s in taught.column("features")]
        model = fitted(np.array(taught.column("doc_id")), sets, np.array(taught.column("good")), seed)
    scored = rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return scored.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), OUT)
