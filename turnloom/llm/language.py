"""Language identification with a byte convolutional network.

A text's bytes are cut into windows of ``WINDOW`` bytes (the last one padded with spaces). Each window goes through
byte embeddings, filters of several widths, ReLU, max pooling over positions and a softmax; a text's score for a
language is the mean over its windows, weighted by their bytes. The network is trained in numpy on the driver, on
windows of at most ``TRAIN_DOCS`` labelled texts drawn by a hash of the id; every text is then scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 12, 4
#: Bound of the training sample: texts, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 4
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 11
#: Windows that pass through the network together; the arrays then stay in cache.
BLOCK = 48
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes, row of the text of each, text bytes in each); empty texts have none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    out = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
    at = np.append(0, np.cumsum(counts)) * WINDOW
    for i in np.flatnonzero(sizes):
        out[at[i] : at[i] + sizes[i]] = buf[offsets[i] : offsets[i + 1]]
    row = np.repeat(np.arange(len(sizes)), counts)
    filled = np.minimum(WINDOW, sizes[row] - B.ragged_range(counts) * WINDOW)
    return out.reshape(-1, WINDOW), row, filled


class Network:
    """Embeddings, one filter bank as wide as the widest filter (narrower ones end in zeros), and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.span = max(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.concatenate([np.repeat((np.arange(self.span) < w)[:, None], EMBED, 1).reshape(-1, 1).repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Embeddings of the bytes under each filter position: (windows, positions, span * EMBED)."""
        e = self.embed[x]
        n = x.shape[1] - self.span + 1
        out = np.empty((len(x), n, self.span * EMBED), np.float32)
        for k in range(self.span):
            out[:, :, k * EMBED : (k + 1) * EMBED] = e[:, k : k + n]
        return out

    def pooled(self, x: np.ndarray, where: bool = False):
        cols = self.columns(x)
        z = (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(len(x), cols.shape[1], -1)
        if where:
            at = z.argmax(1)
            return np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, at, cols
        return z.max(1) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), BLOCK):
            out[i : i + BLOCK] = softmax(np.maximum(self.pooled(x[i : i + BLOCK]), 0) @ self.out + self.out_bias)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (0.5 ** (epoch // 4))
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                pick = order[i : i + BATCH]
                step += 1
                for n, g in zip(names, self._gradients(x[pick], y[pick])):
                    m, v = state[n]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p = getattr(self, n)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray):
        z, at, cols = self.pooled(x, where=True)
        a = np.maximum(z, 0)
        p = softmax(a @ self.out + self.out_bias)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dz = (p @ self.out.T) * (z > 0)
        f = np.arange(dz.shape[1])
        best = cols[np.arange(len(x))[:, None], at]  # the inputs at each filter's largest position
        d_filters = np.einsum("bf,bfk->kf", dz, best) * self.mask
        d_cols = dz[:, :, None] * self.filters.T[None]
        d_embed = np.zeros_like(self.embed)
        for k in range(self.span):
            np.add.at(d_embed, x[np.arange(len(x))[:, None], at[:, f] + k], d_cols[:, :, k * EMBED : (k + 1) * EMBED])
        return d_embed, d_filters, dz.sum(0), a.T @ p, p.sum(0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def drawn(rows: DataFrame, total: int, wanted: int, *by: Column) -> DataFrame:
    """About 1.25 x ``wanted`` of ``total`` rows, those with the smallest ``draw``, a 64-bit hash of ``by``; all if few.

    Hash and bound are compared as whole numbers, so the share is right for any number of rows.
    """
    bound = threshold(total, wanted)
    out = rows.withColumn("draw", F.xxhash64(*by))
    return out if bound is None else out.filter(F.col("draw") < F.lit(bound).cast("long"))


def threshold(total: int, wanted: int) -> int | None:
    """Bound on a signed 64-bit hash that about 1.25 x ``wanted`` + 50 of ``total`` rows are below; None for all."""
    most = wanted + wanted // 4 + 50
    return None if total <= most else (1 << 64) * most // total - (1 << 63)


def _samples(per_doc: int):
    schema = pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("bytes", pa.binary())])

    def take(batches):
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            lang, draw = batch.column("lang").to_pylist(), batch.column("draw").to_pylist()
            rows = []
            for i, j, b, o in B.pieces(buf, offsets):
                x, row, _ = windows(b, o)
                counts = np.bincount(row, minlength=j - i)
                first = np.cumsum(counts) - counts
                for k in np.flatnonzero(counts):
                    chosen = np.unique(np.linspace(0, counts[k] - 1, min(per_doc, counts[k])).astype(int))
                    rows.append({"draw": draw[i + k], "lang": lang[i + k], "bytes": x[first[k] + chosen].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return take


def trained(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = SEED) -> Network | None:
    """A network for the languages in ``lang``; None without labelled text. At most ``train_docs`` rows are used.

    They are the rows with the smallest hashes of id, text and lang; at most ``TRAIN_WINDOWS`` windows of each come to
    the driver, in the order of the hashes, so the same table gives the same network however it is partitioned.
    """
    labelled = docs.filter("lang IS NOT NULL AND text <> ''")
    some = drawn(labelled, labelled.count(), train_docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.lit(seed))
    cut = some.select("draw", "lang", "text").mapInArrow(_samples(TRAIN_WINDOWS), "draw long, lang string, bytes binary")
    rows = cut.orderBy("draw", "lang", "bytes").limit(train_docs).toArrow()
    if not rows.num_rows:
        return None
    parts = rows.column("bytes").to_pylist()
    lang = np.repeat(np.array(rows.column("lang").to_pylist()), [len(b) // WINDOW for b in parts])
    x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
    languages, y = np.unique(lang, return_inverse=True)
    return Network([str(v) for v in languages], seed).train(x, y, seed)


def _predict(sent):
    def run(batches):
        net = sent.value
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            n = len(offsets) - 1
            total = np.zeros((n, len(net.languages)))
            for i, j, b, o in B.pieces(buf, offsets):
                x, row, filled = windows(b, o)
                if len(x):
                    np.add.at(total, row + i, net.probabilities(x) * filled[:, None])
            total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
            best = total.argmax(1)
            letters = batch.column("letters").to_pylist()
            pred = [net.languages[k] if ok else "und" for k, ok in zip(best, letters)]
            score = [float(min(1.0, total[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, letters))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=_OUT_ARROW)

    return run


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean probability of lang_pred) for each row.

    Learns from text and lang of rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``; predictions read
    nothing but the text. A text that is null or has no letter is ``und`` with score 0, as is every text when
    nothing can be learned. Rows without a doc_id are predicted, but neither held out nor learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = trained(rows.filter(remainder(F.col("doc_id"), folds) != held_out), train_docs)
    scored = rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return scored.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return scored.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(net)), OUT)
