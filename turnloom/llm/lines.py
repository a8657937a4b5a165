"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased, as a 96-bit hash. Batches of
documents come one after another. A batch's distinct keys, sorted, are merge-anti-joined with the runs of earlier
batches (keys that are settled there drop out) and what is left becomes a run of its own, a table in the shared
folder. As soon as ``FANOUT`` runs of a level have gathered they are compacted into one of the next level, so each
entry is rewritten a logarithmic number of times. Two uses:

* ``drop_frequent_lines``: lines of many documents of one corpus; a key is settled once enough documents have it.
* ``LineRuns.add``: batches that arrive over time; a key is settled by its first occurrence.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from turnloom.llm import exchange as X
from turnloom.llm import textbytes as B
from turnloom.llm.storage import discard, folder, scratch

#: Runs of a level that are compacted into one; batches that a whole corpus is cut into at most, and chunks in a batch at least.
FANOUT, BATCHES, BATCH_CHUNKS = 3, 6, 32
KEY = 12
RUN = "bucket long, keys binary, counts binary"
_RUN_ARROW = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
OUT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of several, counts of equal keys added."""
    if not keys:
        return np.zeros(0, f"S{KEY}"), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _arrays(table: pa.Table, counts: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x.as_py(), f"S{KEY}") for x in table.column("keys")], [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column(counts)]


def _run(bucket: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    rows = [(bucket, keys.tobytes(), np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes())] if len(keys) else []
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 3, _RUN_ARROW.types)], schema=_RUN_ARROW)


def _fresh(settled: int):
    """A batch's run: its keys without those that earlier runs hold in ``settled`` documents or more."""

    def fresh(key, sent, runs):
        keys, counts = merged(*_arrays(sent, "more"))
        old, times = merged(*_arrays(runs, "counts"))
        done = old[times >= settled]
        at = np.minimum(np.searchsorted(done, keys), max(0, len(done) - 1))
        new = done[at] != keys if len(done) else np.ones(len(keys), bool)
        return _run(key[0].as_py(), keys[new], counts[new])

    return fresh


def _compacted(key, runs):
    return _run(key[0].as_py(), *merged(*_arrays(runs, "counts")))


class _Chunk:
    """Keys of a chunk's lines."""

    def __init__(self, docs: pa.Table, min_chars: int):
        self.ids = docs.column("doc_id")
        self.buf, self.offsets = B.column_bytes(docs.column("text"))
        one, two, size, counts = [], [], [], []
        for _, _, b, o in B.pieces(self.buf, self.offsets):
            s, e, n = B.line_spans(b, o)
            ws, we, _ = B.word_spans(b, o)
            s, e = B.stripped(s, e, ws, we)
            low = B.LOWER[b]
            one.append(B.segment_hashes(low, s, e, 0))
            two.append(B.segment_hashes(low, s, e, 1))
            chars = np.append(0, np.cumsum((b & 0xC0) != 0x80))
            size.append(chars[e] - chars[s])
            counts.append(np.diff(n))
        self.counts = np.concatenate([np.zeros(0, np.int64), *counts])
        self.first = np.append(0, np.cumsum(self.counts))
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(np.concatenate([np.zeros(0, np.int64), *size]) >= min_chars)
        raw = np.empty((len(at), KEY), np.uint8)
        if len(at):
            raw[:, :8] = np.concatenate(one)[at].astype(">u8").view(np.uint8).reshape(-1, 8)
            raw[:, 8:] = np.concatenate(two)[at].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :4]
        self.at = at
        self.keys, self.group = np.unique(raw.view(f"S{KEY}").reshape(-1), return_inverse=True)
        self.top = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(-1, KEY)[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)

    def documents(self) -> np.ndarray:
        """Rows of the chunk that hold each distinct key."""
        pairs = np.unique(self.group * max(1, len(self.counts)) + self.row[self.at])
        return np.bincount(pairs // max(1, len(self.counts)), minlength=len(self.keys))


def _send(buckets: int, min_chars: int):
    def send(key, docs):
        c = _Chunk(docs, min_chars)
        n = c.documents()
        return X.Cuts(c.top, buckets).sent(key[0].as_py(), lambda i, j: (c.keys[i:j].tobytes(), n[i:j].astype("<u4").tobytes()))

    return send


def _frequent(min_docs: int):
    """Answers the chunks which of their keys have at least ``min_docs`` documents in the runs."""

    def mark(key, sent, runs):
        if not sent.num_rows:
            return X.ANSWER_ARROW.empty_table()
        keys, counts = merged(*_arrays(runs, "counts"))
        return X.answer(sent, 0, np.concatenate([counts[np.searchsorted(keys, k)] >= min_docs for k in _arrays(sent, "more")[0]]))

    return mark


def _repeated(key, sent, run):
    """Answers the chunks which of their keys are not in the batch's run, or are, but came in an earlier chunk."""
    if not sent.num_rows:
        return X.ANSWER_ARROW.empty_table()
    new, _ = merged(*_arrays(run, "counts"))
    keys = _arrays(sent, "more")[0]
    chunk = np.repeat(np.array(sent.column("chunk")), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.lexsort((chunk, keys))
    first = np.zeros(len(keys), bool)
    first[order[np.append(True, keys[order][1:] != keys[order][:-1])]] = True
    at = np.minimum(np.searchsorted(new, keys), max(0, len(new) - 1))
    return X.answer(sent, 0, ~(first & (new[at] == keys)) if len(new) else np.ones(len(keys), bool))


def _rewrite(buckets: int, min_chars: int, keep_text: bool, carry: pa.Schema, once: bool = False):
    """Texts without the lines that the answers name; ``once``: nor a line that the chunk had before."""
    schema = pa.schema([*_OUT_ARROW, *carry])

    def rewrite(key, docs, answers):
        if not docs.num_rows:
            return schema.empty_table()
        c = _Chunk(docs, min_chars)
        drop = np.zeros(len(c.row), bool)
        if answers.num_rows:
            drop[c.at] = X.bits_of(answers, 0, X.Cuts(c.top, buckets))[c.group]
        if once:
            again = np.ones(len(c.at), bool)
            again[np.unique(c.group, return_index=True)[1]] = False
            drop[c.at] |= again
        dropped = np.bincount(c.row[drop], minlength=len(c.counts))
        raw, sums, texts, keep = c.buf.tobytes(), [], [], ~drop
        for i, n in enumerate(dropped):
            text = raw[c.offsets[i] : c.offsets[i + 1]]
            if n:
                text = b"\n".join(compress(text.split(b"\n"), keep[c.first[i] : c.first[i + 1]]))
            sums.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8", "replace") if keep_text else None)
        return pa.Table.from_arrays([c.ids.combine_chunks().cast(pa.int64()), pa.array(c.counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string()), *(docs.column(f"_{n}").combine_chunks().cast(t) for n, t in zip(schema.names[len(_OUT_ARROW) :], schema.types[len(_OUT_ARROW) :]))], schema=schema)

    return rewrite


class LineRuns:
    """Line keys of earlier batches as levelled sorted runs in a shared folder, for one writer at a time.

    A batch's run and its result are written aside and published by one rename, under the batch's name; a batch that
    failed before can be added again, and one that was added before returns its result and adds nothing. A compacted
    run names the runs that it replaces and is published in the same way; replaced runs no longer count, whether or
    not they have been deleted yet.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = FANOUT, settled: int = 1):
        self.spark, self.path, self.buckets, self.fanout, self.settled = spark, path.rstrip("/"), buckets, fanout, settled

    def _children(self, *parts: str) -> list[str]:
        fs, p = folder(self.spark, "/".join([self.path, *parts]))
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _publish(self, aside: str, level: int, name: str) -> None:
        fs, source = folder(self.spark, aside)
        _, parent = folder(self.spark, f"{self.path}/{level}")
        fs.mkdirs(parent)
        if not fs.rename(source, folder(self.spark, f"{self.path}/{level}/{name}")[1]):
            raise OSError(f"could not publish {level}/{name}")

    def runs(self) -> list[tuple[int, str]]:
        """(level, name) of the published runs that no other replaces."""
        found = [(int(level), name) for level in self._children() if level.isdigit() for name in self._children(level)]
        gone = {old for level, name in found for old in self._children(str(level), name, "replaces")}
        return [(level, name) for level, name in found if f"{level}.{name}" not in gone]

    def table(self, runs: list[tuple[int, str]] | None = None) -> DataFrame:
        """bucket, keys and counts (packed, sorted by key) of some runs, all by default."""
        paths = [f"{self.path}/{level}/{name}/run" for level, name in (self.runs() if runs is None else runs)]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _write_run(self, sent: DataFrame, aside: str) -> None:
        sent.groupBy("bucket").cogroup(self.table().groupBy("bucket")).applyInArrow(_fresh(self.settled), RUN).write.mode("overwrite").option("compression", "zstd").parquet(f"{aside}/run")

    def count(self, sent: DataFrame, batch: str) -> None:
        """Add a batch's run, from its chunks' keys by bucket."""
        if batch not in self._children("0"):
            aside = f"{self.path}/aside-{uuid.uuid4().hex}"
            self._write_run(sent, aside)
            self._publish(aside, 0, batch)
        self._compact()

    def add(self, docs: DataFrame, batch: str, min_chars: int = 1, chunk_rows: int = X.CHUNK_ROWS) -> DataFrame:
        """The batch's texts without lines that earlier batches had; of a line repeated in the batch the first stays.

        Takes doc_id and text and returns the columns of ``drop_frequent_lines``. "First" is by chunk, then row, so
        it follows the order of the table where there is one. Lines whose key has fewer than ``min_chars`` code
        points always stay. A null or empty text is one empty line. Rows without an id, or that repeat one, are
        documents like others. An empty batch has an empty result.
        """
        if batch not in self._children("0"):
            table, _ = X.dealt(docs, rows=chunk_rows)
            groups = table.groupBy("chunk")
            sent = groups.applyInArrow(_send(self.buckets, min_chars), X.SENT)
            aside = f"{self.path}/aside-{uuid.uuid4().hex}"
            self._write_run(sent, aside)
            run = self.spark.read.schema(RUN).parquet(f"{aside}/run")
            answers = sent.groupBy("bucket").cogroup(run.groupBy("bucket")).applyInArrow(_repeated, X.ANSWER)
            out = groups.cogroup(answers.groupBy("chunk")).applyInArrow(_rewrite(self.buckets, min_chars, True, pa.schema([]), once=True), OUT)
            out.write.option("compression", "zstd").parquet(f"{aside}/result")
            discard(table)
            self._publish(aside, 0, batch)
        self._compact()
        return self.spark.read.schema(OUT).parquet(f"{self.path}/0/{batch}/result")

    def _compact(self, level: int = 0) -> None:
        runs = [run for run in self.runs() if run[0] == level]
        if len(runs) < self.fanout:
            return
        name = uuid.uuid4().hex
        aside = f"{self.path}/aside-{name}"
        self.table(runs).groupBy("bucket").applyInArrow(_compacted, RUN).write.option("compression", "zstd").parquet(f"{aside}/run")
        for old in runs:
            fs, p = folder(self.spark, f"{aside}/replaces/{old[0]}.{old[1]}")
            fs.mkdirs(p)
        self._publish(aside, level + 1, name)
        for old in runs:
            fs, p = folder(self.spark, f"{self.path}/{old[0]}/{old[1]}/run")
            fs.delete(p, True)
        self._compact(level + 1)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, fanout: int = FANOUT, batches: int = BATCHES, batch_chunks: int = BATCH_CHUNKS, keep_text: bool = True, chunk_bytes: int = X.CHUNK_BYTES, chunk_rows: int = X.CHUNK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` rows.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, n_lines, n_dropped, kept_sha256 and
    kept_text (null unless keep_text), one row for each input row. A null or empty text is one empty line and
    stays the empty text; a text that loses all lines becomes empty. Rows that repeat a doc_id, or have none,
    count as documents of their own. An empty table gives an empty result. Columns named in ``carry`` come along.

    The corpus is cut into one batch for each ``batch_chunks`` chunks, at most ``batches``, whatever files it is read
    from. With one batch there is no earlier run to join with; the result does not depend on their number.
    """
    return _dropped(docs, min_docs, min_chars, fanout, batches, batch_chunks, keep_text, chunk_bytes, chunk_rows, carry)[0]


def _dropped(docs: DataFrame, min_docs: int, min_chars: int, fanout: int, batches: int, batch_chunks: int, keep_text: bool, chunk_bytes: int, chunk_rows: int, carry: tuple[str, ...]) -> tuple[DataFrame, LineRuns]:
    """``drop_frequent_lines`` and its runs."""
    spark = docs.sparkSession
    table, buckets = X.dealt(docs, chunk_bytes, chunk_rows, carry, batches)
    runs = LineRuns(spark, scratch(spark, "line-runs"), buckets, fanout, min_docs)

    def sent(rows: DataFrame) -> DataFrame:
        return rows.groupBy("chunk").applyInArrow(_send(buckets, min_chars), X.SENT)

    n = min(batches, max(1, 2 * buckets // batch_chunks))
    filled = {slot % n for (slot,) in table.select("slot").distinct().collect()}  # at most ``batches`` numbers
    for batch in sorted(filled):
        runs.count(sent(table.filter(F.col("slot") % n == batch)), str(batch))
    extra = docs.select(*carry).schema
    groups = table.drop("slot").groupBy("chunk")
    answers = sent(table.drop("slot")).groupBy("bucket").cogroup(runs.table().groupBy("bucket")).applyInArrow(_frequent(min_docs), X.ANSWER)
    out = groups.cogroup(answers.groupBy("chunk")).applyInArrow(_rewrite(buckets, min_chars, keep_text, to_arrow_schema(extra)), ", ".join([OUT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)]))
    return out, runs
