"""Two-sided exchange between chunks of documents and hash buckets.

Documents are written once, dealt into chunks of bounded bytes and rows. Each chunk sends, for every hash bucket that
it has keys for, one binary row with its *distinct* keys; a bucket answers each chunk with one bit per key. A key that
a third of all documents hold thus costs one entry per chunk, not one per document, and neither side ever gathers the
documents of a key. The same exchange of documents by chunk serves every step that needs the texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from turnloom.llm import textbytes as B
from turnloom.llm.storage import written

#: Bytes of text and rows in a chunk at most (one longer text is a chunk of its own); bounds what a worker holds.
CHUNK_BYTES, CHUNK_ROWS = 1 << 22, 1 << 13

SENT = "bucket long, chunk long, n long, keys binary, more binary"
SENT_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
ANSWER = "chunk long, part long, bucket long, bits binary"
ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def chunk_numbers(sizes: np.ndarray, state: list[int], limit: int, rows: int) -> np.ndarray:
    """Number of each row's chunk: rows in order, until a chunk is full. ``state``: (number, bytes, rows) so far."""
    total, out, i = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0
    while i < len(sizes):
        done = int(total[i - 1]) if i else 0
        j = min(int(np.searchsorted(total, done + limit - state[1], "right")), i + rows - state[2])
        if j <= i:
            if state[2]:
                state[:] = state[0] + 1, 0, 0
                continue
            j = i + 1
        out[i:j] = state[0]
        state[1:] = state[1] + int(total[j - 1]) - done, state[2] + j - i
        i = j
    return out


def _deal(schema: pa.Schema, limit: int, rows: int, slots: int):
    def deal(stream):
        task, state = TaskContext.get().partitionId(), [0, 0, 0]
        for batch in stream:
            _, offsets = B.column_bytes(batch.column("text"))
            numbers = chunk_numbers(np.diff(offsets), state, limit, rows)
            extra = [pa.array(((numbers + task) % slots).astype(np.int32))] if slots else []
            numbers += task << 40
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(batch.columns, schema.types)), pa.array(numbers), *extra], schema=schema)

    return deal


def dealt(docs: DataFrame, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS, carry: tuple[str, ...] = (), slots: int = 0) -> tuple[DataFrame, int]:
    """(doc_id, text, carried columns as _name, chunk) as a written table, and the number of hash buckets for it.

    The chunk is written with the row, so equal rows, and rows without an id, spread over chunks, and a step that is
    run again after a lost executor sees the same chunks. With ``slots`` the chunks are dealt in turn into as many slots
    and the table is laid out by the last column, ``slot``.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    named_out = named.withColumn("chunk", F.lit(0).cast("long"))
    out = (named_out.withColumn("slot", F.lit(0)) if slots else named_out).schema
    table = written(named.mapInArrow(_deal(to_arrow_schema(out), limit, rows, slots), out), "chunks", ("slot",) if slots else ())
    chunks = table.select("chunk").distinct().count()
    return table, max(1, -(-chunks // 2))


class Cuts:
    """Where the occupied buckets start in ascending 64-bit hashes; buckets are equal ranges of hashes."""

    def __init__(self, top: np.ndarray, buckets: int):
        owner = (((top.astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        self.buckets, self.starts, self.size = owner[first], np.append(first, len(top)), len(top)

    def __iter__(self):
        """(bucket, start, end) of each occupied bucket."""
        return zip(self.buckets.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist())

    def sent(self, chunk: int, make) -> pa.Table:
        """One row for each occupied bucket; ``make`` gives the two binaries of a range of keys."""
        rows = [(b, chunk, j - i, *make(i, j)) for b, i, j in self]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, SENT_ARROW.types)], schema=SENT_ARROW)

    def answered(self, answers: pa.Table, part: int):
        """(start, end, binary) of the answers of one part."""
        mine = answers.filter(pa.array(np.asarray(answers.column("part")) == part)) if answers.num_rows else answers
        at = np.searchsorted(self.buckets, np.asarray(mine.column("bucket")))
        return zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), mine.column("bits")) if len(at) else ()


def bits_of(answers: pa.Table, part: int, cuts: Cuts) -> np.ndarray:
    """A chunk's answers as one boolean per distinct key, in the order sent; buckets without an answer say no."""
    out = np.zeros(cuts.size, bool)
    for i, j, raw in cuts.answered(answers, part):
        out[i:j] = np.unpackbits(np.frombuffer(raw.as_buffer(), np.uint8), count=j - i).astype(bool)
    return out


def answer(table: pa.Table, part: int, yes: np.ndarray) -> pa.Table:
    """Rows for the chunks of a bucket's table, from one boolean for each key in the rows' order."""
    rows, at = [], 0
    for bucket, chunk, n in zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "n"))):
        if yes[at : at + n].any():
            rows.append((chunk, part, bucket, np.packbits(yes[at : at + n]).tobytes()))
        at += n
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 4, ANSWER_ARROW.types)], schema=ANSWER_ARROW)


def joined(table: pa.Table, column: str) -> np.ndarray:
    """The bytes of a bucket's rows one after another."""
    return np.frombuffer(b"".join(v.as_py() or b"" for v in table.column(column)), np.uint8)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u8")
