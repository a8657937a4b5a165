"""Substring deduplication by difference-cover anchors.

A window is ``WINDOW`` consecutive words. Word positions whose remainder modulo ``PERIOD`` lies in the difference
cover ``COVER`` carry an anchor, the hash of ``ANCHOR`` words. As every remainder is a difference of two members
of the cover, and PERIOD - 1 + ANCHOR = WINDOW, two equal windows, wherever they start in their texts, hold a pair
of equal anchors at the same place. So a window can repeat only where one of its anchors occurs in two documents;
only such windows are extended to all their words (96-bit hash) and compared for the smallest document id.

Steps: anchors per chunk -> buckets mark anchors found in two documents -> windows around those, per chunk -> buckets
mark windows that start in a smaller document -> texts lose the words so covered.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm import exchange as X
from turnloom.llm import textbytes as B

WINDOW, PERIOD, ANCHOR = 13, 7, 7
#: Every remainder modulo 7 is a difference of two of these.
COVER = (0, 1, 3)
#: Bytes of an anchor's hash that are sent besides its bucket; a chance match only costs a comparison later.
ANCHOR_BYTES = 6

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class _Chunk:
    """Word hashes and anchors of a chunk's texts, the same whenever they are computed again."""

    def __init__(self, docs: pa.Table):
        self.ids = docs.column("doc_id")
        buf, offsets = B.column_bytes(docs.column("text"))
        self.buf, self.offsets = buf, offsets
        hashes, counts = ([], []), [np.zeros(0, np.int64)]
        for _, _, b, o in B.pieces(buf, offsets):
            s, e, w = B.word_spans(b, o)
            for lane in (0, 1):
                hashes[lane].append(B.segment_hashes(b, s, e, lane))
            counts.append(np.diff(w))
        self.words = [np.concatenate([np.zeros(0, B.U64), *h]) for h in hashes]
        self.counts = np.concatenate(counts)
        self.first = np.append(0, np.cumsum(self.counts))
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.known = np.asarray(self.ids.is_valid())
        self.id = np.asarray(self.ids.fill_null(0)).astype(np.int64)
        place = B.ragged_range(self.counts)
        self.starts = B.window_starts(self.first, WINDOW)
        self.starts = self.starts[self.known[self.row[self.starts]]]
        whole = np.zeros(len(self.row), bool)  # positions inside some window, as a start of an anchor
        near = np.zeros(len(self.row) + 1, np.int64)
        np.add.at(near, self.starts, 1)
        np.add.at(near, self.starts + PERIOD, -1)
        whole = np.cumsum(near[:-1]) > 0
        self.at = np.flatnonzero(whole & np.isin(place % PERIOD, COVER))
        self.hash = B.run_hashes(self.words[0], self.at, ANCHOR)
        self.distinct, self.back = np.unique(self.hash, return_inverse=True)

    def shared_here(self) -> np.ndarray:
        """Distinct anchors that two rows of this chunk hold."""
        low = np.full(len(self.distinct), len(self.counts), np.int64)
        high = np.full(len(self.distinct), -1, np.int64)
        np.minimum.at(low, self.back, self.row[self.at])
        np.maximum.at(high, self.back, self.row[self.at])
        return low < high

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a shared anchor."""
        hit = np.zeros(len(self.row) + 1, np.int64)
        hit[self.at[shared[self.back]] + 1] = 1
        seen = np.cumsum(hit)
        return self.starts[seen[self.starts + PERIOD] > seen[self.starts]]

    def windows(self, shared: np.ndarray):
        """(starts, group of each start, distinct hashes, their second hashes, smallest id of each)."""
        at = self.candidates(shared)
        one, two = B.run_hashes(self.words[0], at, WINDOW, 1), B.run_hashes(self.words[1], at, WINDOW) & B.U64(0xFFFFFFFF)
        ids = self.id[self.row[at]]
        order = np.lexsort((ids, two, one))
        a, b = one[order], two[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        return at, group, a[new], b[new], ids[order][new]


def _send_anchors(buckets: int):
    def send(key, docs):
        c = _Chunk(docs)
        flags = c.shared_here()
        return X.Cuts(c.distinct, buckets).sent(key[0].as_py(), lambda i, j: (X.packed(c.distinct[i:j], ANCHOR_BYTES), np.packbits(flags[i:j]).tobytes()))

    return send


def _mark_anchors(table):
    keys = X.unpacked(X.joined(table, "keys"), ANCHOR_BYTES)
    flags = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(table.column("more"), table.column("n").to_pylist())])
    order = np.argsort(keys, kind="stable")
    k, f = keys[order], flags[order].astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    many = (np.diff(np.append(first, len(k))) > 1) | (np.add.reduceat(f, first) > 0)
    yes = np.empty(len(k), bool)
    yes[order] = many[np.cumsum(new) - 1]
    return X.answer(table, 0, yes)


def _send_windows(buckets: int):
    def send(key, docs, answers):
        if not docs.num_rows or not answers.num_rows:
            return X.SENT_ARROW.empty_table()
        c = _Chunk(docs)
        _, _, one, two, low = c.windows(X.bits_of(answers, 0, X.Cuts(c.distinct, buckets)))

        def make(i, j):
            least = low[i:j].min()
            return one[i:j].astype("<u8").tobytes() + two[i:j].astype("<u4").tobytes(), int(least).to_bytes(8, "little", signed=True) + _narrow(low[i:j] - least)

        return X.Cuts(one, buckets).sent(key[0].as_py(), make)

    return send


def _narrow(gaps: np.ndarray) -> bytes:
    """Offsets of ids in as few bytes as the largest needs; the width comes first."""
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + X.packed(gaps.astype(np.uint64), width)


def _mark_windows(table):
    one, two, low = [], [], []
    for k, m, n in zip(table.column("keys"), table.column("more"), table.column("n").to_pylist()):
        raw, more = k.as_py(), m.as_py()
        one.append(np.frombuffer(raw, "<u8", n))
        two.append(np.frombuffer(raw, "<u4", n, 8 * n))
        low.append(X.unpacked(np.frombuffer(more, np.uint8, offset=9), more[8]).astype(np.int64) + int.from_bytes(more[:8], "little", signed=True))
    one, two, low = map(np.concatenate, (one, two, low))
    order = np.lexsort((low, two, one))
    a, b, d = one[order], two[order], low[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    yes = np.empty(len(a), bool)
    yes[order] = least < d
    return X.answer(table, 1, yes)


def _rewrite(buckets: int, keep_text: bool):
    def rewrite(key, docs, answers):
        if not docs.num_rows:
            return pa.Table.from_pylist([], _OUT_ARROW)
        c = _Chunk(docs)
        gone = np.zeros(len(c.row) + 1, np.int64)
        if answers.num_rows:
            at, group, one, _, low = c.windows(X.bits_of(answers, 0, X.Cuts(c.distinct, buckets)))
            smaller = X.bits_of(answers, 1, X.Cuts(one, buckets))
            at = at[smaller[group] | (c.id[c.row[at]] > low[group])]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
        keep = np.cumsum(gone[:-1]) == 0
        removed = np.bincount(c.row[~keep], minlength=len(c.counts))
        raw, sums, texts = c.buf.tobytes(), [], []
        for i, n in enumerate(removed):
            words = raw[c.offsets[i] : c.offsets[i + 1]].split()
            text = b" ".join(compress(words, keep[c.first[i] : c.first[i + 1]]) if n else words)
            sums.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8", "replace") if keep_text else None)
        return pa.Table.from_arrays([c.ids.combine_chunks().cast(pa.int64()), pa.array(c.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], schema=_OUT_ARROW)

    return rewrite


_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def remove_repeats(docs: DataFrame, keep_text: bool = True, chunk_bytes: int = X.CHUNK_BYTES, chunk_rows: int = X.CHUNK_ROWS) -> DataFrame:
    """Drop the words covered by a 13-word window that also starts in a document with a smaller id.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256 and
    kept_text (kept words joined by a space; null unless keep_text), one row for each input row.

    Windows are judged on the input. A null or empty text has no words and stays empty. A row with a null doc_id
    neither loses words nor makes others lose any; rows that repeat a doc_id don't affect one another. An empty
    table gives an empty result.
    """
    table, buckets = X.dealt(docs, chunk_bytes, chunk_rows)
    groups = table.groupBy("chunk")
    anchors = groups.applyInArrow(_send_anchors(buckets), X.SENT).groupBy("bucket").applyInArrow(_mark_anchors, X.ANSWER)
    windows = groups.cogroup(anchors.groupBy("chunk")).applyInArrow(_send_windows(buckets), X.SENT).groupBy("bucket").applyInArrow(_mark_windows, X.ANSWER)
    return groups.cogroup(anchors.unionByName(windows).groupBy("chunk")).applyInArrow(_rewrite(buckets, keep_text), OUT)
