"""Periodic runs of words by longest previous factors.

The words of a batch's texts are laid end to end, with a separator of its own before and after each text. Prefix
doubling gives the suffix array and, level by level, names of all factors of 2**k words; from the names come the
longest common prefixes of neighbours in the suffix array, and by taking text positions out of that order, last
position first, the longest previous factor of each position and where it occurs. Its greedy parse are the LZ blocks.
A run that touches a boundary of blocks is found there (Main): for each period that the two blocks allow, the words
that agree one period apart are extended to both sides. A run strictly inside a block is a copy of an earlier one:
runs are kept in buckets by start, and each block copies the buckets of the stretch that it repeats.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

#: Bytes of text whose words are handled together (a longer text is handled alone).
PIECE = 1 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
OUT = f"doc_id long, n_words long, runs array<{RUN}>, text string"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN_ARROW)), ("text", pa.string())])


def _group_heads(keys: np.ndarray) -> np.ndarray:
    """Does a new key begin here? The keys ascend."""
    head = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=head[1:])
    return head


class Factors:
    """Suffix array and names of the factors of 2**k symbols, for symbols whose first and last are unique."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = _group_heads(symbols[order])
        slots = np.arange(n)
        name = np.empty(n, np.int32)
        name[order] = slots[head][np.cumsum(head) - 1]
        self.names = []
        width = 1
        slots = slots[~(head & np.append(head[1:], True))]
        self.repeated = slots  # places in the suffix array of positions whose first symbol occurs again
        while len(slots):
            self.names.append(name)
            at = order[slots]
            key = name[at].astype(np.int64) * n + name[at + width]  # a factor that occurs again ends before its text does
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[slots] = at
            head = _group_heads(key)
            name = name.copy()
            name[at] = slots[head][np.cumsum(head) - 1]
            slots = slots[~(head & np.append(head[1:], True))]
            width *= 2
        self.suffixes = order

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal symbols from x and from y on; x differs from y."""
        out, alive = np.zeros(len(x), np.int64), [np.arange(len(x))]
        for name in self.names:
            a = alive[-1]
            a = a[name[x[a]] == name[y[a]]]
            if not len(a):
                break
            alive.append(a)
        for k in range(len(alive) - 2, -1, -1):
            a, name = alive[k + 1], self.names[k]
            at = out[a]
            out[a] = at + ((name[x[a] + at] == name[y[a] + at]).astype(np.int64) << k)
        return out

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal symbols up to x and up to y, both included; x is before y."""
        out, alive = np.zeros(len(x), np.int64), [np.arange(len(x))]

        def same(name, k, a):
            i = x[a] - out[a] - ((1 << k) - 1)
            return (i >= 0) & (name[np.maximum(i, 0)] == name[np.maximum(i + y[a] - x[a], 0)])

        for k, name in enumerate(self.names):
            a = alive[-1]
            a = a[same(name, k, a)]
            if not len(a):
                break
            alive.append(a)
        for k in range(len(alive) - 2, -1, -1):
            a = alive[k + 1]
            out[a] += same(self.names[k], k, a).astype(np.int64) << k
        return out


def previous_factors(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(length, earlier place) of the longest factor from each position that also starts earlier; length 0 if none."""
    n = len(factors.suffixes)
    length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ordered = factors.suffixes[factors.repeated]
    m = len(ordered)
    if not m:
        return length, place
    common = factors.forward(ordered[:-1], ordered[1:])
    where = np.sort(ordered)
    small = np.empty(n, np.int64)
    small[where] = np.arange(m)
    ordered = small[ordered]
    before, after, lcp = np.full(m + 1, m), np.full(m + 1, m), np.zeros(m + 1, np.int64)  # m stands for neither end
    before[ordered[1:]], after[ordered[:-1]], lcp[ordered[1:]] = ordered[:-1], ordered[1:], common
    before, after, lcp = before.tolist(), after.tolist(), lcp.tolist()
    best, source = [0] * m, [0] * m
    for i in range(m - 1, -1, -1):  # all that are still in the list start earlier
        p, q = before[i], after[i]
        left, right = lcp[i], lcp[q]
        after[p], before[q] = q, p
        if left >= right:
            best[i], source[i], lcp[q] = left, p, right
        else:
            best[i], source[i], lcp[q] = right, q, left
        lcp[m] = 0
    length[where] = best
    place[where] = np.append(where, 0)[source]
    return length, place


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the LZ blocks start: each is the longest previous factor, or one new symbol; the end is added."""
    steps, out, i = np.maximum(length, 1).tolist(), [], 0
    while i < len(steps):
        out.append(i)
        i += steps[i]
    return np.array([*out, len(steps)])


def _boundary_runs(symbols: np.ndarray, factors: Factors, starts: np.ndarray, exponent: int) -> np.ndarray:
    """Rows (start, end, period) of periodic stretches that touch a block's start, at least ``exponent`` periods long.

    A stretch of period q that reaches into a block starts less than q before the block before it, as else that block
    would be longer; so (exponent - 1) * q is less than the lengths of both blocks.
    """
    sizes = np.diff(starts)
    most = np.maximum((sizes[:-1] + sizes[1:] - 1) // (exponent - 1), 0)
    b = np.repeat(starts[1:-1], most)
    q = B.ragged_range(most) + 1
    found = []
    for x in (b, b - q):  # the period's copy of words after x, and of those before it, is at y
        y = x + q
        ok = (x >= 1) & (y < len(symbols))
        x, y, p = x[ok], y[ok], q[ok]
        ok = (symbols[x] == symbols[y]) | (symbols[x - 1] == symbols[y - 1])
        x, y, p = x[ok], y[ok], p[ok]
        right = factors.forward(x, y)
        left = factors.backward(x - 1, y - 1)
        ok = left + right >= (exponent - 1) * p
        found.append(np.stack([(x - left)[ok], (y + right)[ok] - 1, p[ok]], 1))
    found = np.concatenate(found)
    found = found[np.lexsort(found.T[::-1])]
    return found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))] if len(found) else found  # a stretch's smallest period


def runs_of(symbols: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least ``min_length`` symbols and ``exponent`` periods, sorted."""
    factors = Factors(symbols)
    length, place = previous_factors(factors)
    starts = blocks(length)
    rows = _boundary_runs(symbols, factors, starts, exponent)
    rows = rows[rows[:, 1] - rows[:, 0] + 1 >= min_length]
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in rows.tolist():
        buckets.setdefault(s, []).append((e, p))
    if buckets:
        taken = sorted(buckets)
        sizes = np.diff(starts)
        long = np.flatnonzero(sizes >= min_length + 2)  # shorter blocks hold no run strictly inside
        for b, size in zip(starts[long].tolist(), sizes[long].tolist()):
            source = int(place[b])
            shift, last = b - source, source + size - 1
            i = bisect_right(taken, source)
            while i < len(taken) and taken[i] + min_length <= last:  # copies made here may be copied again
                inside = [(e + shift, p) for e, p in buckets[taken[i]] if e < last]
                if inside:
                    if (to := taken[i] + shift) not in buckets:
                        insort(taken, to)
                        buckets[to] = []
                    buckets[to] += inside
                i += 1
    return sorted((s, e, p) for s, found in buckets.items() for e, p in found)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, place of each text's first word): equal words of one text get one number, separators lie between."""
    base, parts, first, at = 0, [[0]], [], 1
    for words in texts:
        first.append(at)
        known: dict[bytes, int] = {}
        ids = [known.setdefault(w, len(known)) for w in words]
        parts.append(np.array([*ids, len(known)], np.int64) + (base + 1))
        base += len(known) + 1
        at += len(words) + 1
    return np.concatenate(parts), np.array(first, np.int64)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        step[s + p] += 1
        step[e + 1] -= 1
    return list(compress(words, (np.cumsum(step[:-1]) == 0).tolist()))


def _find(min_length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in B.pieces(*B.column_bytes(batch.column("text")), limit=PIECE):
                texts = [buf[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(j - i)]  # bytes split at ASCII white space
                symbols, first = numbered(texts)
                own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for s, e, p in runs_of(symbols, min_length, exponent):
                    k = int(np.searchsorted(first, s, "right")) - 1
                    own[k].append((s - int(first[k]), e - int(first[k]), p))
                flat = [(s, e - s + 1, p) for found in own for s, e, p in found]
                fields = [pa.array(list(c), pa.int64()) for c in (zip(*flat) if flat else [[]] * 3)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUN_ARROW)))
                kept = [b" ".join(collapsed(w, r) if r else w) for w, r in zip(texts, own)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(w) for w in texts], pa.int64()), lists, B.strings(kept)], schema=_OUT_ARROW)

    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in that order), text of every row, whole texts.

    A run is a stretch of words with smallest period q, at least ``min_length`` words and ``exponent`` (2 or more)
    periods long, that no neighbouring word extends. ``text`` has the words that no run holds after its first period,
    joined by one blank. Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and an empty text;
    rows repeat as they come; other columns are not read; an empty table gives an empty result. Memory: some 100 bytes
    a word of a piece of 1 MB, or of the longest text, and 4 for each doubling of its longest repeated stretch.
    """
    if exponent < 2 or min_length < 1:
        raise ValueError("runs have at least two periods and one word")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find(min_length, exponent), OUT)
