"""Byte-level text kernels for Arrow batches.

A text column is handled as one UTF-8 byte buffer with row offsets, so words, lines and their hashes come from a
few numpy passes instead of a Python loop per word. Nulls count as empty texts. Working memory stays near one
block (``BLOCK`` bytes) plus a few numbers per word, whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once.
BLOCK = 1 << 19
#: Bytes of text taken together by ``pieces``.
PIECE = 1 << 21

_RNG = np.random.default_rng(20240607)
#: Random value of each byte and odd multiplier, for each of two independent hash lanes.
_BYTE = _RNG.integers(0, 1 << 63, size=(2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_WORD = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_MASK = (1 << 64) - 1

#: ASCII white space: space and \t \n \v \f \r.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table asked for is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(n, base, U64)
        out[:1] = 1
        have = _powers[base] = np.cumprod(out, dtype=U64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]], nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):  # combine_chunks of no chunks
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(parts: list[bytes]) -> pa.Array:
    """A string column of UTF-8 byte strings."""
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))


def pieces(buf: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows in runs of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word_offsets): words are runs of word bytes inside one row; row i has words word_offsets[i]:word_offsets[i+1]."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    head = w.copy()
    head[1:] &= ~w[:-1] | edge[1:n]
    tail = w.copy()
    tail[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, line_offsets) of each row split at \\n; an empty row is one empty line."""
    at = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], at + 1]), kind="stable")
    ends = np.sort(np.concatenate([at, offsets[1:]]), kind="stable")
    return starts, ends, np.searchsorted(at, offsets) + np.arange(len(offsets))


def stripped(starts: np.ndarray, ends: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line spans without white space at either end; a line without words becomes empty at its start."""
    if not len(word_starts):
        return starts, starts.copy()
    i = np.searchsorted(word_starts, starts)
    j = np.searchsorted(word_ends, ends, "right") - 1
    some = (i < len(word_starts)) & (j >= i)
    s = np.where(some, word_starts[np.minimum(i, len(word_starts) - 1)], starts)
    e = np.where(some, word_ends[np.maximum(j, 0)], starts)
    return s, e


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each segment's bytes; starts and ends ascend."""
    base, table = _BASE[lane], _BYTE[lane]
    inv = inverse(base)
    out = np.zeros(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j <= i:  # one segment longer than a block
            acc, hi = 0, int(ends[i])
            for k in range(lo, hi, BLOCK):
                part = table[buf[k : min(hi, k + BLOCK)]]
                part *= powers(base, BLOCK)[: len(part)]
                acc = (acc + int(part.sum(dtype=U64)) * pow(base, k - lo, 1 << 64)) & _MASK
            out[i] = acc
            i += 1
            continue
        hi = int(ends[j - 1])
        b = np.zeros(hi - lo + 1, U64)
        np.multiply(table[buf[lo:hi]], powers(base, BLOCK)[: hi - lo], out=b[1:])
        np.cumsum(b, out=b)
        s = starts[i:j] - lo
        out[i:j] = (b[ends[i:j] - lo] - b[s]) * powers(inv, BLOCK + 1)[s]
        i = j
    out ^= (ends - starts).astype(U64) * U64(_WORD[lane])
    return mix(out)


def run_hashes(words: np.ndarray, at: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """64-bit hash of the ``width`` word hashes from each position in ``at``."""
    out = np.zeros(len(at), U64)
    m = _WORD[lane]
    for k in range(width):
        out += words[at + k] * U64(pow(m, k + 1, 1 << 64))
    return mix(out)


def window_starts(word_offsets: np.ndarray, width: int) -> np.ndarray:
    """Word positions at which a whole window of ``width`` words of one row starts."""
    counts = np.diff(word_offsets)
    n = int(word_offsets[-1])
    ok = np.ones(n, bool)
    late = np.minimum(counts, width - 1)
    tail = np.repeat(word_offsets[1:] - late, late) + ragged_range(late)
    ok[tail] = False
    return np.flatnonzero(ok)


def ragged_range(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ..."""
    total = int(counts.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(counts) - counts, counts)
