"""Alignment of two long word sequences in bounded memory.

A row of the table of longest common subsequences is one integer: bit j is 0 where the row grows at column j. A word
moves the row by a few operations on that integer, so a session of 50,000 words takes seconds. The pairs are found
from the end; only every ``stride``-th row is kept, and the rows between two kept ones are made again when the way
back comes to them, so memory is about 2 * sqrt(n) rows of m bits.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from math import isqrt

import numpy as np

#: Bytes of word masks that are kept; the masks of rarer words are made when they are needed.
MASK_BYTES = 1 << 26


class Masks:
    """For each word the places where it stands in a sequence, as the bits of an integer."""

    def __init__(self, words: Sequence[Hashable], keep_bytes: int = MASK_BYTES):
        self.size, self.places, self.kept = len(words), {}, {}
        self.left = keep_bytes
        for i, w in enumerate(words):
            self.places.setdefault(w, []).append(i)

    def __getitem__(self, word: Hashable) -> int:
        found = self.kept.get(word)
        if found is None:
            places = self.places.get(word)
            if places is None:
                return 0
            bits = np.zeros(places[-1] + 1, bool)
            bits[places] = True
            found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if self.left > 0:
                self.kept[word] = found
                self.left -= places[-1] // 8 + 64
        return found


def _moved(row: int, mask: int, full: int) -> int:
    hit = row & mask
    return ((row + hit) | (row - hit)) & full


def common_length(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence."""
    masks = Masks(right)
    row = full = (1 << len(right)) - 1
    for w in left:
        row = _moved(row, masks[w], full)
    return len(right) - row.bit_count()


def common_places(left: Sequence[Hashable], right: Sequence[Hashable], stride: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, found from the end; on ties the left word is left out first."""
    masks, i, j = Masks(right), len(left), len(right)
    row = full = (1 << j) - 1
    stride = stride or isqrt(i) + 1
    kept = []
    for k, w in enumerate(left):
        if k % stride == 0:
            kept.append(row)
        row = _moved(row, masks[w], full)
    out = []
    while i and j:
        first = (i - 1) // stride * stride  # rows first .. i - 1, those before each of the words first .. i - 1
        rows = [kept.pop()]
        for w in left[first : i - 1]:
            rows.append(_moved(rows[-1], masks[w], full))
        while i > first and j:
            word, above = left[i - 1], rows[i - 1 - first]
            length = j - (row & ((1 << j) - 1)).bit_count()
            longest = j - (above & ((1 << j) - 1)).bit_count()
            while j and right[j - 1] != word and longest < length:
                j -= 1
                longest -= 1 - (above >> j & 1)
            if not j:
                break
            if right[j - 1] == word:
                j -= 1
                out.append((i - 1, j))
            i -= 1
            row = above
    return out[::-1]
