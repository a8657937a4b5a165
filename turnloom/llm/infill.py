"""Fill-in-the-middle form of texts, cut by a sparse checkpoint index.

A text's units are ``[A-Za-z]+|[^A-Za-z]`` over code points. One counting pass over a batch's bytes records, at every
``STEP``-th unit, where it starts in bytes and in code points; no table of all units is kept. A cut after k units is
then found by binary search among the checkpoints and a short rescan from the nearest one before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

#: Units between two checkpoints, and bytes counted at once.
STEP, BLOCK = 64, 1 << 19
#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.ones(256, bool)  # bytes that start a code point
_POINT[0x80:0xC0] = False


def _heads(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """(does a unit start here, does a code point start here) for each byte."""
    letter, point = _LETTER[part], _POINT[part]
    before = np.empty(len(part), bool)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return point & ~(letter & before), point


class Checkpoints:
    """Units and code points of rows laid end to end, with a checkpoint at every ``step``-th unit."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, step: int = STEP, block: int = BLOCK):
        self.buf, self.step = buf, step
        self.row_unit, self.row_point = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
        units = points = 0
        at, places, chars = [], [], []
        for lo in range(0, len(buf), block):
            part = buf[lo : lo + block]
            unit, point = _heads(part, lo > 0 and bool(_LETTER[buf[lo - 1]]))
            i, j = np.searchsorted(offsets, [lo, lo + len(part)])
            first = offsets[i:j] - lo
            unit[first] = True  # a row starts a unit, whatever ends the row before
            unit_sum, point_sum = np.cumsum(unit), np.cumsum(point)
            self.row_unit[i:j], self.row_point[i:j] = units + unit_sum[first] - 1, points + point_sum[first] - 1
            marks = np.searchsorted(unit_sum, np.arange(-units % step, unit_sum[-1], step) + 1)
            at.append(units + unit_sum[marks] - 1)
            places.append(lo + marks)
            chars.append(points + point_sum[marks] - 1)
            units, points = units + int(unit_sum[-1]), points + int(point_sum[-1])
        ends = np.searchsorted(offsets, len(buf))
        self.row_unit[ends:], self.row_point[ends:] = units, points
        none = [np.zeros(0, np.int64)]
        self.at, self.places, self.chars = (np.concatenate(x or none) for x in (at, places, chars))
        self.offsets = offsets

    def units(self) -> np.ndarray:
        """Units of each row."""
        return np.diff(self.row_unit)

    def cut(self, row: int, k: int) -> tuple[int, int]:
        """(byte offset in the buffer, code points from the row's start) of the place after ``k`` units of a row."""
        target = int(self.row_unit[row]) + k
        if target == self.row_unit[row + 1]:
            return int(self.offsets[row + 1]), int(self.row_point[row + 1] - self.row_point[row])
        mark = int(np.searchsorted(self.at, target, "right")) - 1
        unit, place, char = int(self.at[mark]), int(self.places[mark]), int(self.chars[mark])
        if unit < self.row_unit[row]:  # the row starts behind the checkpoint
            unit, place, char = int(self.row_unit[row]), int(self.offsets[row]), int(self.row_point[row])
        end, width = int(self.offsets[row + 1]), 4 * self.step
        while unit < target:  # place is the start of a unit; widths double, since a unit may be long
            head, point = _heads(self.buf[place + 1 : min(end, place + 1 + width)], bool(_LETTER[self.buf[place]]))
            found = np.flatnonzero(head)
            if len(found) == 0:
                char += int(point.sum())
                place += len(head)
            else:
                i = int(found[min(target - unit, len(found)) - 1])
                char += int(point[: i + 1].sum())
                unit += min(target - unit, len(found))
                place += 1 + i
            width *= 2
        return place, char - int(self.row_point[row])


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a document; without an id, those of the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def _marked(buf: np.ndarray, offsets: np.ndarray, markers: list[bytes]) -> np.ndarray:
    """Does each row contain a marker?"""
    raw, out = buf.tobytes(), np.zeros(len(offsets) - 1, bool)
    for m in markers:
        at = raw.find(m)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(m) <= offsets[row + 1]:
                out[row] = True
                at = raw.find(m, int(offsets[row + 1]))
            else:
                at = raw.find(m, at + 1)
    return out


def _transform(seed: str, rate: int, swapped: int, markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offsets in B.pieces(*B.column_bytes(batch.column("text"))):
                index = Checkpoints(buf, offsets)
                counts, plain, rows = index.units().tolist(), _marked(buf, offsets, [p, s, m]).tolist(), []
                for row, doc_id in enumerate(ids.slice(i, j - i).to_pylist()):
                    n, lo, hi = counts[row], int(offsets[row]), int(offsets[row + 1])
                    h1, h2, h3, h4 = draws(doc_id, seed)
                    if n == 0 or plain[row] or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, buf[lo:hi].tobytes()))
                        continue
                    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (a, chars), (b, more) = index.cut(row, one), index.cut(row, two)
                    prefix, middle, suffix = buf[lo:a].tobytes(), buf[a:b].tobytes(), buf[b:hi].tobytes()
                    spm = h4 % 100 < swapped
                    rows.append((n, "spm" if spm else "psm", chars, more - chars, b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))))
                n, form, prefix_chars, middle_chars, output = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), B.strings(output)], schema=_OUT_ARROW)

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, swapped: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row, whole texts.

    Of the texts, ``rate`` percent are cut at two places drawn from the sha256 of ``seed`` and doc_id; of those,
    ``swapped`` percent put the suffix first (form spm, else psm). The rest, empty texts and texts that hold a marker
    stay as they are (form plain, null lengths). A null text counts as empty; rows without a doc_id draw from the seed
    alone, so equal rows get equal cuts; rows repeat as they come; other columns are not read; an empty table gives an
    empty result. Memory: one batch's text, 24 bytes for each ``STEP`` units, and one block's masks.
    """
    if any(not x.isascii() or x[1:].find(x[0]) >= 0 for x in markers) or len(set(markers)) < 3:
        raise ValueError("markers must be three ASCII strings whose first character does not come again")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_transform(seed, rate, swapped, markers), OUT)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. No text that was cut holds a marker, and a marker's first character does not
    come again in it, so the markers found are those that were put in."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
