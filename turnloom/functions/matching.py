"""Comparisons of two short texts that column expressions have no form for: small Arrow functions over pairs of columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rows(left: list[str], right: list[str]):
    """Rows of the table of longest common subsequences, one for each prefix of ``left``."""
    words = np.array(right, dtype=object)
    row = np.zeros(len(right) + 1, np.int32)
    yield row
    for word in left:
        new = np.where(words == word, row[:-1] + 1, row[1:])
        row = np.append(np.int32(0), np.maximum.accumulate(new)) if len(right) else row
        yield row


def common_length(left: list[str], right: list[str]) -> int:
    for row in _rows(left, right):
        pass
    return int(row[-1])


def alignment(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, found from the end; on ties the left word is left out first."""
    table, out, i, j = list(_rows(left, right)), [], len(left), len(right)
    while i and j:
        if left[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def near_verbatim(evidence: list[str], transcript: list[str], ratio: float = 0.82, overlap: float = 0.75, slack: int = 2) -> bool:
    """Whether the evidence's words, three at least, nearly occur as a run of about as many of the transcript's."""
    if not evidence or not transcript:
        return False
    whole, said = " ".join(evidence), " ".join(transcript)
    if whole in said:
        return True
    n, wanted = len(evidence), set(evidence)
    if n < 3:
        return False
    places, full = {}, (1 << len(whole)) - 1
    for k, c in enumerate(whole):
        places[c] = places.get(c, 0) | 1 << k
    least = max(1, n - slack)
    for at in range(len(transcript) - least + 1):
        left, length, met = full, -1, set()  # a bit is cleared for each letter of the longest common subsequence
        for size, word in enumerate(transcript[at : at + n + slack], 1):
            for c in word if size == 1 else " " + word:
                if hit := left & places.get(c, 0):
                    left = ((left + hit) | (left - hit)) & full
            length += len(word) + 1
            if word in wanted:
                met.add(word)
            if size < least:
                continue
            if len(met) >= overlap * len(wanted):
                return True
            # blocks that the matcher finds are a common subsequence, so its ratio is at most this one
            if 2.0 * (len(whole) - left.bit_count()) / (len(whole) + length) >= ratio and SequenceMatcher(None, whole, " ".join(transcript[at : at + size])).ratio() >= ratio:
                return True
    return False


def _each(f, empty, *columns: pd.Series) -> pd.Series:
    return pd.Series([empty if any(v is None for v in row) else f(*(list(v) if not isinstance(v, str) else v for v in row)) for row in zip(*columns)], dtype=object)


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays; 0 where one is null."""
    return F.pandas_udf(lambda a, b: _each(common_length, 0, a, b), "int", F.PandasUDFType.SCALAR)(left, right)


def lcs_alignment(left: Column, right: Column) -> Column:
    """Pairs of places that ``alignment`` finds; for texts of a sentence or so, as it holds the whole table."""
    return F.pandas_udf(lambda a, b: _each(lambda x, y: [{"left": i, "right": j} for i, j in alignment(x, y)], [], a, b), "array<struct<left:int,right:int>>", F.PandasUDFType.SCALAR)(left, right)


def evidence_matches(evidence: Column, transcript: Column) -> Column:
    return F.pandas_udf(lambda a, b: _each(near_verbatim, False, a, b), "boolean", F.PandasUDFType.SCALAR)(evidence, transcript)
