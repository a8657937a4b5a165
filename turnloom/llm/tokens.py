"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are split into pre-tokens with the vocabulary's pattern. The distinct pre-tokens of a batch are laid out as
one ragged numpy array of symbols; in each round every sequence finds its lowest-rank pair of neighbours and merges
all its occurrences at once, left to right, until no sequence has a mergeable pair. The symbols that survive are
the tokens. A pre-token of ``LONG`` bytes or more would need a pass over all its symbols in each of many rounds; its
rounds take the same steps in the same order, but find the places of the lowest rank by rank, so the work follows the
merges. Counts of pre-tokens are kept between batches up to ``MEMO`` entries and ``MEMO_CHARS`` characters.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker keeps.
MEMO, MEMO_CHARS = 1 << 18, 1 << 24
#: Bytes from which a pre-token is merged alone.
LONG = 1 << 10
#: Characters of distinct pre-tokens merged together.
ROUND_CHARS = 1 << 20

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A vocabulary's merges as sorted arrays."""

    def __init__(self, description: dict):
        model = description["model"]
        if model["type"] != "BPE" or description.get("normalizer") or description["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(left * self.base + right, return_index=True)
        self.keys, self.rank, self.into = keys, first.astype(np.int64), into[first]
        self.byte = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.special = sorted((t["content"] for t in description.get("added_tokens", [])), key=len, reverse=True)

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, or -1."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def count_long(self, part: bytes) -> int:
        """Tokens of one long byte string: round by round the places of the lowest rank, left to right."""
        symbols = self.byte[np.frombuffer(part, np.uint8)]
        n = len(symbols)
        found = self.ranks(symbols[:-1] * self.base + symbols[1:])
        symbols, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}  # by rank
        index = {}
        for i in np.flatnonzero(found >= 0).tolist():
            rank = int(self.rank[found[i]])
            index[rank] = int(found[i])
            places.setdefault(rank, []).append(i)
        ranks, left = list(places), n
        heapq.heapify(ranks)
        known = {}  # merge of each pair of symbols met, or -1
        while ranks:
            rank = heapq.heappop(ranks)
            merge = index[rank]
            key, into = int(self.keys[merge]), int(self.into[merge])
            for i in sorted(places.pop(rank)):
                j = after[i]
                if j >= n or symbols[i] < 0 or symbols[i] * self.base + symbols[j] != key:
                    continue
                k = after[j]
                symbols[i], symbols[j], after[i] = into, -1, k
                left -= 1
                if k < n:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a < 0 or b >= n:
                        continue
                    pair = symbols[a] * self.base + symbols[b]
                    if pair not in known:
                        at = int(np.searchsorted(self.keys, pair))
                        known[pair] = at if at < len(self.keys) and int(self.keys[at]) == pair else -1
                    at = known[pair]
                    if at >= 0:
                        r = int(self.rank[at])
                        if r not in places:
                            places[r], index[r] = [], at
                            heapq.heappush(ranks, r)
                        places[r].append(a)
        return left

    def counts(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each byte string."""
        long = [i for i, p in enumerate(parts) if len(p) >= LONG]
        if long:
            out = self.counts([b"" if len(p) >= LONG else p for p in parts])
            out[long] = [self.count_long(parts[i]) for i in long]
            return out
        sizes = np.array([len(p) for p in parts], np.int64)
        symbols = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        owner = np.repeat(np.arange(len(parts)), sizes)
        total = np.zeros(len(parts), np.int64)
        none = len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            done = least == none
            if done.any():  # these sequences have all their tokens
                total[owner[first[done]]] = lengths[done]
                stay = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                at, least, lengths = np.append(at, 0)[stay], least[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            start = np.append(True, np.diff(hit) > 1)  # of neighbouring pairs, which overlap, every other one merges
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[run % 2 == 0]
            symbols[hit] = self.into[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return total


def counter(merges: Merges, pattern: str = PATTERN):
    """A function from texts to their token counts, with its own bounded memory of pre-tokens."""
    find = regex.compile(pattern).findall
    special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
    memo: dict[str, int] = {}
    held = [0]  # characters of the keys of memo

    def learn(new: set[str]) -> None:
        part, size = [], 0
        for token in sorted(new, key=len):
            part.append(token)
            size += len(token)
            if size >= ROUND_CHARS:
                memo.update(zip(part, merges.counts([t.encode("utf-8", "replace") for t in part]).tolist()))
                part, size = [], 0
        if part:
            memo.update(zip(part, merges.counts([t.encode("utf-8", "replace") for t in part]).tolist()))

    def count(texts: list[str]) -> list[int]:
        """Texts are taken together, so that their new pre-tokens share the rounds of merging."""
        out, tokens = [0] * len(texts), []
        for i, text in enumerate(texts):
            stretches = [text]
            if special is not None and any(s in text for s in merges.special):
                cut = special.split(text)
                stretches = cut[::2]
                out[i] = len(cut) // 2
            tokens += [(i, find(s)) for s in stretches]
        new = set().union(*(t for _, t in tokens)).difference(memo)
        if len(memo) + len(new) > MEMO or held[0] > MEMO_CHARS:
            memo.clear()
            held[0] = 0
            new = set().union(*(t for _, t in tokens))
        held[0] += sum(map(len, new))
        learn(new)
        for i, t in tokens:
            out[i] += sum(map(memo.__getitem__, t))
        return out

    return count


def _count(sent, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value)
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            n = [x for i, j, b, o in B.pieces(buf, offsets) for x in count([b[o[k] : o[k + 1]].tobytes().decode("utf-8", "replace") for k in range(j - i)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=_OUT_ARROW)

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row, whole texts.

    ``vocabulary`` is the path of a byte-level BPE description (JSON), read once on the driver. Its special
    strings inside a text count as one token each. A null or empty text has 0 bytes and 0 tokens; rows repeat as
    they come; an empty table gives an empty result.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(Merges(json.load(f)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count(sent, limit), OUT)
