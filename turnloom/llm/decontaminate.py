"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Normalised text: A-Z lower-cased, words are runs of letters, digits and other than ASCII characters. The patterns are
the items' windows of ``WINDOW`` words (a shorter item is one window), as sequences of word numbers, so matches fall
on whole words. The automaton is built once, on the driver, as three arrays (edges, failure links, output links) and
sent to the executors. A text's words are looked up once; only stretches whose neighbouring words are neighbours in
some item, long enough for the shortest pattern, can hold a match, and these pass through the automaton, many of them
in step. Matches are word numbers, and from there code points, of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B
from turnloom.llm.storage import written

WINDOW = 10
#: Words of items in one automaton; it then has at most ten states of 20 bytes for each. A larger benchmark is cut
#: into parts, one pass over the documents each.
PART_WORDS = 1 << 20
#: Words of a stretch that pass through the automaton as one lane.
LANE = 128

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
#: What one pass knows of a row and hands to the next: items found and runs of hit words.
INTERIM = "doc_id long, text string, items array<string>, spans array<struct<start:long,end:long>>"
_INTERIM_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, word offsets of each row) of normalised words."""
    starts, ends, rows = B.word_spans(buf, offsets, _KEEP)
    return B.segment_hashes(B.LOWER[buf], starts, ends, 0), starts, ends, rows


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key among sorted keys, whether it is one of them)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Automaton:
    """Aho-Corasick over sequences of word numbers; word 0 is any word that no item has.

    State 0 is the root. States are numbered by depth, so edge ``i`` of the sorted edges leads to state ``i + 1``.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.items = [i for i, _ in items]
        sizes = np.array([len(w) for _, w in items], np.int64)
        flat = np.concatenate([np.zeros(0, B.U64), *(w for _, w in items)])
        self.words, ids = np.unique(flat, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        counts = np.maximum(1, sizes - window + 1)
        first = np.cumsum(sizes) - sizes
        start = np.repeat(first, counts) + B.ragged_range(counts)
        item = np.repeat(np.arange(len(items)), counts)
        length = np.minimum(window, sizes)[item]
        self.shortest = int(length.min()) if len(length) else 0
        inner = np.flatnonzero(np.repeat(np.arange(len(items)), sizes)[1:] == np.repeat(np.arange(len(items)), sizes)[:-1]) if len(ids) else np.zeros(0, np.int64)
        self.pairs = np.unique((ids[inner] << 32) | ids[inner + 1])
        levels, keys, state, count = [], [], np.zeros(len(start), np.int64), 1
        for d in range(window):
            on = length > d
            if not on.any():
                break
            distinct, back = np.unique((state[on] << 32) | ids[start[on] + d], return_inverse=True)
            state[on] = count + back
            levels.append((count, count + len(distinct)))
            keys.append(distinct)
            count += len(distinct)
        self.edges = np.concatenate([np.zeros(0, np.int64), *keys])
        self.size = np.zeros(count, np.int32)  # words of the pattern that ends in a state
        self.size[state] = length
        self.fail, self.longer = np.zeros(count, np.int32), np.zeros(count, np.int32)
        for low, high in levels:
            edge = self.edges[low - 1 : high - 1]
            if low > 1:
                self.fail[low:high] = self.step(self.fail[edge >> 32].astype(np.int64), edge & 0xFFFFFFFF)
            up = self.fail[low:high]
            self.longer[low:high] = np.where(self.size[up] > 0, up, self.longer[up])
        owner = np.unique((state << 32) | item)  # items of each pattern's state
        self.owned, self.owner = owner >> 32, owner & 0xFFFFFFFF

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states reached from states by a word each, along failure links where there is no edge."""
        out, left, state = np.zeros(len(state), np.int64), np.arange(len(state)), state.copy()
        while len(left):
            at, ok = _found(self.edges, (state[left] << 32) | word[left])
            out[left[ok]] = at[ok] + 1
            left = left[~ok & (state[left] > 0)]
            state[left] = self.fail[state[left]]
        return out

    def matches(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, state) of every occurrence of a pattern; ``end`` is the number of its last word."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.words) or not len(hashes):
            return nothing
        at, known = _found(self.words, hashes)
        word = np.where(known, at + 1, 0)
        joined = np.zeros(len(word) + 1, bool)  # words i - 1 and i stand side by side in an item
        _, joined[1:-1] = _found(self.pairs, (word[:-1] << 32) | word[1:])
        joined[rows[(rows > 0) & (rows < len(word))]] = False
        head = np.flatnonzero(known & ~joined[:-1])
        tail = np.flatnonzero(known & ~joined[1:]) + 1
        long = tail - head >= self.shortest
        head, tail = head[long], tail[long]
        # Lanes of LANE words; each but the first of a stretch starts as many words early as a pattern may reach back.
        parts = -(-(tail - head) // LANE)
        begin = np.repeat(head, parts) + LANE * B.ragged_range(parts)
        end = np.minimum(begin + LANE, np.repeat(tail, parts))
        back = int(self.size.max()) - 1
        first = np.maximum(begin - back, np.repeat(head, parts))
        order = np.argsort(first - end, kind="stable")  # longest first
        first, begin, end = first[order], begin[order], end[order]
        state, ends, states = np.zeros(len(first), np.int64), [nothing[0]], [nothing[0]]
        for t in range(int((end - first).max()) if len(first) else 0):
            n = int(np.searchsorted(first - end, -t, "left"))  # lanes with a word at step t
            state[:n] = self.step(state[:n], word[first[:n] + t])
            s = np.where(self.size[state[:n]] > 0, state[:n], self.longer[state[:n]])
            hit = np.flatnonzero((s > 0) & (first[:n] + t >= begin[:n]))
            ends.append(first[hit] + t)
            states.append(s[hit])
        ends, states = np.concatenate(ends), np.concatenate(states)
        every = [(ends, states)]
        while len(states):  # shorter patterns that end at the same word
            more = self.longer[states] > 0
            ends, states = ends[more], self.longer[states[more]].astype(np.int64)
            every.append((ends, states))
        return tuple(np.concatenate(x) for x in zip(*every))

    def owners(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into states, item number) of the items that have a state's pattern."""
        low, high = np.searchsorted(self.owned, states, "left"), np.searchsorted(self.owned, states, "right")
        index = np.repeat(np.arange(len(states)), high - low)
        return index, self.owner[np.repeat(low, high - low) + B.ragged_range(high - low)]


def parts(benchmark: DataFrame, window: int, part_words: int = PART_WORDS) -> Iterator[Automaton]:
    """Automata over the benchmark's items, one after another; items come to the driver a part at a time."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        buf = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        words = words_of(buf, np.array([0, len(buf)]))[0]
        if item is None or not len(words):
            continue
        if held and size + len(words) > part_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((str(item), words))
        size += len(words)
    yield Automaton(held, window)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    new = np.flatnonzero(np.append(True, np.diff(hit) > 1)) if len(hit) else np.zeros(0, np.int64)
    return hit[new], hit[np.append(new[1:] - 1, len(hit) - 1)] if len(hit) else hit


def _judged(a: Automaton, buf: np.ndarray, offsets: np.ndarray, before):
    """For each row: (words, words hit, items, spans); ``before`` gives (items, spans) of earlier parts for a row."""
    hashes, starts, ends, rows = words_of(buf, offsets)
    last, state = a.matches(hashes, rows)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, last - a.size[state] + 1, 1)
    np.add.at(edge, last + 1, -1)
    hit = np.cumsum(edge[:-1]) > 0
    index, item = a.owners(state)
    pairs = np.unique(((np.searchsorted(rows, last[index], "right") - 1) << 32) | item)
    row_of, item = pairs >> 32, pairs & 0xFFFFFFFF
    cut = np.searchsorted(row_of, np.arange(len(rows)))
    total = np.append(0, np.cumsum(hit))
    for i in range(len(rows) - 1):
        n, (items, spans) = int(rows[i + 1] - rows[i]), before(i)
        if not spans and total[rows[i + 1]] == total[rows[i]]:
            yield n, 0, [], []
            continue
        low, high = rows[i], rows[i + 1]
        mine = hit[low:high].copy()
        raw = buf[offsets[i] : offsets[i + 1]]
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        s, e = chars[starts[low:high] - offsets[i]], chars[ends[low:high] - offsets[i]]
        for span in spans or ():
            mine |= (s >= span["start"]) & (e <= span["end"])
        f, t = _runs(np.flatnonzero(mine))
        found = sorted({*(items or ()), *(a.items[k] for k in item[cut[i] : cut[i + 1]])})
        yield n, int(mine.sum()), found, [{"start": int(x), "end": int(y)} for x, y in zip(s[f], e[t])]


def _scan(sent, final: bool):
    def scan(batches):
        a, nothing = sent.value, hashlib.sha256(b"").hexdigest()
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            earlier = "items" in batch.schema.names
            out = []
            for i, _, b, o in B.pieces(buf, offsets):
                before = (lambda k, i=i: (batch.column("items")[i + k].as_py(), batch.column("spans")[i + k].as_py())) if earlier else (lambda k: ((), ()))
                out += _judged(a, b, o, before)
            n, hit, items, spans = (list(x) for x in zip(*out)) if out else ([], [], [], [])
            if not final:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(items, _INTERIM_ARROW.field("items").type), pa.array(spans, pa.list_(_SPAN))], schema=_INTERIM_ARROW)
                continue
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))], schema=_OUT_ARROW)

    return scan


def _clean(sent):
    def clean(batches):
        a = sent.value
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            for i, _, b, o in B.pieces(buf, offsets):
                hashes, _, _, rows = words_of(b, o)
                last, _ = a.matches(hashes, rows)
                keep[i + np.searchsorted(rows, last, "right") - 1] = False
            yield batch.filter(pa.array(keep, pa.bool_()))

    return clean


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Which documents hold windows of benchmark items, and where.

    Takes doc_id, text and item_id, text. Returns one row for each document row: doc_id, n_words, n_hit (words
    inside any occurrence of a window), n_items, items_sha256, contaminated, items (ids as strings, sorted) and
    spans in code points. The benchmark is the stated query set: its items pass through the driver, at most
    ``part_words`` words at a time; an automaton over more would be cut into parts, each one pass over the documents
    with a written table in between. Words are compared by 64-bit hashes.

    A null or empty text has no words and no hits. Items with a null id or without words are ignored; rows that
    repeat an item id are one item. Empty tables give no rows or no hits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    held = None
    for automaton in parts(benchmark, window, part_words):
        if held is not None:
            rows = written(rows.mapInArrow(_scan(context.broadcast(held), False), INTERIM), "leaks")
        held = automaton
    return rows.mapInArrow(_scan(context.broadcast(held), True), OUT)


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of a benchmark item; see ``find_leaks``."""
    context, held = docs.sparkSession.sparkContext, None
    for automaton in parts(benchmark, window, part_words):
        if held is not None:
            docs = written(docs.mapInArrow(_clean(context.broadcast(held)), docs.schema), "clean")
        held = automaton
    return docs.mapInArrow(_clean(context.broadcast(held)), docs.schema)
