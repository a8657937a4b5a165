"""Sentences out of timed words: from growing windows with an unstable tail, and from whole transcripts by their timestamps.

A window is what a recogniser heard up to a moment. A sentence is committed when its last word ends it, another word
follows and the window reaches well past it; the next window counts from behind the committed words only. ``step`` moves
the few numbers that a session keeps, so ``stable`` runs over sorted windows as a stream and
``turnloom.streaming.sentences`` keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What ends a sentence, which quotes and brackets may follow it, what attaches to the word before.
STRONG, CLOSING, ATTACHING = (".", "?", "!", "…"), "\"')]}", ".,?!;:%)]}…"


@dataclass(frozen=True)
class Limits:
    """Fixed values in milliseconds: unstable tail, padding of sentences, share of a short gap, least window and least advance."""

    tail: int = 1350
    before: int = 60
    after: int = 90
    gap_share: float = 0.6
    least_window: int = 1000
    least_advance: int = 0


@dataclass
class State:
    left: int = 0  # ms; all before it is committed
    last_right: int = -1
    ended: bool = True  # did the last sentence end with a strong mark?
    count: int = 0


Word = tuple[str, int, int]  # text, start, end in ms


def ends_sentence(text: str) -> bool:
    return text.strip().rstrip(CLOSING).endswith(STRONG)


def joined(words: list[str]) -> str:
    """Words with one blank between them, none before punctuation that attaches to the word before."""
    out = ""
    for w in words:
        out += w if not out or w[0] in ATTACHING else f" {w}"
    return out


def capitalised(text: str) -> str:
    """The first letter in upper case, unless the one after it is (iPhone)."""
    for i, c in enumerate(text):
        if c.isalpha():
            return text if not c.islower() or text[i + 1 : i + 2].isupper() else text[:i] + c.upper() + text[i + 1 :]
    return text


def boundary(left: int, right: int, end: int, following: int | None, limits: Limits) -> tuple[int, str]:
    """Where a sentence whose last word ends at ``end`` is cut from the word that starts at ``following``, and by which rule."""
    if following is None:
        cut, rule = end + limits.after, "final_post_padding"
    elif following <= end:
        cut, rule = end, "overlap_last_word_end"
    elif end + limits.after > following - limits.before:
        cut, rule = int(end + (following - end) * limits.gap_share), "gap_ratio"
    else:
        cut, rule = min(end + limits.after, following - limits.before), "post_padding"
    return max(left, min(right, cut)), rule


def step(state: State, right: int, flush: bool, words: list[Word], limits: Limits) -> list[tuple]:
    """Sentences that a window commits, as values of COLUMNS, and the state moved by it."""
    if not flush and (right - state.left < limits.least_window or right <= state.last_right + limits.least_advance):
        return []
    state.last_right = max(state.last_right, right)
    words = sorted(((" ".join(t.split()), s, e) for t, s, e in words if t and t.split() and s + e >= 2 * state.left), key=lambda w: (w[1], w[2]))
    out, first, window_left = [], 0, state.left
    for k, (text, start, end) in enumerate(words):
        following = words[k + 1] if k + 1 < len(words) else None
        if following is not None and following[0][0] in ATTACHING:
            continue  # the mark that follows belongs to this word
        if not ends_sentence(joined([w[0] for w in words[first : k + 1]][-2:])) and not (flush and following is None):
            continue
        if not flush and (following is None or right - end < limits.tail):
            break
        part = words[first : k + 1]
        cut, rule = boundary(state.left, right, end, following and following[1], limits)
        clip = max(state.left, min(right, part[0][1] - limits.before))
        first = k + 1
        if cut <= clip:
            continue
        text = joined([w[0] for w in part])
        text = capitalised(text) if state.ended else text
        out.append((state.count, text, clip, cut, part[0][1], end, following and following[1], len(part), sum(max(0, e - s) for _, s, e in part), rule, window_left, right))
        state.left, state.ended, state.count = cut, ends_sentence(text), state.count + 1
    return out


COLUMNS = "sentence int, text string, start_ms long, end_ms long, first_word_ms long, last_word_ms long, next_word_ms long, words int, spoken_ms long, rule string, left_ms long, right_ms long"


def moved(state: State, right, flush, words, limits: Limits) -> list[tuple]:
    """``step`` on values of a row; words without text or times don't count."""
    if right is None:
        return []
    return step(state, right, bool(flush), [(w["text"], w["start_ms"], w["end_ms"]) for w in words if w is not None and None not in (w["text"], w["start_ms"], w["end_ms"])] if words is not None else [], limits)


def stable(windows: DataFrame, session: str, limits: Limits = Limits()) -> DataFrame:
    """(session, COLUMNS): the sentences that the windows of each session commit.

    ``windows``: session, right_ms, flush (null: false), words (text, start_ms, end_ms), in the order of right_ms, a flush
    after another window of the same moment. Windows without right_ms don't count; rows of a null session are one session.
    A session is read as a stream by one task, which holds one batch and the state of one session.
    """
    out = StructType([windows.schema[session], *StructType.fromDDL(COLUMNS)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), State()
        for batch in batches:
            found = []
            for key, right, flush, words in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key,):
                    now, state = (key,), State()
                found += [(key, *row) for row in moved(state, right, flush, words, limits)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    rows = windows.select(F.col(session).alias("_session"), F.col("right_ms").cast("long").alias("_right"), F.coalesce("flush", F.lit(False)).alias("_flush"), F.col("words").alias("_words"))
    return rows.repartition("_session").sortWithinPartitions("_session", "_right", "_flush", "_words").mapInArrow(run, out)


#: Marks that end a word's sentence, and those of a soft pause, with what may close after them.
SENTENCE_END, SOFT_END = r"""[.!?]+["')\]]*$""", r"""[,;:]+["')\]]*$"""


def timed_words(words: Column, duration_ms: Column, most_ms: int | None = None) -> Column:
    """Words (text, start_ms, end_ms) inside [0, duration_ms], in order, without empty ones; none lasts longer than
    ``most_ms`` or, with that, into the next."""
    inside = F.transform(words, lambda w: F.struct(F.least(F.greatest(w["start_ms"], F.lit(0)), duration_ms).alias("start_ms"), F.least(F.greatest(w["end_ms"], F.lit(0)), duration_ms).alias("end_ms"), w["text"].alias("text")))
    kept = F.array_sort(F.filter(inside, lambda w: (F.trim(w["text"]) != "") & (w["end_ms"] > w["start_ms"])))
    if not most_ms:
        return kept

    starts = F.transform(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda w: w["start_ms"])

    def capped(z: Column) -> Column:
        w, following = z["w"], z["n"]
        most = F.least(w["start_ms"] + most_ms, F.when(following > w["start_ms"], following))
        return F.struct(w["start_ms"].alias("start_ms"), F.least(w["end_ms"], most).alias("end_ms"), w["text"].alias("text"))

    return F.transform(F.arrays_zip(kept.alias("w"), starts.alias("n")), capped)


def word_groups(words: Column, soft: bool = False, gap_ms: int = 0, most_ms: int = 0, least_words: int = 1) -> Column:
    """(first, last, reason) of each group of ``timed_words``, places from 1: after the end of a sentence; with ``soft``
    after a soft mark; with ``most_ms`` when a group has lasted so long, all from ``least_words`` words on; with ``gap_ms``
    before a word that starts so late. Null without words."""
    group = "array<struct<first:int,last:int,reason:string>>"
    start = F.struct(F.array().cast(group).alias("groups"), F.lit(1).alias("first"))

    def closed(s: Column, last: Column, reason: Column) -> Column:
        new = F.concat(s["groups"], F.array(F.struct(s["first"].alias("first"), last.alias("last"), reason.alias("reason"))))
        return F.struct(new.alias("groups"), (last + 1).alias("first"))

    def after(s: Column, i: Column) -> Column:
        w, first = F.get(words, i - 1), F.get(words, s["first"] - 1)
        text = F.trim(w["text"])
        reason = F.when(text.rlike(SENTENCE_END), "sentence")
        reason = reason.when(text.rlike(SOFT_END), "punctuation") if soft else reason
        reason = reason.when(w["end_ms"] - first["start_ms"] >= most_ms, "max_duration") if most_ms > 0 else reason
        due = (i - s["first"] + 1 >= least_words) & reason.isNotNull()
        return F.when(due, closed(s, i, reason)).otherwise(s)

    def moved_by(s: Column, i: Column) -> Column:
        if gap_ms <= 0:
            return after(s, i)
        late = (s["first"] < i) & (F.get(words, i - 1)["start_ms"] - F.get(words, i - 2)["end_ms"] >= gap_ms)
        before = F.when(late, closed(s, i - 1, F.lit("gap"))).otherwise(s)
        return F.get(F.transform(F.array(before), lambda x: after(x, i)), 0)

    n = F.size(words)
    end = lambda s: F.when(s["first"] <= n, closed(s, n, F.lit("final"))["groups"]).otherwise(s["groups"])
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, moved_by, end))


def transcript_parts(finals: DataFrame, keys: list[str], most_word_ms: int | None = None, soft: bool = False, gap_ms: int = 0, most_ms: int = 0, least_words: int = 1, limits: Limits = Limits()) -> DataFrame:
    """(keys, part, text, start_ms, end_ms, first_word_ms, last_word_ms, words, reason): the parts of each final transcript.

    ``finals``: keys, duration_ms, words. A part reaches from a little before its first word to a little behind its last,
    at most to the boundary with its neighbours; a part whose bounds are empty is left out. The options are those of
    ``word_groups``. A final without usable words has no parts.
    """
    named = finals.select(*keys, F.col("duration_ms").alias("_d"), timed_words(F.col("words"), F.col("duration_ms"), most_word_ms).alias("_w"))
    named = named.filter("size(_w) > 0")
    rows = named.select(*keys, "_d", "_w", F.posexplode(word_groups(F.col("_w"), soft, gap_ms, most_ms, least_words)).alias("part", "_g"))
    word = lambda place: F.get("_w", place - 1)
    first, last = word(F.col("_g.first"))["start_ms"], word(F.col("_g.last"))["end_ms"]
    before, following = F.get("_w", F.col("_g.first") - 2)["end_ms"], F.get("_w", F.col("_g.last"))["start_ms"]

    def cut(end: Column, next_: Column) -> Column:
        shared = F.floor(end + (next_ - end) * F.lit(limits.gap_share)).cast("long")
        return F.when(next_ <= end, end).when(end + limits.after > next_ - limits.before, shared).otherwise(F.least(end + limits.after, next_ - limits.before))

    start = F.greatest(F.when(before.isNotNull(), cut(before, first)).otherwise(F.lit(0)), first - limits.before)
    end = F.when(following.isNotNull(), cut(last, following)).otherwise(last + limits.after)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.col("_d"))
    told = rows.select(*keys, "part", F.transform(F.slice("_w", F.col("_g.first"), F.col("_g.last") - F.col("_g.first") + 1), lambda w: F.trim(w["text"])).alias("_t"), clamp(start).alias("start_ms"), clamp(end).alias("end_ms"), first.alias("first_word_ms"), last.alias("last_word_ms"), F.col("_g.reason").alias("reason"))
    text = F.regexp_replace(F.trim(F.regexp_replace(F.array_join("_t", " "), r"\s+", " ")), r"\s+([,.;:!?])", "$1")
    return told.filter("end_ms > start_ms").select(*keys, "part", text.alias("text"), "start_ms", "end_ms", "first_word_ms", "last_word_ms", F.size("_t").alias("words"), "reason")
