"""Whole-session text alignment: live rows against a reference transcript, and the report of a trace.

A session's words are aligned as one sequence, so its rows are read by one task, the transcript's first, then the live
ones, both in order; the task holds the words of one session and the bounded table of ``functions.alignment``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnloom.functions import alignment as A
from turnloom.functions import text as T
from turnloom.functions.numbers import quantized
from turnloom.operators import intervals

#: Least shares of a row's words, and least score of a similar text, that give the row a speaker; weight of the sequence ratio.
LEAST_SHARE, LEAST_SCORE, RATIO = 0.34, 0.45, 0.65
#: Output rows in one batch.
ROWS = 1 << 13

Row = tuple[int, str | None, bool, list[str]]  # place, label, flag, words


def _sessions(rows: DataFrame, others: DataFrame, session: str, columns: str, make: Callable[[list[Row], list[Row]], Iterable[tuple]]) -> DataFrame:
    """(session, columns): what ``make`` gives for the rows and the other rows of each session; both have (session, place,
    label, flag, text). Sessions without rows are not asked for."""
    out = StructType([rows.schema[session], *StructType.fromDDL(columns)])
    schema = to_arrow_schema(out)

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(F.col(session).alias("_session"), F.lit(number).alias("_side"), F.col("place").cast("long").alias("_place"), F.col("label").cast("string").alias("_label"), F.col("flag").alias("_flag"), F.coalesce(T.text_tokens(F.col("text")), F.array().cast("array<string>")).alias("_words"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, sides = (), ([], [])
        for batch in batches:
            for session_id, number, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (session_id,):
                    if key and sides[1]:
                        yield from ((*key, *r) for r in make(sides[1], sides[0]))
                    key, sides = (session_id,), ([], [])
                sides[number].append(tuple(row))
        if key and sides[1]:
            yield from ((*key, *r) for r in make(sides[1], sides[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in found(batches):
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    both = side(others, 0).unionByName(side(rows, 1))
    # Not by _session itself: where both tables are dealt by it, Spark leaves that shuffle out and merges the partitions
    # of each table by its own sizes, so that the sides of a session may part.
    return both.repartition(F.xxhash64("_session")).sortWithinPartitions("_session", "_side", "_place", "_label", "_words").mapInArrow(run, out)


def _flat(rows: list[Row]) -> tuple[list[str], list[tuple[int, int]]]:
    """All words, and (row, place in the row) of each."""
    return [w for *_, words in rows for w in words], [(k, i) for k, (*_, words) in enumerate(rows) for i in range(len(words))]


def _plain(df: DataFrame, session: str, place: str, label: str | None = None, flag=None) -> DataFrame:
    return df.select(session, F.col(place).alias("place"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), (F.lit(True) if flag is None else flag).alias("flag"), "text")


def session_alignment(rows: DataFrame, others: DataFrame, session: str, place: str) -> DataFrame:
    """(session, place, word, other, other_word): words of ``rows`` aligned with those of ``others`` in the session.

    A longest common subsequence of all words of the session, rows in order of ``place``; found from the end, and on
    ties the word of ``rows`` is left out first. Null texts have no words; rows of a null session are one session.
    """

    def make(left: list[Row], right: list[Row]) -> Iterator[tuple]:
        (a, at), (b, to) = _flat(left), _flat(right)
        for i, j in A.common_places(a, b):
            yield left[at[i][0]][0], at[i][1], right[to[j][0]][0], to[j][1]

    return _sessions(_plain(rows, session, place), _plain(others, session, place), session, f"{place} long, word int, other long, other_word int", make)


def common_words(rows: DataFrame, others: DataFrame, session: str, place: str) -> DataFrame:
    """(session, words, other_words, common) of each session of ``rows``: sizes, and length of the longest common subsequence."""

    def make(left: list[Row], right: list[Row]) -> Iterator[tuple]:
        a, b = _flat(left)[0], _flat(right)[0]
        yield len(a), len(b), A.common_length(a, b)

    return _sessions(_plain(rows, session, place), _plain(others, session, place), session, "words long, other_words long, common long", make)


class Similar:
    """Rows to find the most similar text in. Each is compared letter by letter only if it can still win: the sequence
    ratio is at most the share of letters that both texts have, whatever their order."""

    def __init__(self, rows: list[Row]):
        self.first: dict[str, int] = {}
        self.rows = rows
        for k, (*_, words) in enumerate(rows):
            if words:
                self.first.setdefault(" ".join(words), k)
        self.texts = list(self.first)
        self.letters = {c: i for i, c in enumerate(sorted(set().union(*self.texts)))}
        self.counts = np.zeros((len(self.texts), len(self.letters)), np.int32)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        holders: dict[str, list[int]] = {}
        self.words = np.zeros(len(self.texts), np.int64)
        for k, t in enumerate(self.texts):
            for c, n in Counter(t).items():
                self.counts[k, self.letters[c]] = n
            own = set(t.split(" "))
            self.words[k] = len(own)
            for w in own:
                holders.setdefault(w, []).append(k)
        self.holders = {w: np.array(k) for w, k in holders.items()}
        self.matchers: dict[int, SequenceMatcher] = {}

    def best(self, words: list[str]) -> tuple[float, Row | None]:
        """(score, row) of the most similar row, the first of equals; no row where no score is above 0."""
        if not words or not self.texts:
            return 0.0, None
        text, own = " ".join(words), set(words)
        mine = np.zeros(len(self.letters), np.int32)
        for c, n in Counter(text).items():
            if c in self.letters:
                mine[self.letters[c]] = n
        shared = np.zeros(len(self.texts), np.int64)
        for w in own & self.holders.keys():
            shared[self.holders[w]] += 1
        jaccard = shared / (len(own) + self.words - shared)
        most = RATIO * 2.0 * np.minimum(self.counts, mine).sum(1) / (len(text) + self.sizes) + (1 - RATIO) * jaccard
        score, at = 0.0, None
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < score - 1e-9:
                break
            exact = RATIO * self._ratio(text, k) + (1 - RATIO) * float(jaccard[k])
            row = self.first[self.texts[k]]
            if exact > score or (exact == score and at is not None and row < at):
                score, at = exact, row
        return score, None if at is None else self.rows[at]

    def _ratio(self, text: str, k: int) -> float:
        if text == self.texts[k]:
            return 1.0
        matcher = self.matchers.get(k)
        if matcher is None:
            if len(self.matchers) == 1024:
                self.matchers.clear()
            matcher = self.matchers[k] = SequenceMatcher(None, "", self.texts[k])
        matcher.set_seq1(text)
        return matcher.ratio()


def best_texts(rows: DataFrame, others: DataFrame, session: str, place: str) -> DataFrame:
    """(session, place, other, score) for each of ``rows`` with words: of all other rows of the session the one with most
    0.65 sequence ratio + 0.35 token Jaccard, the first of equals; rows without any score above 0 are left out."""

    def make(left: list[Row], right: list[Row]) -> Iterator[tuple]:
        similar = Similar(right)
        for at, _, _, words in left:
            score, row = similar.best(words)
            if row is not None:
                yield at, row[0], score

    return _sessions(_plain(rows, session, place), _plain(others, session, place), session, f"{place} long, other long, score double", make)


_MATCHES = "place long, n_words long, lcs_speaker string, lcs_share double, lcs_words long, similar_speaker string, similar_score double"


def text_matches(rows: DataFrame, others: DataFrame, session: str, fuzzy: bool) -> DataFrame:
    """(session, place, n_words, lcs_speaker, lcs_share, lcs_words, similar_speaker, similar_score) of each row.

    ``lcs_speaker``: whose words most of the row's words are aligned with, the first met of equals; ``lcs_share`` of the
    row's words. With ``fuzzy``, flagged rows whose share is below LEAST_SHARE look for the most similar row too.
    """

    def make(left: list[Row], right: list[Row]) -> Iterator[tuple]:
        named = [r for r in right if r[1]]
        (a, at), (b, to) = _flat(left), _flat(named)
        votes: dict[int, Counter] = {}
        for i, j in A.common_places(a, b):
            votes.setdefault(at[i][0], Counter())[named[to[j][0]][1]] += 1
        similar = None
        for k, (place, _, flag, words) in enumerate(left):
            speaker = share = score = other = None
            if k in votes:
                speaker, n = votes[k].most_common(1)[0]
                share = n / len(words)
            if fuzzy and flag and (share or 0.0) < LEAST_SHARE:
                similar = similar or Similar(right)
                score, row = similar.best(words)
                other = row and row[1]
            yield place, len(words), speaker, share, votes[k].total() if k in votes else 0, other, score

    return _sessions(rows, others, session, _MATCHES, make)


def trace_rows(live: DataFrame, truth: DataFrame, session: str, place: str, mode: str = "auto", fuzzy: bool = True, bucket_ms: int = 60_000) -> DataFrame:
    """The true speaker of each live row and how it was found.

    ``live``: session, place (unique in it), text, assigned, start_ms, end_ms, duration_ms, the last four may be null;
    ``truth``: session, place, speaker, text, start_ms, end_ms. Mode "timestamp" goes by the speaker who overlaps the row
    most (the earliest of equals), "text" by aligned words and, with ``fuzzy``, by the most similar text; "auto" by
    text where no speaker overlaps. Columns: session, place, assigned, timed, duration_ms, overlap_ms, total_ms, speaker,
    score, found_by (timestamp also for a timed row that nobody overlaps, unmatched where nothing fits).
    """
    if mode not in ("auto", "text", "timestamp"):
        raise ValueError(f"no such mode: {mode}")
    rows = live.select(session, place, "text", "assigned", "start_ms", "end_ms", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))
    if mode == "text":
        rows = rows.withColumns({"start_ms": F.lit(None).cast("long"), "end_ms": F.lit(None).cast("long")})
    said = truth.select(session, F.col(place).alias("_first"), F.col("speaker").alias("_speaker"), "start_ms", "end_ms")
    pairs = intervals.overlap_join(rows.select(session, place, "start_ms", "end_ms"), said, [session], bucket_ms)
    each = pairs.groupBy(session, place, "_speaker").agg(F.sum("overlap_ms").alias("_ms"), F.min("_first").alias("_first"))
    timed = each.groupBy(session, place).agg(F.max_by(F.struct("_speaker", "_ms"), F.struct("_ms", -F.col("_first"))).alias("_t"), F.sum("_ms").alias("_total"))
    rows = rows.join(timed, [session, place], "left").withColumn("_timed", F.coalesce(F.col("end_ms") > F.col("start_ms"), F.lit(False)))
    rows = rows.withColumn("duration_ms", F.when(F.col("_timed"), F.greatest("duration_ms", F.col("end_ms") - F.col("start_ms"))).otherwise(F.col("duration_ms")))
    columns = [session, place, "assigned", F.col("_timed").alias("timed"), "duration_ms", F.coalesce("_t._ms", F.lit(0)).alias("overlap_ms"), F.coalesce("_total", F.lit(0)).alias("total_ms")]
    by_time = F.when(F.col("_timed"), "timestamp").otherwise("unmatched")
    if mode == "timestamp":
        return rows.select(*columns, F.col("_t._speaker").alias("speaker"), F.lit(None).cast("double").alias("score"), by_time.alias("found_by"))
    texts = text_matches(_plain(rows, session, place, flag=F.col("_t").isNull()), _plain(truth, session, place, "speaker"), session, fuzzy)
    rows = rows.join(texts.withColumnsRenamed({session: "_s", "place": "_p"}), (F.col(session).eqNullSafe(F.col("_s"))) & (F.col(place) == F.col("_p")), "left")
    aligned, similar, open_ = F.col("lcs_share") >= LEAST_SHARE, F.col("similar_score") >= LEAST_SCORE, F.col("_t").isNull()
    speaker = F.when(~open_, F.col("_t._speaker")).when(aligned, F.col("lcs_speaker")).when(similar, F.col("similar_speaker"))
    score = F.when(open_, F.when(aligned, F.col("lcs_share")).otherwise(F.col("similar_score")))
    found_by = F.when(open_ & aligned, "text_lcs").when(open_ & similar, "text").otherwise(by_time)
    return rows.select(*columns, speaker.alias("speaker"), score.alias("score"), found_by.alias("found_by"))


def profile_speakers(rows: DataFrame, session: str, place: str) -> DataFrame:
    """(session, assigned, mapped): the speaker with whom an assigned profile has most time in ``trace_rows``, each row at
    least 1 ms, the first met of equals."""
    weight = rows.filter("assigned <> '' AND speaker IS NOT NULL").groupBy(session, "assigned", "speaker").agg(F.sum(F.greatest("duration_ms", F.lit(1))).alias("_w"), F.min(place).alias("_f"))
    return weight.groupBy(session, "assigned").agg(F.max_by("speaker", F.struct("_w", -F.col("_f"))).alias("mapped"))


def trace_report(live: DataFrame, truth: DataFrame, session: str, place: str, mode: str = "auto", fuzzy: bool = True) -> DataFrame:
    """One row for each live session: segment counts, text recall and precision, segment and duration accuracy."""
    rows = trace_rows(live, truth, session, place, mode, fuzzy)
    mapped = profile_speakers(rows, session, place).withColumnsRenamed({session: "_s", "assigned": "_a"})
    rows = rows.join(mapped, (F.col(session).eqNullSafe(F.col("_s"))) & (F.col("assigned") == F.col("_a")), "left")
    right = F.coalesce(F.col("mapped") == F.col("speaker"), F.lit(False))
    scored = F.col("speaker").isNotNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ms = lambda c: F.sum(F.when(c, F.col("duration_ms")).otherwise(0))
    counts = rows.groupBy(session).agg(
        F.count(F.lit(1)).alias("segments"),
        one(F.col("timed")).alias("timed_segments"),
        one(F.col("found_by").isin("text_lcs", "text")).alias("text_matched"),
        one(F.coalesce(F.col("assigned"), F.lit("")) == "").alias("unknown"),
        one(scored).alias("_scored"), one(scored & right).alias("_right"), ms(scored).alias("_ms"), ms(scored & right).alias("_right_ms"),
    )
    words = common_words(live, truth, session, place).withColumnRenamed(session, "_s")
    out = counts.join(words, F.col(session).eqNullSafe(F.col("_s")))
    share = lambda a, b: quantized(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    return out.select(
        session, "segments", "timed_segments", "text_matched", "unknown", F.col("other_words").alias("truth_words"), F.col("words").alias("live_words"), F.col("common").alias("lcs_words"),
        share(F.col("common"), F.col("other_words")).alias("text_recall"), share(F.col("common"), F.col("words")).alias("text_precision"),
        share(F.col("_right"), F.col("_scored")).alias("segment_accuracy"), share(F.col("_right_ms"), F.col("_ms")).alias("duration_accuracy"),
    )
