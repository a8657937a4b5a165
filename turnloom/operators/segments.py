"""Rows regrouped by session: scattered labels, doubtful rows, topics, pairs of unknown rows, transcript lines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.vectors import cosine
from turnloom.operators.sequence import run_table


def merge_fragments(df: DataFrame, key: str, most_ms: int = 6000, most_rows: int = 8, least_runs: int = 2, most_runs: int = 3, least_share: float = 0.5, label: str = "speaker") -> DataFrame:
    """A label with little time in two or three runs takes the label (``fixed``) that most of its runs are next to.

    Each run votes for the nearest other label on either side, past unknown rows. Without a single winner, with less
    than ``least_share`` of the votes, or where the winner is such a label itself, nothing changes. All labels are
    judged on the rows as given. Null labels stay null.
    """
    known = run_table(df, key, label).filter(F.col(label).isNotNull())
    order = W.partitionBy(key).orderBy("run")
    back, ahead = F.lag(label).over(order), F.lead(label).over(order)
    # Two runs of one label with unknown rows between them have the same neighbours: what the first or last of them meets.
    known = known.withColumns({"_b": F.when(back != F.col(label), back), "_a": F.when(ahead != F.col(label), ahead)})
    known = known.withColumns({"before": F.last("_b", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "after": F.first("_a", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))})
    sizes = known.groupBy(key, label).agg(F.sum("total_ms").alias("_ms"), F.sum("rows").alias("_rows"), F.count(F.lit(1)).alias("_runs"))
    small = sizes.filter((F.col("_ms") <= most_ms) & (F.col("_rows") <= most_rows) & F.col("_runs").between(least_runs, most_runs)).select(key, label)
    votes = known.join(small, [key, label], "left_semi").select(key, label, F.explode(F.array("before", "after")).alias("_to")).filter("_to IS NOT NULL")
    votes = votes.groupBy(key, label, "_to").agg(F.count(F.lit(1)).alias("_n"))
    won = votes.groupBy(key, label).agg(F.max_by("_to", "_n").alias("_to"), F.max("_n").alias("_n"), F.sum("_n").alias("_all"), F.sort_array(F.collect_list("_n"), False).alias("_counts"))
    won = won.filter((F.coalesce(F.get("_counts", F.lit(1)), F.lit(0)) < F.col("_n")) & (F.col("_n") / F.col("_all") >= least_share))
    won = won.join(small.withColumnRenamed(label, "_to"), [key, "_to"], "left_anti").select(key, label, "_to")
    return df.join(won, [key, label], "left").withColumn("fixed", F.coalesce("_to", label)).drop("_to")


def split_doubtful(df: DataFrame, key: str, least_ms: int = 4000, most_similarity: float = 0.06, most_margin: float = 0.04, most_splits: int = 1, label: str = "speaker") -> DataFrame:
    """The first long rows labelled in retrospect with little support get labels of their own (``fixed``).

    New labels go on from the highest number among the session's labels of the form S12. A null in ``source``,
    ``top_similarity``, ``margin`` or the label leaves the row as it is.
    """
    number = F.regexp_extract(label, r"^S([0-9]{1,9})$", 1).try_cast("long")
    doubtful = df.filter((F.col("source") == "retro") & F.col(label).isNotNull() & (F.col("duration_ms") >= least_ms) & (F.col("top_similarity") <= most_similarity) & (F.col("margin") <= most_margin))
    place = F.row_number().over(W.partitionBy(key).orderBy("idx"))
    chosen = doubtful.select(key, "idx").withColumn("_place", place).filter(F.col("_place") <= most_splits)
    last = df.groupBy(key).agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    named = chosen.join(last, key).select(key, "idx", F.concat(F.lit("S"), F.col("_last") + F.col("_place")).alias("_new"))
    return df.join(named, [key, "idx"], "left").withColumn("fixed", F.coalesce("_new", label)).drop("_new")


# Words that begin a topic.
TOPIC_CUES = "next item|moving on|agenda|parking|morale|finance|financial|training|cleanliness|risk|decision|issue"
TOPIC_ROWS, SEGMENT_ROWS = 16, 80


def topic_segments(rows: DataFrame, key: str, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of a session: (segment from 1, first_idx, last_idx, rows), cut at 80 rows, or at a topic word after 16.

    Where a segment ends depends on where it began, so a task streams the sorted rows of a session and holds the
    bounds of one segment. A null text has no topic word.
    """
    kind = rows.schema[key].dataType.simpleString()
    cue = F.coalesce(F.col("text").rlike(rf"(?i)\b({TOPIC_CUES})\b"), F.lit(False))

    def segments(sorted_rows):
        now, number, first, last, n = None, 0, 0, 0, 0
        for k, idx, starts in sorted_rows:
            if n and (now != (k,) or n >= most_rows or (n >= TOPIC_ROWS and starts)):
                yield *now, number, first, last, n
                n = 0
            if now != (k,):
                now, number = (k,), 0
            if not n:
                number, first = number + 1, idx
            last, n = idx, n + 1
        if n:
            yield *now, number, first, last, n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, *[pa.int64()] * 4]

        def each():
            for batch in batches:
                types[0] = batch.schema.field(key).type
                yield from zip(*(batch.column(c).to_pylist() for c in (key, "idx", "cue")))

        found = segments(each())
        while out := list(islice(found, 10000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [key, "segment", "first_idx", "last_idx", "rows"])

    shape = f"`{key}` {kind}, segment long, first_idx long, last_idx long, rows long"
    return rows.select(key, F.col("idx").cast("long").alias("idx"), cue.alias("cue")).repartition(key).sortWithinPartitions(key, "idx").mapInArrow(cut, shape)


def unknown_pairs(df: DataFrame, key: str, most_gap_ms: int = 4000, least_ms: int = 2500, least_partner_ms: int = 200, least_similarity: float = 0.45, most_top: float = 0.55, most_margin: float = 0.2, least_unknown: float = 0.1, label: str = "speaker") -> DataFrame:
    """(idx, partner_idx, similarity, gap_ms): an unknown row and the most alike unknown row that ended shortly before.

    Both together are ground for a new label. The row must be long and fit no known label (``top_similarity``,
    ``margin``, ``unknown_probability``; a null counts as 1, 1 and 0). Ties go to the earlier row. Each row is judged
    by itself: one row can be the partner of two. Rows meet by stretches of ``most_gap_ms``, so a long session is split.
    """
    unknown = df.filter(F.col(label).isNull())
    stretch = lambda at: F.floor(at / most_gap_ms)
    able = (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.coalesce("top_similarity", F.lit(1.0)) <= most_top) & (F.coalesce("margin", F.lit(1.0)) <= most_margin) & (F.coalesce("unknown_probability", F.lit(0.0)) >= least_unknown)
    now = unknown.filter(able).select(key, "idx", "start_ms", "embedding", F.explode(F.array(stretch(F.col("start_ms")) - 1, stretch(F.col("start_ms")))).alias("_s"))
    then = unknown.filter(F.col("end_ms") - F.col("start_ms") >= least_partner_ms).select(key, F.col("idx").alias("partner_idx"), "end_ms", F.col("embedding").alias("_e"), stretch(F.col("end_ms")).alias("_s"))
    gap = F.col("start_ms") - F.col("end_ms")
    pairs = now.join(then, [key, "_s"]).filter(gap.between(0, most_gap_ms) & (F.col("idx") != F.col("partner_idx")))
    pairs = pairs.select(key, "idx", "partner_idx", gap.alias("gap_ms"), cosine(F.col("embedding"), F.col("_e")).alias("similarity")).filter(F.col("similarity") >= least_similarity)
    best = pairs.groupBy(key, "idx").agg(F.max_by(F.struct("partner_idx", "similarity", "gap_ms"), F.struct("similarity", -F.col("partner_idx"))).alias("_p"))
    return best.select(key, "idx", "_p.*")


# One line of a text transcript, [start - end] speaker: text.
TRANSCRIPT_LINE = r"^\s*\[(\d+(?::\d+){1,2}(?:\.\d+)?)\s+-\s+(\d+(?::\d+){1,2}(?:\.\d+)?)\]\s+([^:]+):\s*(.*)$"


def _seconds(code: Column) -> Column:
    return F.aggregate(F.split(code, ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))


def name_key(name: Column) -> Column:
    """S7 for a name that ends in 007; other names with what is no letter or digit as _, at most 40 characters."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    plain = F.substring(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 40)
    number = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(digits != "", F.concat(F.lit("S"), number)).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("speaker")))


def transcript_lines(lines: DataFrame, key: str, place: str, line: str = "line") -> DataFrame:
    """Rows of a text transcript: index from 1, start, end (s), speaker_name, speaker_id, text, source_line.

    Lines of another form, null lines and lines without text are left out.
    """
    part = lambda n: F.regexp_extract(line, TRANSCRIPT_LINE, n)
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    rows = lines.filter(F.col(line).rlike(TRANSCRIPT_LINE)).select(key, F.col(place).alias("source_line"), _seconds(part(1)).alias("start"), _seconds(part(2)).alias("end"), squeezed(part(3)).alias("speaker_name"), squeezed(part(4)).alias("text"))
    rows = rows.filter("text <> ''").withColumn("index", F.row_number().over(W.partitionBy(key).orderBy("source_line")))
    return rows.withColumn("speaker_id", name_key(F.col("speaker_name")))
