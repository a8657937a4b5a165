"""Transcript rows: ladders of alternative columns, predicates of correction and reassignment, evidence, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def finalized(rows: DataFrame, session: str, place: str) -> DataFrame:
    """Rows that aren't pending and have text, with one row_id, text, speaker_id, speaker_name, start and end each."""
    at = F.row_number().over(W.partitionBy(session).orderBy(place)) - 1
    start = F.coalesce(F.nullif("start", F.lit(0.0)), "start_sec", F.lit(0.0))
    named = rows.withColumns({
        "row_id": F.coalesce(blank_to_null(F.col("row_id")), blank_to_null(F.col("id")), F.concat(F.lit("row_"), F.coalesce(F.col("index"), at.cast("long")).cast("string"))),
        "text": F.coalesce(blank_to_null(F.col("text")), blank_to_null(F.col("sentence"))),
        "speaker_id": F.coalesce(F.nullif("speaker_id", F.lit("")), "assigned_speaker", F.lit("")),
        "speaker_name": F.coalesce(blank_to_null(F.col("speaker_name")), blank_to_null(F.col("assigned_speaker")), F.lit("Unknown")),
        "start": start,
        "end": F.coalesce(F.nullif("end", F.lit(0.0)), F.nullif("end_sec", F.lit(0.0)), start),
    })
    return named.filter("NOT coalesce(pending, false) AND text IS NOT NULL")


def visible_speaker(dom: Column, visible: Column, *others: Column) -> Column:
    """What is shown: the visible id, a single id of the page, the first other id that the page agrees with, its first id."""

    def known(x: Column) -> Column:
        return F.when((F.trim(x) != "") & (F.trim(x) != "UNKNOWN"), F.trim(x))

    agreed = [F.when((F.size(dom) == 0) | F.array_contains(dom, known(x)), known(x)) for x in others]
    return F.coalesce(known(visible), F.when(F.size(dom) == 1, F.get(dom, F.lit(0))), *agreed, F.get(dom, F.lit(0)), F.lit(""))


def live_events(records: DataFrame) -> DataFrame:
    """(time, speaker, start, end) of the live_speaker records that name a known speaker and a positive interval."""
    payload = [F.get_json_object("payload", f"$.{k}") for k in ("speaker_id", "assigned_speaker", "start", "end")]
    out = records.filter("event = 'live_speaker'").withColumns({"speaker": F.coalesce(F.nullif(payload[0], F.lit("")), payload[1]), "start": payload[2].cast("double"), "end": payload[3].cast("double")})
    return out.filter("speaker <> '' AND speaker <> 'UNKNOWN' AND end > start").drop("event", "payload")


def clear_events(records: DataFrame) -> DataFrame:
    out = records.filter("event = 'live_speaker_clear'")
    return out.withColumns({k: F.coalesce(F.get_json_object("payload", f"$.{j}"), F.lit("")) for k, j in (("speaker", "speaker_id"), ("reason", "reason"))}).drop("event", "payload")


def sessions_seen(records: DataFrame, session: str, line: str) -> DataFrame:
    """Sessions in the order in which they first occur: (session, first_line)."""
    return records.groupBy(session).agg(F.min(line).alias("first_line"))


def of_session(records: DataFrame, session: str, line: str, selector: str) -> DataFrame:
    """Records of ``all`` sessions, of the ``latest`` that came up, or of one named; an error if no record has it."""
    if selector == "all":
        return records
    if selector == "latest":
        last = sessions_seen(records, session, line).agg(F.max_by(session, "first_line").alias("_s"))
        return records.join(F.broadcast(last), F.col(session) == F.col("_s")).drop("_s")
    found = records.filter(F.col(session).cast("string") == selector)
    if found.isEmpty():
        raise ValueError(f"no records of session {selector}")
    return found


def timed_words(words: DataFrame, session: list[str], duration: Column, most: float) -> DataFrame:
    """Words clipped to 0..duration, in order, none longer than ``most`` or past the next word's start."""
    clipped = words.withColumns({k: F.least(duration, F.greatest(F.lit(0.0), F.col(k))) for k in ("start", "end")}).filter("end > start AND trim(word) <> ''")
    ahead = F.lead("start").over(W.partitionBy(*session).orderBy("start", "end", "word"))
    cap = F.least(duration, F.col("start") + most, F.when(ahead > F.col("start"), ahead))
    return clipped.withColumn("end", F.least("end", cap))


def rejected_labels(rejected: Column, status: Column, corrected: Column, *earlier: Column) -> Column:
    """Labels that a user has ruled out for a row: those named, those corrected away from, but not the corrected one."""
    away = F.when(status == "user_corrected", F.array(*earlier)).otherwise(F.array().cast("array<string>"))
    every = F.array_union(F.coalesce(rejected, F.array().cast("array<string>")), away)
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(F.trim(corrected)))))


def confirmed_label(status: Column, corrected: Column, speaker: Column) -> Column:
    """The row's speaker if a user has confirmed just that; else null."""
    return F.when((status == "user_confirmed") & (F.coalesce(blank_to_null(corrected), speaker) == speaker), speaker)


def trusted(source: Column, duration_ms: Column, unknown: Column, vector: Column, least_ms: int = 800, most_unknown: float = 0.5) -> Column:
    return source.isin("embedding", "section_gap_new_speaker") & (duration_ms >= least_ms) & (unknown.isNull() | (unknown <= most_unknown)) & vector.isNotNull()


def uncertain(source: Column, duration_ms: Column, unknown: Column, vector: Column, confirmed: Column, rejected: Column, least_ms: int = 350, least_unknown: float = 0.5) -> Column:
    doubtful = ~source.isin("embedding", "section_gap_new_speaker") | F.coalesce(unknown >= least_unknown, F.lit(False))
    return confirmed.isNull() & (F.size(rejected) == 0) & (duration_ms >= least_ms) & vector.isNotNull() & doubtful


def may_reassign(source: Column, created: Column, duration_ms: Column, speaker: Column, unknown: Column, most_ms: int, least_unknown: float) -> Column:
    return (source == "context") | (~created & (duration_ms <= most_ms) & (speaker.isNull() | (unknown >= least_unknown)))


def reassignment_holds(speaker: Column, similarity: Column, margin: Column, unknown: Column, duration_ms: Column, least: float, short_ms: int, short_least: float, short_margin: float, most_unknown: float) -> Column:
    short = (duration_ms <= short_ms) & (similarity >= short_least) & (margin >= short_margin)
    return speaker.isNotNull() & (F.coalesce(similarity >= least, F.lit(False)) | F.coalesce(short, F.lit(False)) | (unknown <= most_unknown))


def padded(start: Column, end: Column, duration: Column, least: float) -> tuple[Column, Column]:
    """A segment of at least ``least`` around its middle, inside 0..duration."""
    s = F.greatest(F.lit(0.0), start)
    e = F.greatest(s, end)
    low = F.greatest(F.lit(0.0), (s + e) / 2 - least / 2)
    high = F.least(duration, (s + e) / 2 + least / 2)
    moved = F.greatest(F.lit(0.0), F.least(low, duration - least))
    short, tight = e - s < least, high - low < least
    first = F.when(short, F.when(tight, moved).otherwise(low)).otherwise(s)
    last = F.when(short, F.when(tight, F.least(duration, moved + least)).otherwise(high)).otherwise(e)
    return first, F.greatest(first, last)


def evidence_items(items: DataFrame, rows: DataFrame, item: str = "item", row_id: str = "row_id", quoted: int = 4) -> DataFrame:
    """Items that cite at least one row that exists: ids, start, end, speakers and a quote of the first rows cited.

    ``items`` has one row for each citation: item, row_id and ``place`` (its order in the item).
    """
    cited = items.join(rows, row_id)
    place = F.row_number().over(W.partitionBy(item).orderBy("place"))
    return cited.withColumn("_n", place).groupBy(item).agg(
        F.array_sort(F.collect_set(row_id)).alias("row_ids"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_set("speaker")).alias("speakers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= quoted, F.struct("_n", "text")))), lambda x: x["text"]), " ").alias("quote"),
    )


def sanitized(items: DataFrame, valid: DataFrame, item: list[str], evidence: str, required: str) -> DataFrame:
    """Items without dangling citations: (item, n_cited, grounding); items that need evidence and have none go."""
    known = items.join(valid.select(F.col(evidence).alias("_e")).distinct(), F.col(evidence) == F.col("_e"), "left")
    counted = known.groupBy(*item, required).agg(F.count("_e").alias("n_cited"))
    return counted.filter(f"NOT {required} OR n_cited > 0").withColumn("grounding", F.when(F.col("n_cited") > 0, F.lit("grounded")).otherwise(F.lit("not_required")))


def edited(rows: DataFrame, edits: DataFrame, session: str, speaker: str) -> DataFrame:
    """Rows after a log of speaker edits (session, seq, from, to, undone): merges and renames in order, undone ones left out.

    ``to`` null deletes the speaker's label. A session's log holds what its users did by hand; it is folded over each row.
    """
    log = edits.filter("NOT undone").groupBy(session).agg(F.array_sort(F.collect_list(F.struct("seq", "from", "to"))).alias("_log"))
    out = rows.join(log, session, "left")
    fold = F.aggregate(F.coalesce("_log", F.array().cast("array<struct<seq:bigint,from:string,to:string>>")), F.col(speaker), lambda s, e: F.when(s == e["from"], e["to"]).otherwise(s))
    return out.withColumn("edited", fold).drop("_log")


def split_speaker(rows: DataFrame, session: str, place: str, speaker: str, source: str, moved: Column) -> DataFrame:
    """Rows of ``source`` that ``moved`` selects go to a new label, one above the session's highest."""
    index = F.max(F.regexp_extract(speaker, "^S([0-9]+)$", 1).try_cast("int")).over(W.partitionBy(session))
    fresh = F.concat(F.lit("S"), (F.coalesce(index, F.lit(0)) + 1).cast("string"))
    return rows.withColumn("split", F.when((F.col(speaker) == source) & moved, fresh).otherwise(F.col(speaker)))


def map_error(left: Column, right: Column) -> Column:
    """Largest absolute difference of two maps of numbers; a missing key counts as 0, infinity where one isn't finite."""
    gaps = F.map_values(F.map_zip_with(left, right, lambda k, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    worst = F.array_max(F.transform(gaps, lambda d: F.when(F.isnan(d), F.lit(float("inf"))).otherwise(F.abs(d))))
    return F.coalesce(worst, F.lit(0.0))


def sample_quality(seconds: Column, count: Column, cohesion: Column) -> Column:
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), seconds / 8.0 * F.least(F.lit(1.0), count / 3.0)))
    return base * F.coalesce(F.greatest(F.lit(0.5), F.least(F.lit(1.0), cohesion)), F.lit(1.0))


def linear(channel: Column) -> Column:
    """An sRGB channel of 0..1 as linear light."""
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


def channels(hex_color: Column) -> list[Column]:
    return [F.conv(F.substring(hex_color, k, 2), 16, 10).cast("int") / 255.0 for k in (2, 4, 6)]


def contrast(hex_color: Column, background: Column) -> Column:
    """Contrast ratio of two #rrggbb colours by their relative luminance."""

    def light(x: Column) -> Column:
        r, g, b = (linear(c) for c in channels(x))
        return 0.2126 * r + 0.7152 * g + 0.0722 * b

    one, two = light(hex_color), light(background)
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


#: Linear sRGB to cone responses, and their cube roots to OKLab.
TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(hex_color: Column) -> Column:
    """Struct of l, a, b."""
    light = [linear(c) for c in channels(hex_color)]
    cones = [F.cbrt(sum(k * c for k, c in zip(row, light))) for row in TO_CONES]
    return F.struct(*(sum(k * c for k, c in zip(row, cones)).alias(name) for name, row in zip("lab", TO_OKLAB)))
