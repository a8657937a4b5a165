"""Scorecards of predicted profiles against true speakers, from overlap pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions.numbers import f1_score, latency_score, quantized, safe_ratio
from turnloom.operators.intervals import merge_intervals, valid


def overlap_matrix(overlaps: DataFrame, key: str = "session_id") -> DataFrame:
    """Total overlap of each (session, true speaker, profile)."""
    return overlaps.groupBy(key, F.col("speaker").alias("truth"), "profile").agg(F.sum("overlap_ms").alias("overlap_ms"))


def profile_map(matrix: DataFrame, key: str = "session_id") -> DataFrame:
    """Each profile's speaker with most overlap, the smaller name on a tie, none last; several profiles may share a speaker."""
    best = matrix.groupBy(key, "profile").agg(F.min(F.struct((-F.col("overlap_ms")).alias("o"), F.isnull("truth").alias("unnamed"), "truth")).alias("b"))
    return best.select(key, "profile", F.col("b.truth").alias("truth"), (-F.col("b.o")).alias("overlap_ms"))


def greedy_map(matrix: DataFrame, key: str = "session_id") -> DataFrame:
    """One-to-one: pairs in falling order of overlap, each profile and speaker used once.

    The matrix of a session is small (profiles x speakers); Spark spreads sessions over tasks.
    """

    def pick(pdf):
        used: set = set()
        rows = []
        for r in pdf.sort_values(["overlap_ms", "profile", "truth"], ascending=[False, True, True]).itertuples(index=False):
            if ("p", r.profile) not in used and ("t", r.truth) not in used:
                used |= {("p", r.profile), ("t", r.truth)}
                rows.append(r)
        return pdf.iloc[:0] if not rows else type(pdf)(rows)[list(pdf.columns)]

    return matrix.groupBy(key).applyInPandas(pick, matrix.schema)


def correct_pieces(overlaps: DataFrame, mapped: DataFrame, key: str = "session_id") -> DataFrame:
    """Parts of turns during which a profile that stands for the turn's speaker was visible."""
    m = mapped.select(key, "profile", F.col("truth").alias("speaker"))
    return overlaps.join(m, [key, "profile", "speaker"]).select(key, "idx", F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms"))


def turn_latency(turns: DataFrame, overlaps: DataFrame, mapped: DataFrame, key: str = "session_id") -> DataFrame:
    """Per turn: time to the first correct slice, whether the speaker changed, and the latency score (0 if missed)."""
    first = correct_pieces(overlaps, mapped, key).groupBy(key, "idx").agg(F.min("start_ms").alias("first_ms"))
    prev = F.lag("speaker").over(W.partitionBy(key).orderBy("start_ms", "idx"))
    t = valid(turns).withColumn("changed", F.coalesce(prev != F.col("speaker"), F.lit(False)))
    rows = t.join(first, [key, "idx"], "left").withColumn("latency_ms", F.col("first_ms") - F.col("start_ms"))
    return rows.select(key, "idx", "speaker", "latency_ms", "changed", quantized(F.when(F.col("latency_ms").isNull(), F.lit(0.0)).otherwise(latency_score(F.col("latency_ms")))).alias("score"))


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """Smallest, median (mean of the middle two), nearest-rank 90th percentile, largest and mean."""
    p90 = F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {column})").cast("long")
    return df.agg(F.min(column).cast("long").alias("low"), quantized(F.median(column)).alias("middle"), p90.alias("p90"), F.max(column).cast("long").alias("high"), quantized(F.avg(column)).alias("mean"), F.count(column).alias("n"))


def flicker(turns: DataFrame, overlaps: DataFrame, mapped: DataFrame, key: str = "session_id", least_ms: int = 250) -> DataFrame:
    """Interruptions inside turns: pauses of at least ``least_ms`` between two correct pieces."""
    order = W.partitionBy(key, "idx").orderBy("start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1)
    rows = correct_pieces(overlaps, mapped, key).withColumn("pause", F.col("start_ms") - F.max("end_ms").over(order)).filter(F.col("pause") >= least_ms)
    return rows.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("interruptions"), F.sum("pause").alias("interrupted_ms"))


def release_latency(pauses: DataFrame, states: DataFrame, key: str, dwell_ms: int) -> DataFrame:
    """For each pause: time until the state is empty for at least ``dwell_ms``; null where it never is."""
    p, s = pauses.alias("p"), states.filter("state IS NULL").alias("s")
    at = F.greatest("s.start_ms", "p.gap_start_ms")
    on = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("s.start_ms") < F.col("p.gap_end_ms")) & (F.col("s.end_ms") > F.col("p.gap_start_ms")) & (F.col("s.end_ms") - at >= dwell_ms)
    return p.join(s, on, "left").groupBy(f"p.{key}", "p.gap_start_ms", "p.gap_end_ms").agg((F.min(F.when(F.col("s.start_ms").isNotNull(), at)) - F.first("p.gap_start_ms")).alias("release_ms"))


def availability(turns: DataFrame, events: DataFrame, mapped: DataFrame, key: str = "session_id") -> DataFrame:
    """Whether a turn's speaker had a profile when the turn began, got one during it, or had none."""
    known = events.join(mapped.select(key, "profile", "truth"), [key, "profile"]).groupBy(key, F.col("truth").alias("speaker")).agg(F.min("available_ms").alias("available_ms"))
    case = F.when(F.col("available_ms") <= F.col("start_ms"), "known_at_turn_start").when(F.col("available_ms") < F.col("end_ms"), "becomes_known_during_turn").otherwise("never")
    return valid(turns).join(known, [key, "speaker"], "left").select(key, "idx", "speaker", case.alias("availability"))


def state_transitions(slices: DataFrame, key: str, state: str) -> DataFrame:
    """Counts of changes between speakers, to nobody, and from nobody."""
    order = W.partitionBy(key).orderBy("start_ms")
    rows = slices.withColumns({"_prev": F.lag(state).over(order), "_place": F.row_number().over(order)})
    later = F.col("_place") > 1
    now, prev = F.col(state), F.col("_prev")
    return rows.groupBy(key).agg(F.count_if(later & (now != prev)).alias("switches"), F.count_if(later & now.isNull() & prev.isNotNull()).alias("drops"), F.count_if(later & now.isNotNull() & prev.isNull()).alias("acquires"))


def switch_counts(slices: DataFrame, key: str, label: str, order_by: list[str]) -> DataFrame:
    prev = F.lag(label).over(W.partitionBy(key).orderBy(*order_by))
    return slices.withColumn("_switch", prev != F.col(label)).groupBy(key).agg(F.count_if("_switch").alias("switches"))


def scorecard(turns: DataFrame, slices: DataFrame, overlaps: DataFrame, mapped: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: true, shown, correct, wrong and outside time, coverage, precision and F1."""
    truth = valid(turns).groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("truth_ms"))
    shown = valid(slices).groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("shown_ms"))
    judged = overlap_matrix(overlaps, key).join(mapped.select(key, "profile", F.col("truth").alias("mapped")), [key, "profile"])
    right = F.col("truth") == F.col("mapped")
    judged = judged.groupBy(key).agg(F.sum(F.when(right, F.col("overlap_ms")).otherwise(0)).alias("correct_ms"), F.sum(F.when(~right, F.col("overlap_ms")).otherwise(0)).alias("wrong_ms"))
    rows = truth.join(shown, key, "left").join(judged, key, "left").na.fill(0)
    rows = rows.withColumn("outside_ms", F.col("shown_ms") - F.col("correct_ms") - F.col("wrong_ms"))
    c, p = safe_ratio(F.col("correct_ms"), F.col("truth_ms")), safe_ratio(F.col("correct_ms"), F.col("shown_ms"))
    return rows.select(key, "truth_ms", "shown_ms", "correct_ms", "wrong_ms", "outside_ms", quantized(c).alias("coverage"), quantized(p).alias("precision"), quantized(f1_score(c, p)).alias("f1"))


def blended_score(scores: DataFrame, column: str, key: str) -> DataFrame:
    """0.55 mean + 0.30 smallest + 0.15 mean of the three smallest, found without a global window."""
    low = scores.orderBy(column, key).limit(3).agg(F.avg(column).alias("bottom3"))
    whole = scores.agg(F.avg(column).alias("mean"), F.min(column).alias("worst"))
    both = whole.join(low)
    return both.select(quantized(0.55 * F.col("mean") + 0.30 * F.col("worst") + 0.15 * F.col("bottom3")).alias("score"), *(quantized(F.col(c)).alias(c) for c in ("mean", "worst", "bottom3")))


def merged_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Covered time of each key, overlaps counted once."""
    return merge_intervals(df, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
