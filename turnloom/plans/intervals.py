"""Queries over intervals: truth turns against predicted ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.numbers import clamp, quantized, safe_ratio
from turnloom.operators import intervals as I
from turnloom.operators import scoring as S
from turnloom.plans.views import frame, with_views

VISIBLE_MS = 400


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "turns")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as intervals: each visible for its hold, 400 ms at most."""
    p = frame(spark, sf_dir, "probes")
    return p.select("session_id", "event_id", F.col("speaker").alias("profile"), F.col("tick_ms").alias("start_ms"), (F.col("tick_ms") + F.least("hold_ms", F.lit(VISIBLE_MS))).alias("end_ms"), "hold_ms")


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that are visible at all; one without a hold isn't, though ``least`` skips its null and gives it 400 ms."""
    return _ticks(spark, sf_dir).filter("hold_ms > 0").drop("hold_ms")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlap_join(_turns(spark, sf_dir), _slices(spark, sf_dir), ["session_id"])


def profile_overlap(spark, sf_dir):
    return S.overlap_matrix(_overlaps(spark, sf_dir))


def profile_map(spark, sf_dir):
    return S.profile_map(profile_overlap(spark, sf_dir)).select("session_id", "profile", "truth", "overlap_ms")


def greedy_map(spark, sf_dir):
    return S.greedy_map(profile_overlap(spark, sf_dir))


def profile_accuracy(spark, sf_dir):
    o = profile_overlap(spark, sf_dir)
    right = S.profile_map(o).select("session_id", "profile", F.col("truth").alias("mapped"))
    rows = o.join(right, ["session_id", "profile"]).groupBy("session_id").agg(F.sum(F.when(F.col("truth") == F.col("mapped"), F.col("overlap_ms")).otherwise(0)).alias("correct_ms"), F.sum("overlap_ms").alias("covered_ms"))
    return rows.withColumn("accuracy", quantized(safe_ratio(F.col("correct_ms"), F.col("covered_ms"))))


def merged_speech(spark, sf_dir):
    return I.merge_intervals(_slices(spark, sf_dir), ["session_id", "profile"])


def missed_speech(spark, sf_dir):
    return I.subtract_intervals(_turns(spark, sf_dir), _slices(spark, sf_dir).drop("profile"), ["session_id"], ["idx", "speaker"])


def longest_missed(spark, sf_dir):
    m = missed_speech(spark, sf_dir).withColumn("missed_ms", F.col("end_ms") - F.col("start_ms"))
    return m.orderBy(F.desc("missed_ms"), "session_id", "start_ms", "idx").limit(20)


def speaker_turns(spark, sf_dir):
    return I.speaker_turns(_turns(spark, sf_dir))


def newly_covered(spark, sf_dir):
    return I.newly_covered(_slices(spark, sf_dir), ["session_id"], ["start_ms", "event_id"]).select("session_id", "event_id", "profile", "start_ms", "end_ms")


def live_slices(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").withColumn("clears", F.col("hold_ms") % 7 == 0)
    return I.held_slices(p, ["session_id"], "tick_ms", "hold_ms", ["tick_ms", "event_id"], "clears").select("session_id", "event_id", "speaker", "start_ms", "end_ms")


def observed_states(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").select("session_id", F.col("event_id").alias("sample"), F.col("tick_ms").alias("at_ms"), F.when(F.col("hold_ms") >= 1000, F.col("speaker")).alias("state"))
    return I.state_slices(p, "session_id", "at_ms", "state", 450)


def state_transitions(spark, sf_dir):
    return S.state_transitions(observed_states(spark, sf_dir), "session_id", "state")


def switch_counts(spark, sf_dir):
    return S.switch_counts(live_slices(spark, sf_dir), "session_id", "speaker", ["start_ms", "event_id"])


def assignment_gaps(spark, sf_dir):
    g = I.gaps_between(_turns(spark, sf_dir), ["session_id"], ["start_ms", "idx"])
    return g.orderBy(F.desc("gap_ms"), "session_id", "gap_start_ms").limit(20)


def turn_latency(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return S.turn_latency(turns, _overlaps(spark, sf_dir), profile_map(spark, sf_dir))


def latency_quantiles(spark, sf_dir):
    t = turn_latency(spark, sf_dir).filter("latency_ms IS NOT NULL")
    return S.quantiles(t, "latency_ms")


def latency_spread(spark, sf_dir):
    t = turn_latency(spark, sf_dir).filter("latency_ms IS NOT NULL")
    return t.groupBy("speaker").agg(*(quantized(F.percentile("latency_ms", p / 100)).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)))


def flicker_gaps(spark, sf_dir):
    return S.flicker(_turns(spark, sf_dir), _overlaps(spark, sf_dir), profile_map(spark, sf_dir))


def release_latency(spark, sf_dir):
    pauses = I.gaps_between(_turns(spark, sf_dir), ["session_id"], ["start_ms", "idx"]).filter("gap_ms >= 1000")
    return S.release_latency(pauses, observed_states(spark, sf_dir), "session_id", dwell_ms=300)


def profile_availability(spark, sf_dir):
    return S.availability(_turns(spark, sf_dir), _slices(spark, sf_dir).select("session_id", F.col("end_ms").alias("available_ms"), "profile"), profile_map(spark, sf_dir))


def point_in_turn(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").withColumn("at_ms", F.col("tick_ms") + 100)
    t = _turns(spark, sf_dir)
    hit = p.join(t, (p.session_id == t.session_id) & (F.col("start_ms") <= F.col("at_ms")) & (F.col("at_ms") < F.col("end_ms")), "left")
    out = hit.groupBy(p.session_id, p.event_id, "at_ms").agg(F.count_distinct(t.speaker).alias("n"), F.min(t.speaker).alias("who"))
    return out.select("session_id", "event_id", "at_ms", F.when(F.col("n") == 1, F.col("who")).alias("truth"))


def asof_profile(spark, sf_dir):
    t = _turns(spark, sf_dir).select("session_id", "idx", "start_ms")
    p = frame(spark, sf_dir, "probes").select("session_id", F.col("tick_ms").alias("available_ms"), "speaker", "event_id")
    return I.asof_join(t, p, ["session_id"], "start_ms", "available_ms", ["speaker", "event_id"], ["event_id"])


def session_scorecard(spark, sf_dir):
    return S.scorecard(_turns(spark, sf_dir), _slices(spark, sf_dir), _overlaps(spark, sf_dir), profile_map(spark, sf_dir))


def strict_scores(spark, sf_dir):
    card = session_scorecard(spark, sf_dir)
    f = flicker_gaps(spark, sf_dir).groupBy("session_id").agg(F.sum("interrupted_ms").alias("interrupted_ms"))
    rows = card.join(f, "session_id", "left").withColumn("interrupted_ms", F.coalesce("interrupted_ms", F.lit(0)))
    score = clamp(F.col("coverage") - safe_ratio(F.col("wrong_ms"), F.col("truth_ms")) - 0.25 * safe_ratio(F.col("outside_ms"), F.col("truth_ms")) - 0.25 * safe_ratio(F.col("interrupted_ms"), F.col("truth_ms")))
    return rows.select("session_id", "interrupted_ms", quantized(score).alias("strict_score"))


def scorecard_rollup(spark, sf_dir):
    o = profile_overlap(spark, sf_dir)
    return o.rollup("session_id", "truth").agg(F.sum("overlap_ms").alias("overlap_ms"), F.count_distinct("profile").alias("profiles"))


def macro_scores(spark, sf_dir):
    card = session_scorecard(spark, sf_dir)
    rows = card.agg(F.count(F.lit(1)).alias("sessions"), quantized(F.avg("coverage")).alias("mean_coverage"), quantized(F.avg("precision")).alias("mean_precision"), quantized(safe_ratio(F.sum("correct_ms"), F.sum("truth_ms"))).alias("pooled_coverage"))
    return rows


def bottom3_scores(spark, sf_dir):
    return S.blended_score(session_scorecard(spark, sf_dir), "coverage", "session_id")


def gap_groups(spark, sf_dir):
    return I.gap_groups(_turns(spark, sf_dir), ["session_id"], [0, 250, 500, 1000, 2000])


def dominant_overlap(spark, sf_dir):
    """For each tick the speaker with most overlap, first segment first on ties."""
    rows = _overlaps(spark, sf_dir).groupBy("session_id", "event_id", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("idx").alias("idx"))
    best = rows.groupBy("session_id", "event_id").agg(F.max(F.struct("overlap_ms", (-F.col("idx")).alias("i"), "speaker")).alias("b"))
    return best.select("session_id", "event_id", F.col("b.speaker").alias("speaker"), F.col("b.overlap_ms").alias("overlap_ms"))


def bucketed_overlap(spark, sf_dir):
    pairs = I.overlap_join(_turns(spark, sf_dir), _slices(spark, sf_dir), ["session_id"], bucket_ms=10_000)
    return pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap_ms").alias("overlap_ms"))


def atomic_speakers(spark, sf_dir):
    s = _ticks(spark, sf_dir).select("session_id", F.col("profile").alias("speaker"), "start_ms", (F.col("end_ms") + 900).alias("end_ms"))
    return I.atomic_slices(s, "session_id")


def consensus_spans(spark, sf_dir):
    return I.consensus_spans(_turns(spark, sf_dir).select("session_id", "start_ms", "end_ms"), _slices(spark, sf_dir).select("session_id", "start_ms", "end_ms"), "session_id")


def overlap_free_turns(spark, sf_dir):
    """Turns that no other speaker's slice overlaps by more than 120 ms."""
    t, o = _turns(spark, sf_dir).select("session_id", "idx", "speaker"), _overlaps(spark, sf_dir)
    m = profile_map(spark, sf_dir).select("session_id", "profile", "truth")
    other = o.join(m, ["session_id", "profile"]).filter("truth <> speaker AND overlap_ms > 120").select("session_id", "idx").distinct()
    return t.join(other, ["session_id", "idx"], "left_anti")


def hop_windows(spark, sf_dir):
    lengths = _turns(spark, sf_dir).groupBy("session_id").agg(F.max("end_ms").alias("length_ms"))
    return I.hop_windows(lengths, "session_id", "length_ms", 400, 1500)


def window_counts(spark, sf_dir):
    lengths = _turns(spark, sf_dir).groupBy("session_id").agg(F.max("end_ms").alias("length_ms"))
    return lengths.select("session_id", *(I.window_count(F.col("length_ms"), 400, w).alias(f"w{w}") for w in (700, 1500, 3000)))


_SLICES = "slices AS (SELECT session_id, event_id, speaker AS profile, tick_ms AS start_ms, tick_ms + LEAST(hold_ms, 400) AS end_ms FROM probes WHERE hold_ms > 0)"
_OVERLAPS = f"{_SLICES}, met AS (SELECT t.session_id, t.idx, t.speaker, t.start_ms, t.end_ms, s.event_id, s.profile, s.start_ms AS r_start_ms, s.end_ms AS r_end_ms, LEAST(t.end_ms, s.end_ms) - GREATEST(t.start_ms, s.start_ms) AS overlap_ms FROM turns t JOIN slices s ON t.session_id = s.session_id AND t.start_ms < s.end_ms AND s.start_ms < t.end_ms WHERE t.end_ms > t.start_ms)"
_MATRIX = f"{_OVERLAPS}, matrix AS (SELECT session_id, speaker AS truth, profile, CAST(SUM(overlap_ms) AS BIGINT) AS overlap_ms FROM met GROUP BY ALL)"
_MAP = f"{_MATRIX}, mapped AS (SELECT session_id, profile, truth, overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, profile ORDER BY overlap_ms DESC, truth) AS place FROM matrix) WHERE place = 1)"
_MERGED = f"{_SLICES}, reach AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slices), isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM reach), merged AS (SELECT session_id, min(start_ms) AS b_start, max(end_ms) AS b_end FROM isl GROUP BY session_id, island)"
_MISSED = f"""{_MERGED}, edges AS (
  SELECT t.session_id, t.idx, t.speaker, t.start_ms AS a, t.end_ms AS z, CASE WHEN b_start IS NOT NULL THEN greatest(b_start, t.start_ms) END AS s, CASE WHEN b_end IS NOT NULL THEN least(b_end, t.end_ms) END AS e
  FROM turns t LEFT JOIN merged m ON t.session_id = m.session_id AND t.start_ms < b_end AND b_start < t.end_ms WHERE t.end_ms > t.start_ms
), pieces AS (
  SELECT session_id, idx, speaker, coalesce(lag(e) OVER w, a) AS start_ms, coalesce(s, z) AS end_ms FROM edges WINDOW w AS (PARTITION BY session_id, idx ORDER BY s)
  UNION ALL SELECT session_id, idx, speaker, max(e) AS start_ms, max(z) AS end_ms FROM edges WHERE s IS NOT NULL GROUP BY session_id, idx, speaker
), missed AS (SELECT * FROM pieces WHERE end_ms > start_ms)"""
_Q = "floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1000000.0::DOUBLE"


def _q(x: str) -> str:
    return _Q.format(x=x)


_STATES = """samples AS (SELECT session_id, event_id AS sample, tick_ms AS at_ms, CASE WHEN hold_ms >= 1000 THEN speaker END AS state FROM probes),
held AS (SELECT *, at_ms AS start_ms, least(coalesce(lead(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, sample), at_ms + 450), at_ms + 450) AS end_ms FROM samples),
marks AS (SELECT *, lag(end_ms) OVER w AS prev_end, lag(state) OVER w AS prev_state FROM held WHERE end_ms > start_ms WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, sample)),
numbered AS (SELECT *, CAST(sum(CASE WHEN prev_end IS NULL OR start_ms > prev_end + 1 OR state IS DISTINCT FROM prev_state THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms, sample ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slice FROM marks),
states AS (SELECT session_id, slice, any_value(state) AS state, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY session_id, slice)"""
_LIVE = """live AS (
  SELECT session_id, event_id, speaker, tick_ms AS start_ms, least(tick_ms + hold_ms, coalesce(lead(tick_ms) OVER (PARTITION BY session_id ORDER BY tick_ms, event_id), tick_ms + hold_ms)) AS end_ms, hold_ms FROM probes
)"""
_PAUSES = "pauses AS (SELECT * FROM (SELECT session_id, max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start_ms, start_ms AS gap_end_ms FROM turns WHERE end_ms > start_ms) WHERE gap_end_ms > gap_start_ms)"
_LATENCY = f"""{_MAP}, firsts AS (
  SELECT o.session_id, o.idx, min(greatest(o.start_ms, o.r_start_ms)) AS first_ms FROM met o JOIN mapped m ON o.session_id = m.session_id AND o.profile = m.profile AND o.speaker = m.truth GROUP BY ALL
), latency AS (
  SELECT t.session_id, t.idx, t.speaker, f.first_ms - t.start_ms AS latency_ms, coalesce(lag(t.speaker) OVER (PARTITION BY t.session_id ORDER BY t.start_ms, t.idx) <> t.speaker, false) AS changed
  FROM turns t LEFT JOIN firsts f ON t.session_id = f.session_id AND t.idx = f.idx WHERE t.end_ms > t.start_ms
)"""
_CARD = f"""{_MAP}, truths AS (SELECT session_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS truth_ms FROM turns WHERE end_ms > start_ms GROUP BY session_id),
shown AS (SELECT session_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS shown_ms FROM slices GROUP BY session_id),
judged AS (SELECT x.session_id, CAST(sum(CASE WHEN x.truth = m.truth THEN x.overlap_ms ELSE 0 END) AS BIGINT) AS correct_ms, CAST(sum(CASE WHEN x.truth <> m.truth THEN x.overlap_ms ELSE 0 END) AS BIGINT) AS wrong_ms FROM matrix x JOIN mapped m ON x.session_id = m.session_id AND x.profile = m.profile GROUP BY x.session_id),
parts AS (SELECT t.session_id, truth_ms, coalesce(shown_ms, 0) AS shown_ms, coalesce(correct_ms, 0) AS correct_ms, coalesce(wrong_ms, 0) AS wrong_ms, coalesce(shown_ms, 0) - coalesce(correct_ms, 0) - coalesce(wrong_ms, 0) AS outside_ms FROM truths t LEFT JOIN shown s ON t.session_id = s.session_id LEFT JOIN judged j ON t.session_id = j.session_id),
raw AS (SELECT *, CASE WHEN truth_ms > 0 THEN correct_ms::DOUBLE / truth_ms ELSE 0 END AS c, CASE WHEN shown_ms > 0 THEN correct_ms::DOUBLE / shown_ms ELSE 0 END AS p FROM parts),
card AS (SELECT session_id, truth_ms, shown_ms, correct_ms, wrong_ms, outside_ms, {_q("c")} AS coverage, {_q("p")} AS precision, {_q("CASE WHEN c > 0 AND p > 0 THEN 2 * c * p / (c + p) ELSE 0 END")} AS f1 FROM raw)"""
_FLICKER = f"""{_MAP}, good AS (SELECT o.session_id, o.idx, o.speaker, greatest(o.start_ms, o.r_start_ms) AS s, least(o.end_ms, o.r_end_ms) AS e FROM met o JOIN mapped m ON o.session_id = m.session_id AND o.profile = m.profile AND o.speaker = m.truth),
reached AS (SELECT *, max(e) OVER (PARTITION BY session_id, idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM good),
flicker AS (SELECT session_id, idx, CAST(count(*) AS BIGINT) AS interruptions, CAST(sum(s - reach) AS BIGINT) AS interrupted_ms FROM reached WHERE s - reach >= 250 GROUP BY ALL)"""

SQL = {
    "greedy_map": f"SELECT session_id, profile, truth, overlap_ms FROM (WITH RECURSIVE {_MATRIX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY overlap_ms DESC, profile, truth) AS k FROM matrix), walk AS (SELECT *, true AS taken, [profile] AS ps, [truth] AS ts FROM ranked WHERE k = 1 UNION ALL SELECT r.*, f.free, CASE WHEN f.free THEN list_append(w.ps, r.profile) ELSE w.ps END, CASE WHEN f.free THEN list_append(w.ts, r.truth) ELSE w.ts END FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.ps, r.profile) AND NOT list_contains(w.ts, r.truth) AS free) f) SELECT * FROM walk WHERE taken)",
    "profile_overlap": f"WITH {_MATRIX} SELECT * FROM matrix",
    "profile_map": f"WITH {_MAP} SELECT * FROM mapped",
    "profile_accuracy": f"WITH {_MAP}, sums AS (SELECT x.session_id, CAST(sum(CASE WHEN x.truth = m.truth THEN x.overlap_ms ELSE 0 END) AS BIGINT) AS correct_ms, CAST(sum(x.overlap_ms) AS BIGINT) AS covered_ms FROM matrix x JOIN mapped m ON x.session_id = m.session_id AND x.profile = m.profile GROUP BY x.session_id) SELECT *, {_q('CASE WHEN covered_ms > 0 THEN correct_ms::DOUBLE / covered_ms ELSE 0 END')} AS accuracy FROM sums",
    "merged_speech": f"WITH {_SLICES}, reach AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, profile ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slices), isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, profile ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM reach) SELECT session_id, profile, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM isl GROUP BY session_id, profile, island",
    "missed_speech": f"WITH {_MISSED} SELECT session_id, idx, speaker, start_ms, end_ms FROM missed",
    "longest_missed": f"WITH {_MISSED} SELECT session_id, idx, speaker, start_ms, end_ms, end_ms - start_ms AS missed_ms FROM missed ORDER BY missed_ms DESC, session_id, start_ms, idx LIMIT 20",
    "speaker_turns": """WITH marks AS (SELECT *, max(end_ms) OVER w AS reach, lag(speaker) OVER o AS prev FROM turns WHERE end_ms > start_ms WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, end_ms, idx), w AS (PARTITION BY session_id ORDER BY start_ms, end_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR prev <> speaker OR start_ms > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM marks)
SELECT session_id, turn, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS segments, string_agg(text, ' ' ORDER BY start_ms, end_ms, idx) AS text FROM numbered GROUP BY session_id, turn""",
    "newly_covered": f"WITH {_SLICES}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM slices) SELECT session_id, event_id, profile, greatest(start_ms, coalesce(reach, start_ms)) AS start_ms, end_ms FROM r WHERE end_ms > greatest(start_ms, coalesce(reach, start_ms))",
    "live_slices": f"WITH {_LIVE} SELECT session_id, event_id, speaker, start_ms, end_ms FROM live WHERE hold_ms % 7 <> 0 AND end_ms > start_ms",
    "observed_states": f"WITH {_STATES} SELECT * FROM states",
    "state_transitions": f"WITH {_STATES}, steps AS (SELECT session_id, state, lag(state) OVER w AS prev, row_number() OVER w AS place FROM states WINDOW w AS (PARTITION BY session_id ORDER BY start_ms)) SELECT session_id, count(*) FILTER (WHERE place > 1 AND state IS NOT NULL AND prev IS NOT NULL AND state <> prev) AS switches, count(*) FILTER (WHERE place > 1 AND state IS NULL AND prev IS NOT NULL) AS drops, count(*) FILTER (WHERE place > 1 AND state IS NOT NULL AND prev IS NULL) AS acquires FROM steps GROUP BY session_id",
    "switch_counts": f"WITH {_LIVE}, x AS (SELECT session_id, speaker, lag(speaker) OVER (PARTITION BY session_id ORDER BY start_ms, event_id) AS prev FROM live WHERE hold_ms % 7 <> 0 AND end_ms > start_ms) SELECT session_id, count(*) FILTER (WHERE prev <> speaker) AS switches FROM x GROUP BY session_id",
    "assignment_gaps": f"WITH {_PAUSES} SELECT session_id, gap_start_ms, gap_end_ms, gap_end_ms - gap_start_ms AS gap_ms FROM pauses ORDER BY gap_ms DESC, session_id, gap_start_ms LIMIT 20",
    "turn_latency": f"WITH {_LATENCY} SELECT session_id, idx, speaker, latency_ms, changed, {_q('CASE WHEN latency_ms IS NULL THEN 0 ELSE greatest(0, least(1, 1 - greatest(0, latency_ms - 500) / 2500.0::DOUBLE)) END')} AS score FROM latency",
    "latency_quantiles": f"WITH {_LATENCY} SELECT CAST(min(latency_ms) AS BIGINT) AS low, {_q('median(latency_ms)')} AS middle, CAST(quantile_disc(latency_ms, 0.9) AS BIGINT) AS p90, CAST(max(latency_ms) AS BIGINT) AS high, {_q('avg(latency_ms)')} AS mean, count(*) AS n FROM latency WHERE latency_ms IS NOT NULL",
    "latency_spread": f"WITH {_LATENCY} SELECT speaker, " + ", ".join(f"{_q(f'quantile_cont(latency_ms::DOUBLE, {p / 100})')} AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + " FROM latency WHERE latency_ms IS NOT NULL GROUP BY speaker",
    "flicker_gaps": f"WITH {_FLICKER} SELECT * FROM flicker",
    "release_latency": f"WITH {_STATES}, {_PAUSES}, clear AS (SELECT p.session_id, p.gap_start_ms, min(greatest(s.start_ms, p.gap_start_ms)) AS at_ms FROM pauses p JOIN states s ON p.session_id = s.session_id AND s.state IS NULL AND s.start_ms < p.gap_end_ms AND s.end_ms - greatest(s.start_ms, p.gap_start_ms) >= 300 AND s.end_ms > p.gap_start_ms WHERE p.gap_end_ms - p.gap_start_ms >= 1000 GROUP BY ALL) SELECT p.session_id, p.gap_start_ms, p.gap_end_ms, c.at_ms - p.gap_start_ms AS release_ms FROM pauses p LEFT JOIN clear c ON p.session_id = c.session_id AND p.gap_start_ms = c.gap_start_ms WHERE p.gap_end_ms - p.gap_start_ms >= 1000",
    "profile_availability": f"WITH {_MAP}, known AS (SELECT s.session_id, m.truth, min(s.end_ms) AS available_ms FROM slices s JOIN mapped m ON s.session_id = m.session_id AND s.profile = m.profile GROUP BY ALL) SELECT t.session_id, t.idx, t.speaker, CASE WHEN k.available_ms <= t.start_ms THEN 'known_at_turn_start' WHEN k.available_ms < t.end_ms THEN 'becomes_known_during_turn' ELSE 'never' END AS availability FROM turns t LEFT JOIN known k ON t.session_id = k.session_id AND t.speaker = k.truth WHERE t.end_ms > t.start_ms",
    "point_in_turn": "SELECT p.session_id, p.event_id, p.tick_ms + 100 AS at_ms, CASE WHEN count(DISTINCT t.speaker) = 1 THEN min(t.speaker) END AS truth FROM probes p LEFT JOIN turns t ON p.session_id = t.session_id AND t.start_ms <= p.tick_ms + 100 AND p.tick_ms + 100 < t.end_ms GROUP BY ALL",
    "asof_profile": "WITH last AS (SELECT t.session_id, t.idx, t.start_ms, p.tick_ms AS available_ms, p.speaker, p.event_id, row_number() OVER (PARTITION BY t.session_id, t.idx ORDER BY p.tick_ms DESC, p.event_id DESC) AS place FROM turns t LEFT JOIN probes p ON t.session_id = p.session_id AND p.tick_ms <= t.start_ms) SELECT session_id, idx, start_ms, available_ms, speaker, event_id FROM last WHERE place = 1",
    "session_scorecard": f"WITH {_CARD} SELECT * FROM card",
    "strict_scores": f"WITH {_CARD}, {_FLICKER.replace(_MAP + ', ', '')}, f AS (SELECT session_id, CAST(sum(interrupted_ms) AS BIGINT) AS interrupted_ms FROM flicker GROUP BY session_id) SELECT c.session_id, coalesce(interrupted_ms, 0) AS interrupted_ms, {_q('greatest(0, least(1, coverage - wrong_ms::DOUBLE / truth_ms - 0.25::DOUBLE * (outside_ms::DOUBLE / truth_ms) - 0.25::DOUBLE * (coalesce(interrupted_ms, 0)::DOUBLE / truth_ms)))')} AS strict_score FROM card c LEFT JOIN f ON c.session_id = f.session_id",
    "scorecard_rollup": f"WITH {_MATRIX} SELECT session_id, truth, CAST(sum(overlap_ms) AS BIGINT) AS overlap_ms, count(DISTINCT profile) AS profiles FROM matrix GROUP BY ROLLUP (session_id, truth)",
    "macro_scores": f"WITH {_CARD} SELECT count(*) AS sessions, {_q('avg(coverage)')} AS mean_coverage, {_q('avg(precision)')} AS mean_precision, {_q('sum(correct_ms)::DOUBLE / sum(truth_ms)')} AS pooled_coverage FROM card",
    "bottom3_scores": f"WITH {_CARD}, ranked AS (SELECT coverage, row_number() OVER (ORDER BY coverage, session_id) AS place FROM card) SELECT {_q('0.55::DOUBLE * avg(coverage) + 0.30::DOUBLE * min(coverage) + 0.15::DOUBLE * avg(coverage) FILTER (WHERE place <= 3)')} AS score, {_q('avg(coverage)')} AS mean, {_q('min(coverage)')} AS worst, {_q('avg(coverage) FILTER (WHERE place <= 3)')} AS bottom3 FROM ranked",
    "gap_groups": """WITH rows_ AS (SELECT t.*, h.threshold_ms FROM turns t CROSS JOIN (SELECT unnest([0, 250, 500, 1000, 2000]) AS threshold_ms) h WHERE end_ms > start_ms),
r AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id, threshold_ms ORDER BY start_ms, end_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rows_),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > threshold_ms THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, threshold_ms ORDER BY start_ms, end_ms, idx ROWS UNBOUNDED PRECEDING) AS g FROM r),
x AS (SELECT session_id, threshold_ms, g, count(DISTINCT speaker) AS speakers, max(end_ms) - min(start_ms) AS length_ms FROM n GROUP BY ALL)
SELECT threshold_ms, count(*) AS groups, count(*) FILTER (WHERE speakers > 1) AS mixed_groups, CAST(coalesce(sum(length_ms) FILTER (WHERE speakers > 1), 0) AS BIGINT) AS mixed_ms, max(length_ms) AS longest_ms FROM x GROUP BY threshold_ms""",
    "dominant_overlap": f"WITH {_OVERLAPS}, s AS (SELECT session_id, event_id, speaker, CAST(sum(overlap_ms) AS BIGINT) AS overlap_ms, min(idx) AS idx FROM met GROUP BY ALL) SELECT session_id, event_id, speaker, overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, event_id ORDER BY overlap_ms DESC, idx, speaker DESC) AS place FROM s) WHERE place = 1",
    "bucketed_overlap": f"WITH {_OVERLAPS} SELECT session_id, count(*) AS pairs, CAST(sum(overlap_ms) AS BIGINT) AS overlap_ms FROM met GROUP BY session_id",
    "atomic_speakers": """WITH s AS (SELECT session_id, speaker, tick_ms AS start_ms, tick_ms + LEAST(hold_ms, 400) + 900 AS end_ms FROM probes),
cuts AS (SELECT DISTINCT session_id, start_ms AS s FROM s UNION SELECT session_id, end_ms FROM s),
parts AS (SELECT * FROM (SELECT session_id, s, lead(s) OVER (PARTITION BY session_id ORDER BY s) AS e FROM cuts) WHERE e IS NOT NULL),
votes AS (SELECT p.session_id, p.s, p.e, x.speaker, count(*) AS n, max(x.end_ms) AS latest FROM parts p JOIN s x ON p.session_id = x.session_id AND x.start_ms <= p.s AND x.end_ms >= p.e GROUP BY ALL),
best AS (SELECT *, rank() OVER (PARTITION BY session_id, s, e ORDER BY n DESC, latest DESC) AS place FROM votes)
SELECT session_id, s AS start_ms, e AS end_ms, min(speaker) AS speaker FROM best WHERE place = 1 GROUP BY session_id, s, e HAVING count(*) = 1""",
    "consensus_spans": f"""WITH {_MERGED}, seen AS (SELECT t.session_id, t.start_ms, t.end_ms, sum(least(t.end_ms, b_end) - greatest(t.start_ms, b_start)) AS seen FROM turns t JOIN merged m ON t.session_id = m.session_id AND t.start_ms < b_end AND b_start < t.end_ms WHERE t.end_ms > t.start_ms GROUP BY ALL),
sure AS (SELECT session_id, start_ms, end_ms FROM seen WHERE seen * 100 >= least((end_ms - start_ms) * 100, greatest(12000, (end_ms - start_ms) * 5)))
SELECT *, 'primary' AS detector FROM sure UNION ALL SELECT DISTINCT m.session_id, b_start, b_end, 'secondary' FROM merged m JOIN sure s ON m.session_id = s.session_id AND b_start <= s.end_ms AND s.start_ms <= b_end""",
    "overlap_free_turns": f"WITH {_MAP} SELECT session_id, idx, speaker FROM turns t WHERE NOT EXISTS (SELECT 1 FROM met o JOIN mapped m ON o.session_id = m.session_id AND o.profile = m.profile WHERE o.session_id = t.session_id AND o.idx = t.idx AND m.truth <> o.speaker AND o.overlap_ms > 120)",
    "hop_windows": "WITH lengths AS (SELECT session_id, max(end_ms) AS n FROM turns GROUP BY session_id) SELECT session_id, edge - 1500 AS start_ms, edge AS end_ms FROM (SELECT session_id, unnest(range(1600, n + 1, 400)) AS edge FROM lengths)",
    "window_counts": "WITH lengths AS (SELECT session_id, max(end_ms) AS n FROM turns GROUP BY session_id) SELECT session_id, CASE WHEN n >= 800 THEN (n - 800) // 400 + 1 ELSE 0 END AS w700, CASE WHEN n >= 1600 THEN (n - 1600) // 400 + 1 ELSE 0 END AS w1500, CASE WHEN n >= 3200 THEN (n - 3200) // 400 + 1 ELSE 0 END AS w3000 FROM lengths",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
