"""Queries of whole-session alignment and their SQL. The similar text of a row has no SQL form; tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import alignment as A
from turnloom.plans.views import frame, run_sql, with_views

#: What a live run made of the turns: other words in some, times missing or late in some, a profile instead of the speaker.
LIVE = """
SELECT session_id, idx, text, CASE (session_id + idx) % 5 WHEN 0 THEN NULL WHEN 1 THEN CONCAT('P', CAST(idx % 3 AS VARCHAR(20))) ELSE CONCAT('P_', speaker) END AS assigned,
 CASE WHEN (session_id + idx) % 3 = 0 THEN NULL WHEN (session_id + idx) % 11 = 5 THEN start_ms + 10000000 ELSE start_ms - 700 END AS start_ms,
 CASE WHEN (session_id + idx) % 11 = 5 THEN end_ms + 10000000 ELSE end_ms + 300 END AS end_ms,
 CASE WHEN idx % 4 <> 1 THEN 900 + 10 * idx END AS duration_ms
FROM captions"""


def _sides(spark, sf_dir):
    return run_sql(spark, sf_dir, LIVE), frame(spark, sf_dir, "turns")


def session_alignment(spark, sf_dir):
    """Words of the live rows of a session aligned with those of all its turns."""
    return A.session_alignment(*_sides(spark, sf_dir), "session_id", "idx")


def trace_rows(spark, sf_dir):
    """The true speaker of each live row by time, else by aligned words."""
    out = A.trace_rows(*_sides(spark, sf_dir), "session_id", "idx", fuzzy=False)
    return out.withColumn("score", quantized(F.col("score")))


def trace_report(spark, sf_dir):
    """Scores of the live run of each session."""
    return A.trace_report(*_sides(spark, sf_dir), "session_id", "idx", fuzzy=False)


def trace_report_text(spark, sf_dir):
    """The same by texts alone, with the most similar text as a last resort."""
    return A.trace_report(*_sides(spark, sf_dir), "session_id", "idx", mode="text")


def fuzzy_matches(spark, sf_dir):
    """The most similar turn of the session for each live row."""
    return A.best_texts(*_sides(spark, sf_dir), "session_id", "idx").withColumn("score", quantized(F.col("score"), 9))


#: The table of longest common subsequences of each session, a live word at a time, and the way back through it.
_WALK = f"""
live AS ({LIVE}),
lw AS (SELECT session_id, idx, CAST(k - 1 AS INT) AS word, w, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx, k) AS i
 FROM (SELECT session_id, idx, UNNEST(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT session_id, idx, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM live) a) b),
tw AS (SELECT session_id, idx, speaker, CAST(k - 1 AS INT) AS word, w, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx, k) AS j
 FROM (SELECT session_id, idx, speaker, UNNEST(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT session_id, idx, speaker, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM turns) a) b),
grid AS (
 SELECT session_id, 0::BIGINT AS i, j, w, 0 AS c FROM tw
 UNION ALL
 SELECT session_id, i, j, w, MAX(CASE WHEN same THEN up + 1 ELSE c END) OVER (PARTITION BY session_id ORDER BY j) AS c
 FROM (SELECT g.session_id, l.i, g.j, g.w, g.c, g.w = l.w AS same, COALESCE(LAG(g.c) OVER (PARTITION BY g.session_id ORDER BY g.j), 0) AS up
  FROM grid g JOIN lw l ON l.session_id = g.session_id AND l.i = g.i + 1) s
),
cells AS (SELECT session_id, i, LIST(c ORDER BY j) AS cs, MAX(j) AS m FROM grid GROUP BY session_id, i),
words AS (SELECT session_id, LIST(w ORDER BY j) AS ws FROM tw GROUP BY session_id),
back AS (
 SELECT session_id, i, m AS j, FALSE AS met, 0::BIGINT AS a, 0::BIGINT AS b FROM (SELECT session_id, i, m, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY i DESC) AS r FROM cells) c WHERE r = 1
 UNION ALL
 SELECT session_id, CASE WHEN same OR NOT aside THEN i - 1 ELSE i END, CASE WHEN same OR aside THEN j - 1 ELSE j END, same, i, j
 FROM (SELECT k.session_id, k.i, k.j, v.ws[k.j] = l.w AS same, p.cs[k.j] < CASE WHEN k.j > 1 THEN o.cs[k.j - 1] ELSE 0 END AS aside
  FROM back k JOIN lw l ON l.session_id = k.session_id AND l.i = k.i JOIN words v ON v.session_id = k.session_id
  JOIN cells o ON o.session_id = k.session_id AND o.i = k.i JOIN cells p ON p.session_id = k.session_id AND p.i = k.i - 1 WHERE k.i > 0 AND k.j > 0) s
),
pairs AS (SELECT l.session_id, l.idx, l.word, t.idx AS other, t.word AS other_word, t.speaker, t.j
 FROM back k JOIN lw l ON l.session_id = k.session_id AND l.i = k.a JOIN tw t ON t.session_id = k.session_id AND t.j = k.b WHERE k.met)"""

_ROWS = """,
votes AS (SELECT session_id, idx, speaker, COUNT(*) AS n, MIN(j) AS first FROM pairs GROUP BY session_id, idx, speaker),
aligned AS (SELECT v.session_id, v.idx, v.speaker, v.n / s.n AS share
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, idx ORDER BY n DESC, first) AS r FROM votes) v
 JOIN (SELECT session_id, idx, COUNT(*) AS n FROM lw GROUP BY session_id, idx) s ON s.session_id = v.session_id AND s.idx = v.idx WHERE r = 1),
heard AS (SELECT l.session_id, l.idx, t.speaker, SUM(LEAST(l.end_ms, t.end_ms) - GREATEST(l.start_ms, t.start_ms)) AS ms, MIN(t.idx) AS first
 FROM live l JOIN turns t ON t.session_id = l.session_id AND l.start_ms < t.end_ms AND t.start_ms < l.end_ms WHERE l.end_ms > l.start_ms AND t.end_ms > t.start_ms GROUP BY l.session_id, l.idx, t.speaker),
timed AS (SELECT session_id, idx, FIRST(speaker ORDER BY ms DESC, first) AS speaker, MAX(ms) AS ms, SUM(ms) AS total FROM heard GROUP BY session_id, idx),
found AS (SELECT l.session_id, l.idx, l.assigned, COALESCE(l.end_ms > l.start_ms, FALSE) AS timed,
 CAST(CASE WHEN l.end_ms > l.start_ms THEN GREATEST(COALESCE(l.duration_ms, 0), l.end_ms - l.start_ms) ELSE COALESCE(l.duration_ms, 0) END AS BIGINT) AS duration_ms,
 CAST(COALESCE(o.ms, 0) AS BIGINT) AS overlap_ms, CAST(COALESCE(o.total, 0) AS BIGINT) AS total_ms,
 CASE WHEN o.speaker IS NOT NULL THEN o.speaker WHEN a.share >= 0.34 THEN a.speaker END AS speaker,
 CASE WHEN o.speaker IS NULL AND a.share >= 0.34 THEN FLOOR(a.share * 1000000 + 0.5) / 1000000 END AS score,
 CASE WHEN o.speaker IS NULL AND a.share >= 0.34 THEN 'text_lcs' WHEN l.end_ms > l.start_ms THEN 'timestamp' ELSE 'unmatched' END AS found_by
 FROM live l LEFT JOIN timed o ON o.session_id = l.session_id AND o.idx = l.idx LEFT JOIN aligned a ON a.session_id = l.session_id AND a.idx = l.idx)"""

_REPORT = """,
mapped AS (SELECT session_id, assigned, FIRST(speaker ORDER BY w DESC, first) AS mapped
 FROM (SELECT session_id, assigned, speaker, SUM(GREATEST(duration_ms, 1)) AS w, MIN(idx) AS first FROM found WHERE assigned <> '' AND speaker IS NOT NULL GROUP BY ALL) m GROUP BY session_id, assigned),
sums AS (SELECT f.session_id, COUNT(*) AS segments, COUNT(*) FILTER (timed) AS timed_segments, COUNT(*) FILTER (found_by IN ('text_lcs', 'text')) AS text_matched, COUNT(*) FILTER (COALESCE(f.assigned, '') = '') AS unknown,
 COUNT(*) FILTER (speaker IS NOT NULL) AS scored, COUNT(*) FILTER (mapped = speaker) AS good, COALESCE(SUM(duration_ms) FILTER (speaker IS NOT NULL), 0) AS ms, COALESCE(SUM(duration_ms) FILTER (mapped = speaker), 0) AS good_ms
 FROM found f LEFT JOIN mapped m ON m.session_id = f.session_id AND m.assigned = f.assigned GROUP BY f.session_id),
sizes AS (SELECT s.session_id, (SELECT COUNT(*) FROM lw WHERE lw.session_id = s.session_id) AS live_words, (SELECT COUNT(*) FROM tw WHERE tw.session_id = s.session_id) AS truth_words,
 (SELECT COUNT(*) FROM pairs WHERE pairs.session_id = s.session_id) AS lcs_words FROM sums s)
SELECT s.session_id, segments, timed_segments, text_matched, unknown, truth_words, live_words, lcs_words,
 CASE WHEN truth_words > 0 THEN FLOOR(lcs_words / truth_words * 10000.0::DOUBLE + 0.5) / 10000 ELSE 0 END AS text_recall,
 CASE WHEN live_words > 0 THEN FLOOR(lcs_words / live_words * 10000.0::DOUBLE + 0.5) / 10000 ELSE 0 END AS text_precision,
 CASE WHEN scored > 0 THEN FLOOR(good / scored * 10000.0::DOUBLE + 0.5) / 10000 ELSE 0 END AS segment_accuracy,
 CASE WHEN ms > 0 THEN FLOOR(good_ms / ms * 10000.0::DOUBLE + 0.5) / 10000 ELSE 0 END AS duration_accuracy
FROM sums s JOIN sizes z ON z.session_id = s.session_id"""

SQL = {
    "session_alignment": "SELECT session_id, idx, word, other, other_word FROM pairs",
    "trace_rows": f"{_ROWS} SELECT * FROM found",
    "trace_report": _ROWS + _REPORT,
}


def queries() -> dict:
    return {q.__name__: q for q in (session_alignment, trace_rows, trace_report, trace_report_text, fuzzy_matches)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views("WITH " + _WALK.strip() + " " + sql).replace("WITH ", "WITH RECURSIVE ", 1) for name, sql in SQL.items()}
