"""Queries of hand-off gates, word timings and review states, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import reviews as R
from turnloom.plans.views import run_sql, with_views

#: Four speakers on both sides of a gap; S1 leads on the left and S2 on the right, some cases lack a score.
CONTEXTS = """
SELECT session_id, event_id, 'S1' AS speaker_a, 'S2' AS speaker_b, CASE WHEN k < 4 THEN 'left' ELSE 'right' END AS side, CONCAT('S', CAST(k % 4 + 1 AS VARCHAR(9))) AS speaker,
 CAST((event_id * (37 + 17 * k) + hold_ms * (k + 3)) % 400 + CASE WHEN k = 0 OR k = 5 THEN 300 + event_id % 400 ELSE 0 END AS DOUBLE) / CAST(1000 AS DOUBLE) AS similarity
FROM probes, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) s
WHERE event_id % 19 <> k"""

WORDS = """
SELECT session_id, event_id, tick_ms, CASE event_id % 6 WHEN 0 THEN 'yes.' WHEN 1 THEN 'well' WHEN 2 THEN '...' WHEN 3 THEN 'it is' WHEN 4 THEN 'no!' ELSE 'and Then we-go' END AS word,
 CASE WHEN event_id % 9 <> 4 THEN CAST(FLOOR(tick_ms / 6000) AS BIGINT) END AS segment, CAST(FLOOR(tick_ms / 5) AS BIGINT) AS start_ms, CAST(FLOOR(tick_ms / 5) + hold_ms % 4 * 45 AS BIGINT) AS end_ms
FROM probes"""

REPORTS = "SELECT DISTINCT session_id, CASE WHEN session_id % 11 = 5 THEN 'stale' ELSE 'draft' END AS status FROM turns"

OBJECTS = """
SELECT session_id, idx, CASE WHEN session_id % 4 = 0 OR (session_id % 4 = 1 AND idx % 2 = 0) THEN CASE idx % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'edited' END
 WHEN session_id % 4 = 3 AND idx = 2 THEN 'stale' WHEN idx % 5 <> 1 THEN 'draft' END AS status
FROM turns WHERE session_id % 13 <> 6"""


def context_handoffs(spark, sf_dir):
    out = R.context_handoffs(run_sql(spark, sf_dir, CONTEXTS), ["session_id", "event_id"])
    return out.select("session_id", "event_id", "accepted", "reason", *(quantized(F.col(c)).alias(c) for c in ("left_pair", "right_pair", "left_lead", "right_lead", "separation")))


def timing_faults(spark, sf_dir):
    out = R.timing_faults(run_sql(spark, sf_dir, WORDS), "session_id", ["tick_ms", "event_id"], "word", "segment", "start_ms", "end_ms")
    return out.select("session_id", "event_id", "sentence", "impossible")


def review_states(spark, sf_dir):
    return R.review_states(run_sql(spark, sf_dir, REPORTS), run_sql(spark, sf_dir, OBJECTS), "session_id")


def _q(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def _picked(side: str, cond: str) -> str:
    return f"max(similarity) FILTER (WHERE side = '{side}' AND speaker {cond})"


SQL = {
    "context_handoffs": f"""
WITH c AS ({CONTEXTS}),
g AS (SELECT session_id, event_id, {_picked('left', "= 'S1'")} AS la, {_picked('left', "= 'S2'")} AS lb, {_picked('left', "<> 'S1'")} AS ln,
 {_picked('right', "= 'S2'")} AS ra, {_picked('right', "= 'S1'")} AS rb, {_picked('right', "<> 'S2'")} AS rn FROM c GROUP BY session_id, event_id),
d AS (SELECT *, coalesce(la - lb, 0) AS lp, coalesce(ra - rb, 0) AS rp, CASE WHEN la - lb IS NULL THEN 0 ELSE la - ln END AS ll, CASE WHEN ra - rb IS NULL THEN 0 ELSE ra - rn END AS rl FROM g),
r AS (SELECT *, CASE WHEN la IS NULL OR lb IS NULL OR ra IS NULL OR rb IS NULL THEN 'missing_context_profile_score' WHEN la < 0.35::DOUBLE OR ra < 0.35::DOUBLE THEN 'weak_context_similarity'
 WHEN lp < 0.15::DOUBLE OR rp < 0.15::DOUBLE THEN 'weak_context_pair_margin' WHEN ll < 0.08::DOUBLE OR rl < 0.08::DOUBLE THEN 'context_matches_third_speaker'
 WHEN lp + rp < 0.5::DOUBLE THEN 'weak_context_separation' ELSE 'accepted' END AS reason FROM d)
SELECT session_id, event_id, reason = 'accepted' AS accepted, reason, {_q('lp')} AS left_pair, {_q('rp')} AS right_pair, {_q('ll')} AS left_lead, {_q('rl')} AS right_lead, {_q('lp + rp')} AS separation FROM r""",
    "timing_faults": rf"""
WITH w AS ({WORDS}),
l AS (SELECT *, row_number() OVER o AS k, lag(word) OVER o AS pw, lag(segment) OVER o AS ps FROM w WINDOW o AS (PARTITION BY session_id ORDER BY tick_ms, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(pw, '[.!?]$') OR ps <> segment THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY k) AS BIGINT) AS sentence,
 len(regexp_extract_all(word, '[A-Za-z]+')) AS tokens FROM l),
f AS (SELECT session_id, sentence, sum(tokens) AS n, max(end_ms) FILTER (WHERE tokens > 0) - min(start_ms) FILTER (WHERE tokens > 0) AS span, count(*) FILTER (WHERE tokens > 0 AND end_ms <= start_ms) AS flat FROM s GROUP BY ALL)
SELECT s.session_id, event_id, s.sentence, n > 0 AND (span <= 0 OR (n >= 2 AND span < 40 * n) OR (flat >= 2 AND span < 250)) AS impossible FROM s JOIN f ON s.session_id = f.session_id AND s.sentence = f.sentence""",
    "review_states": f"""
WITH r AS ({REPORTS}), o AS ({OBJECTS}),
j AS (SELECT r.session_id, any_value(r.status) AS was, list(coalesce(o.status, 'draft')) FILTER (WHERE o.session_id IS NOT NULL) AS states FROM r LEFT JOIN o ON r.session_id = o.session_id GROUP BY r.session_id),
s AS (SELECT session_id, states, CASE WHEN was = 'stale' OR list_contains(states, 'stale') THEN 'stale' WHEN states IS NULL THEN 'draft'
 WHEN len(list_filter(states, lambda x: x NOT IN ('accepted', 'rejected', 'edited'))) = 0 THEN 'reviewed' WHEN len(list_filter(states, lambda x: x IN ('accepted', 'rejected', 'edited'))) > 0 THEN 'partially_reviewed' ELSE 'draft' END AS status FROM j)
SELECT session_id, status, status <> 'reviewed' AS needs_review, CAST(coalesce(len(list_filter(states, lambda x: x = 'stale')), 0) AS BIGINT) AS stale_objects FROM s""",
}


def queries() -> dict:
    return {q.__name__: q for q in (context_handoffs, timing_faults, review_states)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
