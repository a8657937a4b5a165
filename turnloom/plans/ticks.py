"""Queries of the live ticks and of hand-offs between two speakers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.operators import ticks as T
from turnloom.plans.views import run_sql, with_views

#: Ticks of a session with weights of three speakers and of nobody: one of them leads for some seconds.
TICKS = """
SELECT session_id, place, event_id % 5 <> 4 AS due, hold_ms % 11 = 0 AS release, hold_ms % 7 <> 1 AS speech, event_id % 13 <> 6 AS scored,
 CASE WHEN event_id % 17 = 3 THEN 'S2' END AS fallback, w1, w2, w3, w4, w1 + w2 + w3 + w4 AS w
FROM (SELECT session_id, event_id, hold_ms, place,
 (hold_ms * 7 + event_id) % 41 + CASE WHEN FLOOR(place / 9) % 4 = 0 THEN 60 ELSE 0 END AS w1,
 (hold_ms * 11 + event_id) % 43 + CASE WHEN FLOOR(place / 9) % 4 = 1 THEN 60 ELSE 0 END AS w2,
 (hold_ms * 13 + event_id) % 47 + CASE WHEN FLOOR(place / 9) % 4 = 2 THEN 60 ELSE 0 END AS w3,
 (hold_ms * 17 + event_id) % 53 + 1 AS w4
 FROM (SELECT session_id, event_id, hold_ms, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) AS BIGINT) AS place FROM probes) p) v"""


def _shown(spark, sf_dir, limits):
    t = run_sql(spark, sf_dir, TICKS)
    share = lambda k: F.col(f"w{k}").cast("double") / F.col("w").cast("double")
    maps = F.when(F.col("scored"), F.create_map(*(c for k, name in enumerate(("S1", "S2", "S3", T.UNKNOWN), 1) for c in (F.lit(name), share(k)))))
    out = T.shown(t.withColumn("probabilities", maps), "session_id", ["place"], limits)
    return out.withColumn("known", F.floor(F.col("known") * 10000 + 0.5).cast("long"))


def live_ticks(spark, sf_dir):
    """Who is shown at each tick."""
    return _shown(spark, sf_dir, T.Limits())


def debounced_ticks(spark, sf_dir):
    """The same where each change takes two or three ticks in a row."""
    return _shown(spark, sf_dir, T.Limits(acquire=2, switch=3, unknown_release=3, silence_release=2))


def _recursion(limits: T.Limits) -> str:
    """Ticks as a recursion over the place in the session: each row holds the state after its tick."""
    a = f"{limits.alpha!r}::DOUBLE"
    mean = lambda k: (
        f"CASE LEN(h) WHEN 1 THEN h[1][{k}] WHEN 2 THEN {a} * h[2][{k}] + (1::DOUBLE - {a}) * h[1][{k}]"
        f" ELSE {a} * h[3][{k}] + (1::DOUBLE - {a}) * ({a} * h[2][{k}] + (1::DOUBLE - {a}) * h[1][{k}]) END"
    )
    return f"""
WITH RECURSIVE ticks AS (SELECT session_id, place, due, release, speech, scored, fallback, [w1::DOUBLE / w, w2::DOUBLE / w, w3::DOUBLE / w, w4::DOUBLE / w] AS p FROM ({TICKS}) t),
walk AS (
 SELECT session_id, 0::BIGINT AS place, NULL::VARCHAR AS visible, NULL::VARCHAR AS pending, 0 AS waited, 0 AS unknowns, 0 AS silences, []::DOUBLE[][] AS history,
  NULL::VARCHAR AS candidate, NULL::DOUBLE AS known, NULL::VARCHAR AS action, NULL::VARCHAR AS reason
 FROM (SELECT DISTINCT session_id FROM ticks) s
 UNION ALL
 SELECT session_id, place, CASE WHEN act = 'clear' THEN NULL WHEN act IN ('switch', 'acquire') THEN cand ELSE visible END,
  CASE WHEN kind IN ('off', 'blank') THEN pending WHEN why = 'candidate_debounce' THEN cand END,
  CASE WHEN kind IN ('off', 'blank') THEN waited WHEN why = 'candidate_debounce' THEN wait ELSE 0 END,
  CASE WHEN kind = 'off' THEN unknowns WHEN lost THEN unknowns + 1 ELSE 0 END,
  CASE kind WHEN 'off' THEN silences WHEN 'release' THEN silences + 1 ELSE 0 END,
  CASE WHEN act IN ('clear', 'switch', 'acquire') OR (kind = 'release' AND due) THEN []::DOUBLE[][] ELSE h END,
  cand, known, act, why
 FROM (SELECT *, CASE
   WHEN kind = 'off' OR kind = 'quiet' THEN IF(visible IS NULL, 'none', 'hold')
   WHEN kind = 'release' THEN CASE WHEN visible IS NULL THEN 'none' WHEN silences + 1 >= {limits.silence_release} THEN 'clear' ELSE 'hold' END
   WHEN lost THEN CASE WHEN visible IS NULL THEN 'none' WHEN unknowns + 1 >= {limits.unknown_release} THEN 'clear' ELSE 'hold' END
   WHEN cand = visible THEN 'hold' WHEN visible IS NULL THEN IF(wait < {limits.acquire}, 'none', 'acquire') ELSE IF(wait < {limits.switch}, 'hold', 'switch') END AS act,
  CASE
   WHEN kind = 'off' THEN 'non_probe_tick' WHEN kind = 'quiet' THEN 'probe_gate_silence'
   WHEN kind = 'release' THEN IF(visible IS NOT NULL AND silences + 1 < {limits.silence_release}, 'release_debounce', 'release_gate')
   WHEN lost THEN IF(visible IS NOT NULL AND unknowns + 1 < {limits.unknown_release}, 'unknown_debounce', 'unknown')
   WHEN cand = visible THEN 'confirmed' WHEN wait < IF(visible IS NULL, {limits.acquire}, {limits.switch}) THEN 'candidate_debounce' ELSE 'known_candidate' END AS why
  FROM (SELECT *, kind IN ('blank', 'seen') AND cand IS NULL AS lost, IF(cand = pending, waited + 1, 1) AS wait
   FROM (SELECT *, GREATEST(m[1], m[2], m[3]) / total AS known,
     CASE WHEN kind = 'seen' THEN CASE WHEN GREATEST(m[1], m[2], m[3]) / total <= m[4] / total OR GREATEST(m[1], m[2], m[3]) / total < {limits.least_known!r}::DOUBLE THEN fallback
      WHEN m[1] >= m[2] AND m[1] >= m[3] THEN 'S1' WHEN m[2] >= m[3] THEN 'S2' ELSE 'S3' END END AS cand
    FROM (SELECT *, m[1] + m[2] + m[3] + m[4] AS total
     FROM (SELECT *, CASE WHEN kind = 'seen' THEN [{mean(1)}, {mean(2)}, {mean(3)}, {mean(4)}] END AS m
      FROM (SELECT *, CASE WHEN kind = 'seen' THEN LIST_APPEND(history, p)[-{limits.smoothing}:] ELSE history END AS h
       FROM (SELECT w.session_id, t.place, due, fallback, p, visible, pending, waited, unknowns, silences, history,
         CASE WHEN release THEN 'release' WHEN NOT due THEN 'off' WHEN NOT speech THEN 'quiet' WHEN NOT scored THEN 'blank' ELSE 'seen' END AS kind
        FROM walk w JOIN ticks t ON t.session_id = w.session_id AND t.place = w.place + 1) a) b) c) d) e) f) g
)
SELECT session_id, place, visible, candidate, FLOOR(known * 10000 + 0.5)::BIGINT AS known, action, reason FROM walk WHERE place > 0"""


def queries() -> dict:
    return {q.__name__: q for q in (live_ticks, debounced_ticks)}


def _sql(limits: T.Limits) -> str:
    """Recursive SQL with the derived views put in front of its own."""
    return with_views(_recursion(limits)).replace("WITH probes", "WITH RECURSIVE probes", 1).replace("RECURSIVE ticks AS", "ticks AS", 1)


def oracle_sql() -> dict[str, str]:
    return {"live_ticks": _sql(T.Limits()), "debounced_ticks": _sql(T.Limits(acquire=2, switch=3, unknown_release=3, silence_release=2))}
