"""Queries of rows regrouped by session, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import segments as S
from turnloom.plans.views import run_sql, with_views

#: Few long stretches of two labels, broken by short runs of others and by unknown rows.
SCATTERED = """
SELECT session_id, event_id AS idx, CASE WHEN event_id % 7 = 3 THEN 'retro' ELSE 'live' END AS source,
 CASE WHEN event_id % 13 = 5 THEN CAST(NULL AS VARCHAR(9)) WHEN tick_ms % 5200 = 2000 THEN CONCAT('S', CAST(3 + hold_ms % 20 AS VARCHAR(9))) WHEN FLOOR(tick_ms / 4000) % 2 = 0 THEN 'S1' ELSE 'S2' END AS speaker,
 CAST(hold_ms % 6000 AS BIGINT) AS duration_ms, CAST(hold_ms % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS top_similarity, CASE WHEN hold_ms % 17 <> 2 THEN CAST(event_id % 80 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS margin
FROM probes"""

#: A few sessions of many rows, with and without topic words.
TALKS = """
SELECT user_id % 7 AS session_id, event_id AS idx, CASE event_id % 37 WHEN 3 THEN 'Moving on, please' WHEN 11 THEN 'the risks stay' WHEN 20 THEN 'one RISK less' WHEN 30 THEN NULL ELSE event_type END AS text
FROM events WHERE user_id % 7 <> 4
UNION ALL SELECT 4 AS session_id, event_id AS idx, event_type AS text FROM events"""

#: Sentences every 1.5 s, three unknown ones in each seven; many repeat the vector of one or two before.
UNKNOWN = """
SELECT session_id, idx, CASE WHEN idx % 7 > 2 THEN speaker END AS speaker, 1500 * idx AS start_ms, 1500 * idx + duration_ms AS end_ms, embedding,
 CASE WHEN idx % 11 <> 4 THEN CAST((idx * 37 + session_id) % 70 AS DOUBLE) / CAST(100 AS DOUBLE) END AS top_similarity, CAST(idx % 5 AS DOUBLE) / CAST(20 AS DOUBLE) AS margin, CAST(idx % 9 AS DOUBLE) / CAST(20 AS DOUBLE) AS unknown_probability
FROM (SELECT session_id, idx, speaker, duration_ms, CASE idx % 7 WHEN 1 THEN COALESCE(LAG(embedding, 1) OVER (PARTITION BY session_id ORDER BY idx), embedding) WHEN 2 THEN COALESCE(LAG(embedding, 2) OVER (PARTITION BY session_id ORDER BY idx), embedding) ELSE embedding END AS embedding FROM sentences) o"""

LINES = """
SELECT session_id, idx + 1 AS line_no, CASE WHEN idx % 6 = 4 THEN text WHEN idx % 6 = 5 THEN '[1:02 - 1:03] Dr. Who:   ' ELSE
 CONCAT('[', CASE WHEN idx % 2 = 1 THEN '1:' ELSE '' END, CAST(CAST(FLOOR(start_ms / 60000) AS BIGINT) AS VARCHAR(9)), ':', CAST(CAST(FLOOR(start_ms / 1000) AS BIGINT) % 60 AS VARCHAR(9)), '.5 - 2:', CAST(idx AS VARCHAR(9)), ':07.25]  ',
  CASE idx % 3 WHEN 0 THEN CONCAT(speaker, ' 00', CAST(idx AS VARCHAR(9))) WHEN 1 THEN CONCAT('Dr.  (', speaker, ')') ELSE '?!' END, ':  ', REPLACE(text, CHR(10), '  ')) END AS line
FROM turns"""


def merged_fragments(spark, sf_dir):
    return S.merge_fragments(run_sql(spark, sf_dir, SCATTERED), "session_id").select("session_id", "idx", "speaker", "fixed")


def doubtful_splits(spark, sf_dir):
    return S.split_doubtful(run_sql(spark, sf_dir, SCATTERED), "session_id").select("session_id", "idx", "speaker", "fixed")


def topic_segments(spark, sf_dir):
    return S.topic_segments(run_sql(spark, sf_dir, TALKS), "session_id")


def unknown_pairs(spark, sf_dir):
    return S.unknown_pairs(run_sql(spark, sf_dir, UNKNOWN), "session_id").withColumn("similarity", quantized(F.col("similarity")))


def transcript_lines(spark, sf_dir):
    out = S.transcript_lines(run_sql(spark, sf_dir, LINES), "session_id", "line_no")
    return out.withColumns({"index": F.col("index").cast("long"), "start": quantized(F.col("start")), "end": quantized(F.col("end"))}).select("session_id", "index", "source_line", "start", "end", "speaker_name", "speaker_id", "text")


def _q(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


_COS = "list_dot_product(n.e, t.e) / (sqrt(list_dot_product(n.e, n.e)) * sqrt(list_dot_product(t.e, t.e)))"
_SECONDS = "list_reduce(list_prepend(0::DOUBLE, list_transform(string_split({x}, ':'), lambda p: CAST(p AS DOUBLE))), lambda s, p: s * 60 + p)"

SQL = {
    "merged_fragments": f"""
WITH c AS ({SCATTERED}),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS p FROM c),
f AS (SELECT *, sum(CASE WHEN p > 1 AND was IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY p) AS run
 FROM (SELECT *, lag(speaker) OVER (PARTITION BY session_id ORDER BY p) AS was FROM k) x),
i AS (SELECT session_id, run, speaker, sum(duration_ms) AS ms, count(*) AS n FROM f WHERE speaker IS NOT NULL GROUP BY ALL),
small AS (SELECT session_id, speaker FROM i GROUP BY ALL HAVING sum(ms) <= 6000 AND sum(n) <= 8 AND count(*) BETWEEN 2 AND 3),
v AS (SELECT session_id, speaker, unnest([
  (SELECT arg_max(o.speaker, o.run) FROM i o WHERE o.session_id = i.session_id AND o.run < i.run AND o.speaker <> i.speaker),
  (SELECT arg_min(o.speaker, o.run) FROM i o WHERE o.session_id = i.session_id AND o.run > i.run AND o.speaker <> i.speaker)]) AS into_label FROM i SEMI JOIN small USING (session_id, speaker)),
w AS (SELECT session_id, speaker, into_label, count(*) AS n FROM v WHERE into_label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, max(n) OVER g AS top, sum(n) OVER g AS total FROM w WINDOW g AS (PARTITION BY session_id, speaker)),
b AS (SELECT session_id, speaker, any_value(into_label) AS into_label FROM r WHERE n = top AND 2 * n >= total GROUP BY session_id, speaker HAVING count(*) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM small s WHERE s.session_id = b.session_id AND s.speaker = b.into_label))
SELECT c.session_id, idx, c.speaker, coalesce(into_label, c.speaker) AS fixed FROM c LEFT JOIN d ON c.session_id = d.session_id AND c.speaker = d.speaker""",
    "doubtful_splits": f"""
WITH c AS ({SCATTERED}),
f AS (SELECT session_id, min(idx) AS idx FROM c WHERE source = 'retro' AND speaker IS NOT NULL AND duration_ms >= 4000 AND top_similarity <= 0.06::DOUBLE AND margin <= 0.04::DOUBLE GROUP BY session_id),
n AS (SELECT session_id, max(CAST(speaker[2:] AS BIGINT)) + 1 AS fresh FROM c GROUP BY session_id)
SELECT c.session_id, c.idx, speaker, CASE WHEN f.idx IS NOT NULL THEN concat('S', fresh) ELSE speaker END AS fixed
FROM c JOIN n ON c.session_id = n.session_id LEFT JOIN f ON c.session_id = f.session_id AND c.idx = f.idx""",
    "topic_segments": rf"""
WITH RECURSIVE c AS MATERIALIZED (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS p, coalesce(regexp_matches(text, '(?i)\b({S.TOPIC_CUES})\b'), false) AS cue FROM ({TALKS}) x),
cues AS MATERIALIZED (SELECT session_id, list(p ORDER BY p) AS cue_rows FROM c WHERE cue GROUP BY session_id),
ends AS MATERIALIZED (SELECT session_id, max(p) AS n FROM c GROUP BY session_id),
s AS (SELECT session_id, 1::BIGINT AS segment, 1::BIGINT AS p FROM ends
 UNION ALL SELECT s.session_id, segment + 1, least(p + 80, coalesce(list_filter(cue_rows, lambda x: x >= p + 16)[1], p + 80)) FROM s JOIN ends ON s.session_id = ends.session_id LEFT JOIN cues ON s.session_id = cues.session_id
 WHERE least(p + 80, coalesce(list_filter(cue_rows, lambda x: x >= p + 16)[1], p + 80)) <= n),
b AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY session_id ORDER BY segment), 9223372036854775807) AS until FROM s)
SELECT b.session_id, segment, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS rows FROM b JOIN c ON b.session_id = c.session_id AND c.p >= b.p AND c.p < until GROUP BY b.session_id, segment""",
    "unknown_pairs": f"""
WITH c AS (SELECT * EXCLUDE (embedding), CAST(embedding AS DOUBLE[]) AS e FROM ({UNKNOWN}) x WHERE speaker IS NULL),
p AS (SELECT n.session_id, n.idx, t.idx AS partner_idx, n.start_ms - t.end_ms AS gap_ms, {_COS} AS similarity FROM c n JOIN c t ON n.session_id = t.session_id AND n.idx <> t.idx AND n.start_ms - t.end_ms BETWEEN 0 AND 4000
 WHERE n.end_ms - n.start_ms >= 2500 AND t.end_ms - t.start_ms >= 200 AND n.top_similarity <= 0.55::DOUBLE AND n.margin <= 0.2::DOUBLE AND n.unknown_probability >= 0.1::DOUBLE)
SELECT session_id, idx, partner_idx, {_q('similarity')} AS similarity, gap_ms FROM p WHERE similarity >= 0.45::DOUBLE QUALIFY row_number() OVER (PARTITION BY session_id, idx ORDER BY similarity DESC, partner_idx) = 1""",
    "transcript_lines": rf"""
WITH l AS ({LINES}),
m AS (SELECT session_id, line_no, regexp_extract(line, '{S.TRANSCRIPT_LINE}', ['a', 'b', 'c', 'd']) AS g FROM l WHERE regexp_matches(line, '{S.TRANSCRIPT_LINE}')),
r AS (SELECT session_id, line_no AS source_line, {_SECONDS.format(x='g.a')} AS s, {_SECONDS.format(x='g.b')} AS e, trim(regexp_replace(g.c, '\s+', ' ', 'g')) AS speaker_name, trim(regexp_replace(g.d, '\s+', ' ', 'g')) AS text FROM m)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY source_line) AS "index", source_line, {_q('s')} AS start, {_q('e')} AS "end", speaker_name,
 CASE WHEN regexp_matches(speaker_name, '[0-9]$') THEN concat('S', CAST(regexp_extract(speaker_name, '[0-9]+$') AS BIGINT)) ELSE coalesce(nullif(left(trim(regexp_replace(speaker_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), 40), ''), 'speaker') END AS speaker_id, text
FROM r WHERE text <> ''""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
