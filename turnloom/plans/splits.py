"""Queries of late corrections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import splits as S
from turnloom.plans.views import run_sql, with_views

_D = 6
_NUMBERS = ", ".join(f"CASE WHEN voice = {d} THEN 64 ELSE 0 END + (duration_ms * {7 + 4 * d} + idx * {3 + d}) % 37 - 18 AS e{d}" for d in range(_D))

#: Rows of a session with two labels; in most sessions one of them holds a second voice, in some once, briefly or far apart.
ROWS = f"""
SELECT session_id, idx, speaker, source, unknown, start_ms, start_ms + duration_ms AS end_ms, duration_ms, idx % 17 = 4 AS confirmed, idx % 19 = 6 AS rejected, voice, {_NUMBERS}
FROM (SELECT session_id, idx, speaker, voice, CAST(CASE WHEN session_id % 5 = 3 AND voice = 2 THEN FLOOR(duration_ms / 8) ELSE duration_ms END AS BIGINT) AS duration_ms,
  CASE WHEN voice IN (2, 4) AND idx % 2 = 0 THEN 'short_hold' WHEN idx % 11 = 5 THEN NULL WHEN idx % 13 = 7 THEN ' Section_gap_new_speaker' ELSE 'embedding' END AS source,
  CASE WHEN voice IN (2, 4) THEN 0.6 WHEN idx % 7 = 3 THEN 0.55 WHEN idx % 10 = 8 THEN NULL ELSE 0.1 END AS unknown,
  CAST(CASE WHEN session_id % 5 = 4 THEN idx * 900 ELSE idx * 7000 END AS BIGINT) AS start_ms
 FROM (SELECT session_id, idx, duration_ms, CASE WHEN idx % 5 < 3 THEN 'A' WHEN idx = 9 THEN NULL ELSE 'B' END AS speaker, CASE WHEN idx % 5 < 3 AND (idx + session_id) % 3 = 0 AND session_id % 4 <> 2 THEN 2 WHEN idx % 5 < 3 THEN 0 WHEN session_id % 3 = 1 AND idx % 4 < 2 THEN 4 ELSE 1 END AS voice FROM sentences) s) t"""


def _rows(spark, sf_dir):
    r = run_sql(spark, sf_dir, ROWS)
    return r.withColumns({"embedding": F.array(*(F.col(f"e{d}").cast("double") for d in range(_D))), "unknown": F.col("unknown").cast("double")})


def delayed_splits(spark, sf_dir):
    """Labels that hold a second voice."""
    out = S.delayed_splits(_rows(spark, sf_dir), "session_id", "idx")
    number = {c: quantized(F.col(c), 4) for c in ("average_gain", "leave_one_out", "core_similarity")}
    return out.withColumns({**number, "time_groups": F.col("time_groups").cast("int"), "members": F.array_join("members", ",")})


def split_rows(spark, sf_dir):
    """The rows with the labels of the splits."""
    rows = _rows(spark, sf_dir)
    return S.with_splits(rows, S.delayed_splits(rows, "session_id", "idx"), "session_id", "idx").select("session_id", "idx", "speaker", "fixed")


#: Unknown rows, and the profiles of their session: one in each third one.
_UNKNOWN = f"SELECT session_id, idx, CASE WHEN idx % 6 = 0 THEN 'new_speaker_pending' WHEN idx % 6 = 3 THEN NULL ELSE 'embedding' END AS source, duration_ms AS speech_ms, idx % 9 = 4 AS needs_review, {', '.join(f'e{d} + CASE WHEN idx % 4 = 1 THEN 40 * {d % 3} ELSE 0 END AS e{d}' for d in range(_D))} FROM ({ROWS}) r WHERE idx % 3 <> 2"
_LABELS = "SELECT session_id, speaker AS label FROM (SELECT DISTINCT session_id, speaker FROM (" + ROWS + ") r WHERE speaker IS NOT NULL) s WHERE session_id % 3 <> 1 OR speaker = 'B'"


def revisited(spark, sf_dir):
    """Unknown rows that a profile explains by now."""
    rows = run_sql(spark, sf_dir, _UNKNOWN)
    rows = rows.withColumn("embedding", F.array(*(F.col(f"e{d}").cast("double") for d in range(_D))))
    centroid = F.when(F.col("label") == "A", F.array(*map(F.lit, _CENTROIDS["A"]))).otherwise(F.array(*map(F.lit, _CENTROIDS["B"])))
    out = S.revisited(rows, run_sql(spark, sf_dir, _LABELS).withColumn("centroid", centroid), "session_id", "idx", short_ms=2000)
    return out.withColumns({c: quantized(F.col(c), 4) for c in ("similarity", "margin")})


_CENTROIDS = {"A": [1.0, 0.1, 0.2, 0.0, 0.1, 0.1], "B": [0.1, 1.0, 0.2, 0.1, 0.0, 0.1]}


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt({_dot(v, v)}))"


_E = "[" + ", ".join(f"e{d}::DOUBLE" for d in range(_D)) + "]"


def _total(of: str) -> str:
    """Weighted sums of the unit vectors of each label's rows."""
    return f"SELECT session_id, speaker, COUNT(*) AS n, [{', '.join(f'SUM(u[{d + 1}] * w)' for d in range(_D))}] AS total FROM {of} GROUP BY session_id, speaker"


def _splits(l: S.Limits) -> str:
    trusted = "COALESCE(lower(trim(source)) IN ('" + "', '".join(S.TRUSTED) + "'), FALSE)"
    rounds = "".join(
        f""",
c{k} AS MATERIALIZED (SELECT session_id, speaker, {_unit("total")} AS c FROM ({_total(f"f{k - 1}")}) s WHERE n >= {l.rows}),
f{k} AS MATERIALIZED (SELECT p.* FROM pool p JOIN c{k} c ON c.session_id = p.session_id AND c.speaker = p.speaker WHERE {_dot("p.u", "c.c")} >= {l.candidate_similarity} AND {_dot("p.u", "c.c")} - p.best >= {l.candidate_gain})"""
        for k in range(1, l.iterations + 1)
    )
    return f"""
r AS (SELECT *, {_unit(_E)} AS u, sqrt(GREATEST(0.2, LEAST(2.25, duration_ms / 1000.0::DOUBLE)))::DOUBLE AS w, {trusted} AND duration_ms >= {l.core_ms} AND COALESCE(unknown <= {l.core_unknown}, TRUE) AS core,
 NOT confirmed AND NOT rejected AND duration_ms >= {l.candidate_ms} AND (NOT {trusted} OR COALESCE(unknown >= {l.candidate_unknown}, FALSE)) AS in_pool FROM ({ROWS}) t WHERE speaker <> ''),
k AS (SELECT * FROM r WHERE core),
cores AS MATERIALIZED (SELECT s.session_id, s.speaker, {_unit("total")} AS c FROM ({_total("k")}) s JOIN (SELECT session_id, speaker FROM k GROUP BY ALL HAVING COUNT(*) >= {l.core_rows} AND SUM(duration_ms) >= {l.core_total_ms}) e ON e.session_id = s.session_id AND e.speaker = s.speaker),
pool AS MATERIALIZED (SELECT * FROM (SELECT p.session_id, p.speaker, p.idx, p.start_ms, p.end_ms, p.duration_ms, p.u, p.w, MAX({_dot("p.u", "c.c")}) AS best, MAX({_dot("p.u", "c.c")}) FILTER (c.speaker = p.speaker) AS own FROM r p JOIN cores c ON c.session_id = p.session_id WHERE p.in_pool GROUP BY ALL) q WHERE own IS NOT NULL),
f0 AS MATERIALIZED (SELECT * FROM pool WHERE own <= {l.seed_similarity}){rounds},
t AS (SELECT * FROM ({_total(f"f{l.iterations}")}) s WHERE n >= {l.rows}),
near AS (SELECT t.session_id, t.speaker, MAX({_dot(_unit("t.total"), "c.c")}) AS core_similarity FROM t JOIN cores c ON c.session_id = t.session_id GROUP BY ALL),
each AS (SELECT f.*, n.core_similarity, {_dot("f.u", _unit("t.total"))} - f.best AS gain, list_transform(list_zip(t.total, f.u), lambda z: z[1] - z[2] * f.w) AS o,
 CASE WHEN COALESCE(f.start_ms - MAX(f.end_ms) OVER (PARTITION BY f.session_id, f.speaker ORDER BY f.start_ms, f.end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {l.time_gap_ms}, ROW_NUMBER() OVER (PARTITION BY f.session_id, f.speaker ORDER BY f.start_ms, f.end_ms) = 1) THEN 1 ELSE 0 END AS fresh
 FROM f{l.iterations} f JOIN t ON t.session_id = f.session_id AND t.speaker = f.speaker JOIN near n ON n.session_id = f.session_id AND n.speaker = f.speaker),
splits AS (SELECT session_id, speaker, COUNT(*) AS rows, CAST(SUM(duration_ms) AS BIGINT) AS speech_ms, AVG(gain) AS average_gain, AVG({_dot("u", _unit("o"))}) AS leave_one_out, ANY_VALUE(core_similarity) AS core_similarity,
 SUM(fresh)::INT AS time_groups, LIST(idx ORDER BY idx) AS members FROM each GROUP BY session_id, speaker
 HAVING COUNT(*) >= {l.rows} AND SUM(duration_ms) >= {l.total_ms} AND MAX(duration_ms) >= {l.anchor_ms} AND MAX(end_ms) - MIN(start_ms) >= {l.span_ms} AND SUM(fresh) >= {l.time_groups}
  AND ANY_VALUE(core_similarity) <= {l.core_similarity} AND AVG(gain) >= {l.average_gain} AND AVG({_dot("u", _unit("o"))}) >= {l.leave_one_out})
"""


def _q(x: str) -> str:
    return f"FLOOR({x} * 10000 + 0.5) / 10000"


_REVISITED = f"""WITH c AS (SELECT *, CASE WHEN label = 'A' THEN {_CENTROIDS["A"]!r}::DOUBLE[] ELSE {_CENTROIDS["B"]!r}::DOUBLE[] END AS c FROM ({_LABELS}) l),
s AS (SELECT r.session_id, r.idx, GREATEST(0.02, CASE WHEN source = 'new_speaker_pending' THEN 0.5801 ELSE 0 END, CASE WHEN speech_ms < 2000 THEN 0.45 ELSE 0 END) AS least, label, {_dot("e", "c.c")} / (sqrt({_dot("e", "e")}) * sqrt({_dot("c.c", "c.c")})) AS s
 FROM (SELECT *, {_E} AS e FROM ({_UNKNOWN}) u WHERE NOT needs_review) r JOIN c ON c.session_id = r.session_id),
a AS (SELECT session_id, idx, least, list({{'s': -s, 'label': label}} ORDER BY -s, label) AS l FROM s GROUP BY ALL)
SELECT session_id, idx, l[1].label AS speaker, {_q("-l[1].s")} AS similarity, {_q("COALESCE(l[2].s - l[1].s, 1)")} AS margin FROM a WHERE -l[1].s >= least AND (LEN(l) > 1 OR -l[1].s >= 0.45)"""

SQL = {
    "delayed_splits": "WITH " + _splits(S.Limits()).strip() + f" SELECT session_id, speaker, rows, speech_ms, {_q('average_gain')} AS average_gain, {_q('leave_one_out')} AS leave_one_out, {_q('core_similarity')} AS core_similarity, time_groups, array_to_string(members, ',') AS members FROM splits",
    "split_rows": "WITH " + _splits(S.Limits()).strip() + f" SELECT r.session_id, r.idx, r.speaker, CASE WHEN s.speaker IS NULL THEN r.speaker ELSE s.speaker || '/2' END AS fixed FROM ({ROWS}) r LEFT JOIN splits s ON s.session_id = r.session_id AND list_contains(s.members, r.idx)",
    "revisited": _REVISITED,
}


def queries() -> dict:
    return {q.__name__: q for q in (delayed_splits, split_rows, revisited)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
