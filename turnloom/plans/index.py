"""Queries of the session index, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.plans.views import run_sql, with_views
from turnloom.sources import index as X

_TITLED = "session_id, idx AS ordinal, CONCAT('Meeting ', CAST(session_id AS VARCHAR(20))) AS title, speaker"
#: What the index held first, what it is given next, and what is taken out at last.
_FIRST = f"SELECT {_TITLED}, CASE WHEN session_id % 3 = 0 AND idx % 4 = 1 THEN CONCAT('Then: ', text) ELSE text END AS text FROM turns WHERE session_id % 5 <> 0 AND (session_id % 4 <> 2 OR idx <> 3)"
_NEXT = f"SELECT {_TITLED}, text FROM turns WHERE session_id % 6 <> 1 AND (session_id % 8 <> 4 OR idx <> 2)"
_GONE = "SELECT DISTINCT session_id FROM turns WHERE session_id % 7 = 2"


def _changed(spark, sf_dir):
    """An index after a first load, an upsert and a deletion."""
    index = X.SessionIndex(spark, X.scratch_index(spark, "session-index"))
    index.upsert(run_sql(spark, sf_dir, _FIRST))
    index.upsert(run_sql(spark, sf_dir, _NEXT))
    index.delete(run_sql(spark, sf_dir, _GONE))
    return index


def index_state(spark, sf_dir):
    """Whether and in which revision each session is indexed."""
    return _changed(spark, sf_dir).state(run_sql(spark, sf_dir, "SELECT session_id FROM turns"))


def index_chunks(spark, sf_dir):
    """Chunks of the index: the version that wrote them, and whether their vector was there before."""
    return _changed(spark, sf_dir).chunks().select("chunk_id", "session_id", "ordinal", "content_hash", "version", "reused")


def index_search(spark, sf_dir):
    """The ten best chunks of all sessions for the text of each row whose number, session_id * 100 + idx, is divisible by 50.

    The index has had a first load and a deletion, and was then given all rows. ``query`` is the chunk of the row that asks.
    """
    index = X.SessionIndex(spark, X.scratch_index(spark, "session-index"))
    index.upsert(run_sql(spark, sf_dir, _FIRST))
    index.delete(run_sql(spark, sf_dir, _GONE))
    index.upsert(run_sql(spark, sf_dir, f"SELECT {_TITLED}, text FROM turns"))
    questions = run_sql(spark, sf_dir, "SELECT CONCAT(CAST(session_id AS VARCHAR(20)), '#', CAST(idx AS VARCHAR(20))) AS query, CONCAT(text, CASE WHEN session_id % 3 = 0 THEN ' meeting 4, assistant' ELSE '' END) AS text FROM turns WHERE (session_id * 100 + idx) % 50 = 0")
    return index.search(run_sql(spark, sf_dir, "SELECT session_id FROM turns"), questions, 10)


#: Sessions with dates and the names of who spoke.
_SESSIONS = """SELECT session_id, CONCAT('Meeting ', CAST(session_id AS VARCHAR(20)), ' ', MIN(speaker)) AS title, CONCAT('2025-0', CAST(1 + session_id % 9 AS VARCHAR(20)), '-11') AS created_at,
 CASE WHEN session_id % 4 = 1 THEN NULL ELSE CONCAT('2026-0', CAST(1 + session_id % 7 AS VARCHAR(20)), '-02') END AS updated_at, CASE WHEN session_id % 6 = 1 THEN NULL ELSE session_id % 3 = 0 END AS archived, MAX(speaker) AS name FROM turns GROUP BY session_id"""


def session_list(spark, sf_dir):
    """Active sessions of a year with a user, by words of their title, dates and names."""
    s = run_sql(spark, sf_dir, _SESSIONS).withColumn("speaker_names", F.array("name"))
    return X.listed_sessions(s, "active", "2026-0 USER meeting").select("session_id", "title", "updated_at")


_HASH = "substr(sha256(concat_ws(chr(31), coalesce('=' || title, '~'), coalesce('=' || speaker, '~'), coalesce('=' || text, '~'))), 1, 24)"
_STATE = f"""a AS (SELECT *, {_HASH} AS h FROM ({_FIRST}) f), b AS (SELECT *, {_HASH} AS h FROM ({_NEXT}) n),
ra AS (SELECT session_id, substr(sha256(string_agg(h, ',' ORDER BY ordinal)), 1, 32) AS r FROM a GROUP BY session_id), rb AS (SELECT session_id, substr(sha256(string_agg(h, ',' ORDER BY ordinal)), 1, 32) AS r FROM b GROUP BY session_id),
w AS (SELECT rb.session_id, rb.r, 2 AS version FROM rb LEFT JOIN ra ON ra.session_id = rb.session_id WHERE ra.r IS DISTINCT FROM rb.r UNION ALL SELECT ra.session_id, ra.r, 1 FROM ra LEFT JOIN rb ON rb.session_id = ra.session_id WHERE rb.r IS NULL OR ra.r = rb.r),
c AS (SELECT w.session_id, w.r, w.version, x.ordinal, x.h, w.version = 2 AND EXISTS (SELECT 1 FROM a WHERE a.session_id = x.session_id AND a.ordinal = x.ordinal AND a.h = x.h) AS reused
 FROM w JOIN (SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM b) x ON x.session_id = w.session_id AND x.version = w.version WHERE w.session_id NOT IN ({_GONE}))"""

SQL = {
    "index_state": f"WITH {_STATE}, s AS (SELECT session_id, ANY_VALUE(r) AS r, COUNT(*) AS n FROM c GROUP BY session_id) SELECT t.session_id, s.n IS NOT NULL AS indexed, COALESCE(s.r, '') AS revision_id, COALESCE(s.n, 0) AS chunks, s.n IS NOT NULL AS current, CASE WHEN s.n IS NULL THEN 0 ELSE 64 END AS dimensions FROM (SELECT DISTINCT session_id FROM turns) t LEFT JOIN s ON s.session_id = t.session_id",
    "index_chunks": f"WITH {_STATE} SELECT session_id || '#' || ordinal AS chunk_id, session_id, ordinal, h AS content_hash, version, reused FROM c",
    "session_list": f"SELECT session_id, title, updated_at FROM ({_SESSIONS}) s WHERE NOT COALESCE(archived, FALSE) AND contains(lower(concat_ws(' ', title, created_at, updated_at, name)), '2026-0') AND contains(lower(concat_ws(' ', title, created_at, updated_at, name)), 'user')",
}


def queries() -> dict:
    return {q.__name__: q for q in (index_state, index_chunks, index_search, session_list)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
