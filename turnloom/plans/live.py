"""Queries over live rows: change logs, leases, speech sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import live as L
from turnloom.plans.views import frame, run_sql, with_views

_REVISIONS = "SELECT user_id AS session_id, event_type AS sentence, event_id, ts, event_id % 4 = 0 AS pending, CASE WHEN event_id % 5 <> 0 THEN concat('S', CAST(event_id // 3 % 2 AS VARCHAR(20))) END AS speaker, event_id % 3 AS revision FROM events"
_LEASES = "SELECT session_id, 0 AS created_s, last AS last_seen_s, CASE WHEN session_id % 3 <> 0 THEN 5 END AS run_started_s, CASE WHEN session_id % 4 = 1 THEN last - 3 END AS completed_s, last + session_id % 60 AS now FROM (SELECT session_id, CAST(floor(max(end_ms) / 1000) AS BIGINT) AS last FROM turns GROUP BY session_id)"


def revisions(spark, sf_dir) -> DataFrame:
    return run_sql(spark, sf_dir, _REVISIONS.replace("event_id // 3", "event_id div 3"))


def sentence_log(spark, sf_dir):
    r = L.with_previous(revisions(spark, sf_dir), ["session_id", "sentence"], ["event_id"], ["pending", "speaker"])
    return r.select("session_id", "sentence", "event_id", F.array_join(L.sentence_events(), ",").alias("events"))


def live_speaker_log(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").withColumn("speaker", F.when(F.col("hold_ms") >= 400, F.col("speaker")))
    r = L.with_previous(p, ["session_id"], ["tick_ms"], ["speaker"]).withColumn("event", L.speaker_event())
    return r.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("rows"))


def lease_ends(spark, sf_dir):
    return run_sql(spark, sf_dir, _LEASES).select("session_id", L.lease_end(F.col("now")).alias("reason"))


def speech_sessions(spark, sf_dir):
    e = frame(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = L.speech_sessions(e, ["user_id"], "ts", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows")


SQL = {
    "sentence_log": f"WITH r AS ({_REVISIONS}), p AS (SELECT *, row_number() OVER w > 1 AS seen, lag(pending) OVER w AS pp, lag(speaker) OVER w AS ps FROM r WINDOW w AS (PARTITION BY session_id, sentence ORDER BY event_id)) SELECT session_id, sentence, event_id, CASE WHEN pending THEN 'pending' WHEN NOT seen OR pp THEN CASE WHEN speaker IS NULL THEN 'final,final_unknown' ELSE 'final,speaker_assigned' END WHEN speaker IS DISTINCT FROM ps THEN CASE WHEN speaker IS NULL THEN 'speaker_revised,speaker_cleared' WHEN ps IS NULL THEN 'speaker_revised,speaker_assigned' ELSE 'speaker_revised' END WHEN revision > 0 THEN 'updated' ELSE '' END AS events FROM p",
    "live_speaker_log": "WITH p AS (SELECT session_id, tick_ms, CASE WHEN hold_ms >= 400 THEN speaker END AS s FROM probes), l AS (SELECT *, lag(s) OVER (PARTITION BY session_id ORDER BY tick_ms) AS b FROM p) SELECT session_id, CASE WHEN s IS NOT DISTINCT FROM b THEN 'updated' ELSE 'changed' END AS event, count(*) AS rows FROM l GROUP BY ALL",
    "lease_ends": f"SELECT session_id, CASE WHEN now - last_seen_s > 45 THEN 'heartbeat timeout' WHEN now - completed_s > 10 THEN 'completed' WHEN run_started_s IS NULL AND now - created_s > 120 THEN 'idle timeout' WHEN now - run_started_s > 900 THEN 'time limit' END AS reason FROM ({_LEASES})",
    "speech_sessions": "WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS rows FROM g GROUP BY user_id, k",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
