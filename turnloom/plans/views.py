"""Derived views shared by the queries, as one SQL text that Spark and DuckDB both run. Times are whole milliseconds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "turns": """
SELECT conv_id AS session_id, turn AS idx, role AS speaker, text,
 CAST(COALESCE(SUM(40*LENGTH(text)+CASE WHEN turn%3=0 THEN 1200 ELSE 400 END)
   OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_ms,
 CAST(SUM(40*LENGTH(text)+CASE WHEN turn%3=0 THEN 1200 ELSE 400 END)
   OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   - CASE WHEN turn%3=0 THEN 1200 ELSE 400 END AS BIGINT) AS end_ms
FROM conversations""",
    "probes": """
SELECT user_id AS session_id, event_id,
 CAST(400*(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1) AS BIGINT) AS tick_ms,
 CONCAT('P_',event_type) AS speaker, CAST(FLOOR(value*100) AS BIGINT) AS hold_ms
FROM events""",
    "sentences": """
SELECT CAST(FLOOR(vec_id/50) AS BIGINT) AS session_id, CAST(vec_id%50 AS BIGINT) AS idx,
 CONCAT('S',CAST(label+1 AS VARCHAR(20))) AS speaker,
 CAST(800+(vec_id*137)%5200 AS BIGINT) AS duration_ms, embedding
FROM embeddings""",
}

#: Rows with the turns of phrase that caption rules look for, one kind for each remainder of idx + session.
CAPTIONS = (
    "'Thanks for watching!'", "'So, thank you for watching my talk.'", "'Subtitles by the Amara.org community'", "'Captions at amara org today'", "'Amara spoke first'", "'Captions by NicoSubs'",
    "'(LAUGHTER) and then he left'", "'uh um hmm'", "'♪ la la love ♪'", "'oh um uh na yes'", "'Well... I think so… maybe not...'", "'hello , world ! It is , fine .'", "'he said \"no.\"'", "'Please subscribe to my channel'",
    "'catch this on YouTube'", "'hit the notification bell'", "CONCAT('  spaced   out', CHR(9), 'text ')", "'iPhone sales rose'", "'ärger über Größe'", "NULL", "'it''s what it''s about'",
)
VIEWS["captions"] = f"""
SELECT session_id, idx, speaker, start_ms, end_ms,
 CASE (session_id+idx)%29 {" ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(CAPTIONS))} ELSE text END AS text
FROM ({VIEWS["turns"]}) t"""


def with_views(sql: str) -> str:
    """The SQL with every derived view that it names put in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in VIEWS:
        return spark.sql(_bound(VIEWS[name]), **_frames(spark, sf_dir, VIEWS[name]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over base tables and derived views, without registering anything in the session."""
    full = with_views(sql)
    return spark.sql(_bound(full), **_frames(spark, sf_dir, full))


def _used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql, re.I)]


def _bound(sql: str) -> str:
    for t in _used(sql):
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}} {t}", sql, flags=re.I)
    return sql


def _frames(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _used(sql)}
