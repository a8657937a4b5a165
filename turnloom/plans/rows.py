"""Queries of the row operators over rows derived from the base tables, and their SQL.

Each query names its input as one SQL text that both engines run (``INPUTS``) and applies an operator to it.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import rows as R
from turnloom.plans.views import run_sql, with_views

INPUTS = {
    "raw": """SELECT session_id, idx AS place, CASE WHEN idx%3=0 THEN CONCAT('r', CAST(idx AS VARCHAR(20))) WHEN idx%3=1 THEN ' ' END AS row_id,
 CASE WHEN idx%6=1 THEN CONCAT('id', CAST(idx AS VARCHAR(20))) END AS id, CASE WHEN idx%4<>2 THEN idx END AS "index", CASE WHEN idx%5=1 THEN '  ' WHEN idx%5=2 THEN NULL ELSE text END AS text,
 CASE WHEN idx%7<>2 THEN text END AS sentence, CASE WHEN idx%4=1 THEN '' ELSE speaker END AS speaker_id, speaker AS assigned_speaker, CASE WHEN idx%4=3 THEN ' ' WHEN idx%4=0 THEN CONCAT(speaker, ' name') END AS speaker_name,
 CASE WHEN idx%2=0 THEN start_ms/1000.0 ELSE 0 END AS start, CASE WHEN idx%3<>1 THEN start_ms/1000.0 END AS start_sec, CASE WHEN idx%2=1 THEN end_ms/1000.0 END AS "end", CASE WHEN idx%3=0 THEN end_ms/1000.0 END AS end_sec,
 CASE WHEN idx%9=4 THEN TRUE WHEN idx%9=5 THEN FALSE END AS pending FROM captions""",
    "samples": """SELECT session_id, event_id, CASE WHEN hold_ms%3=0 THEN speaker WHEN hold_ms%3=1 THEN 'UNKNOWN' ELSE ' ' END AS visible, CASE WHEN hold_ms%5=0 THEN 'P_view' ELSE '' END AS current_id,
 CASE WHEN hold_ms%7=0 THEN 'P_click' WHEN hold_ms%7=1 THEN 'UNKNOWN' END AS fallback, hold_ms%4 AS n FROM probes""",
    "records": """SELECT session_id, event_id AS line, tick_ms/1000.0 AS time, CASE WHEN hold_ms%3=0 THEN 'live_speaker_clear' WHEN hold_ms%3=1 THEN 'live_speaker' ELSE 'other' END AS event,
 CONCAT(CHR(123), '"speaker_id": "', CASE WHEN hold_ms%4=0 THEN '' WHEN hold_ms%4=1 THEN 'UNKNOWN' ELSE speaker END, '", "assigned_speaker": "', speaker, '", "start": ', CAST(tick_ms AS VARCHAR(20)), ', "end": ', CAST(tick_ms+hold_ms%900-200 AS VARCHAR(20)),
 CASE WHEN hold_ms%2=0 THEN ', "reason": "silence"' ELSE '' END, CHR(125)) AS payload FROM probes""",
    "words": """SELECT session_id, CONCAT('w', CAST(event_id AS VARCHAR(20))) AS word, (tick_ms-700)/1000.0 AS start, (tick_ms-700+hold_ms%1300-100)/1000.0 AS "end" FROM probes""",
    "marks": """SELECT session_id, idx, speaker, duration_ms, CASE WHEN idx%4=0 THEN 'embedding' WHEN idx%4=1 THEN 'section_gap_new_speaker' WHEN idx%4=2 THEN 'context' ELSE 'live' END AS source, CASE WHEN idx%5<>0 THEN CAST((idx*37)%100 AS DOUBLE)/100.0 END AS unknown,
 CAST((idx*53)%100 AS DOUBLE)/100.0 AS similarity, CAST((idx*29)%40 AS DOUBLE)/100.0 AS margin, idx%11=0 AS created, CASE WHEN idx%8=0 THEN 'user_corrected' WHEN idx%8=1 THEN 'user_confirmed' END AS status,
 CASE WHEN idx%3=0 THEN speaker WHEN idx%3=1 THEN ' S2 ' END AS corrected, CASE WHEN idx%6<3 THEN 'S1' END AS previous, CASE WHEN idx%5=1 THEN 'S2' ELSE speaker END AS original, CASE WHEN idx%13=0 THEN NULL ELSE embedding END AS vector FROM sentences""",
    "citations": """SELECT CAST(FLOOR((session_id*7+idx)/3) AS BIGINT) AS item, CONCAT(CAST(session_id AS VARCHAR(20)), ':', CAST(CASE WHEN idx%4=3 THEN idx+100000 ELSE idx END AS VARCHAR(20))) AS row_id, session_id*1000+idx AS place FROM turns""",
    "cited_rows": """SELECT CONCAT(CAST(session_id AS VARCHAR(20)), ':', CAST(idx AS VARCHAR(20))) AS row_id, start_ms, end_ms, speaker, text FROM turns""",
    "edits": """SELECT s.session_id, n.seq, CONCAT('S', CAST((s.session_id+n.seq)%4+1 AS VARCHAR(20))) AS "from", CASE WHEN n.seq=2 THEN NULL ELSE CONCAT('S', CAST((s.session_id*n.seq)%5+1 AS VARCHAR(20))) END AS "to", (s.session_id+n.seq)%5=0 AS undone
 FROM (SELECT DISTINCT session_id FROM sentences WHERE session_id%4<>3) s CROSS JOIN (SELECT CAST(0 AS BIGINT) AS seq UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) n""",
    "colors": """SELECT o_orderkey, CONCAT('#', CAST(o_orderkey%9 AS VARCHAR(9)), CAST((o_orderkey+3)%10 AS VARCHAR(9)), CAST(o_custkey%10 AS VARCHAR(9)), CAST((o_orderkey*7)%10 AS VARCHAR(9)), CAST((o_custkey+5)%10 AS VARCHAR(9)), CAST(o_orderkey%10 AS VARCHAR(9))) AS hex FROM orders""",
}


def _in(spark, sf_dir, name):
    return run_sql(spark, sf_dir, re.sub(r'AS "(\w+)"', r"AS `\1`", INPUTS[name]))


def finalized_rows(spark, sf_dir):
    out = R.finalized(_in(spark, sf_dir, "raw").withColumns({k: F.col(k).cast("double") for k in ("start", "start_sec", "end", "end_sec")}), "session_id", "place")
    return out.select("session_id", "place", "row_id", "text", "speaker_id", "speaker_name", quantized(F.col("start")).alias("start"), quantized(F.col("end")).alias("end"))


def visible_speakers(spark, sf_dir):
    s = _in(spark, sf_dir, "samples")
    dom = F.slice(F.array(F.lit("P_view"), F.lit("P_click"), F.lit("P_purchase")), 1, F.col("n").cast("int"))
    return s.select("session_id", "event_id", R.visible_speaker(dom, F.col("visible"), F.col("current_id"), F.col("fallback")).alias("shown"))


def live_speaker_events(spark, sf_dir):
    return R.live_events(_in(spark, sf_dir, "records")).select("session_id", "line", "speaker", "start", "end")


def live_clear_events(spark, sf_dir):
    return R.clear_events(_in(spark, sf_dir, "records")).select("session_id", "line", "speaker", "reason")


def trace_sessions(spark, sf_dir):
    return R.sessions_seen(_in(spark, sf_dir, "records"), "session_id", "line")


def latest_session(spark, sf_dir):
    return R.of_session(_in(spark, sf_dir, "records"), "session_id", "line", "latest").select("session_id", "line", "event")


def timed_words(spark, sf_dir):
    w = _in(spark, sf_dir, "words").withColumns({k: F.col(k).cast("double") for k in ("start", "end")})
    out = R.timed_words(w, ["session_id"], F.lit(30.0), 0.8)
    return out.select("session_id", "word", quantized(F.col("start")).alias("start"), quantized(F.col("end")).alias("end"))


def _marks(spark, sf_dir):
    c = F.col
    m = _in(spark, sf_dir, "marks")
    m = m.withColumn("rejected", R.rejected_labels(F.array(F.lit(" S3 "), F.lit("")), c("status"), c("corrected"), c("previous"), c("original")))
    return m.withColumn("confirmed", R.confirmed_label(c("status"), c("corrected"), c("speaker")))


def rejected_labels(spark, sf_dir):
    return _marks(spark, sf_dir).select("session_id", "idx", F.array_join("rejected", ",").alias("rejected"), "confirmed")


def core_rows(spark, sf_dir):
    c, m = F.col, _marks(spark, sf_dir)
    none = F.array().cast("array<string>")
    doubt = R.uncertain(c("source"), c("duration_ms"), c("unknown"), c("vector"), c("confirmed"), F.when(c("idx") % 2 == 0, none).otherwise(c("rejected")))
    return m.select("session_id", "idx", R.trusted(c("source"), c("duration_ms"), c("unknown"), c("vector")).alias("trusted"), doubt.alias("uncertain"))


def reassignments(spark, sf_dir):
    c, m = F.col, _in(spark, sf_dir, "marks").withColumn("unknown", F.coalesce("unknown", F.lit(1.0)))
    may = R.may_reassign(c("source"), c("created"), c("duration_ms"), c("previous"), c("unknown"), 4000, 0.45)
    holds = R.reassignment_holds(c("previous"), c("similarity"), c("margin"), c("unknown"), c("duration_ms"), 0.62, 2500, 0.5, 0.12, 0.2)
    return m.select("session_id", "idx", may.alias("may"), holds.alias("holds"))


def evidence_items(spark, sf_dir):
    out = R.evidence_items(_in(spark, sf_dir, "citations"), _in(spark, sf_dir, "cited_rows"))
    return out.select("item", F.array_join("row_ids", ",").alias("row_ids"), "start_ms", "end_ms", F.array_join("speakers", ",").alias("speakers"), "quote")


def sanitized_items(spark, sf_dir):
    items = _in(spark, sf_dir, "citations").withColumn("required", F.col("item") % 3 != 0)
    return R.sanitized(items, _in(spark, sf_dir, "cited_rows").filter("start_ms % 3 <> 0"), ["item"], "row_id", "required")


def edited_speakers(spark, sf_dir):
    s = run_sql(spark, sf_dir, "SELECT session_id, idx, speaker FROM sentences")
    return R.edited(s, _in(spark, sf_dir, "edits"), "session_id", "speaker")


def split_speakers(spark, sf_dir):
    s = run_sql(spark, sf_dir, "SELECT session_id, idx, speaker FROM sentences")
    return R.split_speaker(s, "session_id", "idx", "speaker", "S2", F.col("idx") > 20)


def padded_segments(spark, sf_dir):
    t = run_sql(spark, sf_dir, "SELECT session_id, idx, CAST(start_ms AS DOUBLE)/1000.0 AS s, CAST(start_ms+idx%3*900 AS DOUBLE)/1000.0 AS e, CAST(MAX(start_ms) OVER (PARTITION BY session_id)+600 AS DOUBLE)/1000.0 AS d FROM turns")
    first, last = R.padded(F.col("s"), F.col("e"), F.col("d"), 1.5)
    return t.select("session_id", "idx", quantized(first).alias("first"), quantized(last).alias("last"))


def map_errors(spark, sf_dir):
    m = _in(spark, sf_dir, "marks")
    left = F.create_map(F.lit("a"), F.col("similarity"), F.lit("b"), F.col("margin"))
    right = F.when(F.col("idx") % 2 == 0, F.create_map(F.lit("b"), F.col("similarity"))).otherwise(F.create_map(F.lit("a"), F.col("margin"), F.lit("c"), F.lit(0.3)))
    return m.select("session_id", "idx", quantized(R.map_error(left, right)).alias("error"))


def sample_quality(spark, sf_dir):
    m = _in(spark, sf_dir, "marks")
    return m.select("session_id", "idx", quantized(R.sample_quality(F.col("duration_ms") / 1000.0, (F.col("idx") % 5).cast("double"), F.when(F.col("idx") % 3 > 0, F.col("similarity"))), 4).alias("quality"))


def color_contrast(spark, sf_dir):
    c = _in(spark, sf_dir, "colors")
    return c.select("o_orderkey", quantized(R.contrast(F.col("hex"), F.lit("#000000"))).alias("contrast"), R.oklab(F.col("hex")).alias("lab")).select("o_orderkey", "contrast", *(quantized(F.col(f"lab.{k}"), 5).alias(k) for k in "lab"))


def _q(x: str, k: int = 6) -> str:
    return f"floor(({x}) * {10**k}.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / {10**k}.0::DOUBLE"


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


_D = {k: f"CAST({k} AS DOUBLE)" for k in ("start", "start_sec", '"end"', "end_sec")}
_START = f"coalesce(nullif({_D['start']}, 0), {_D['start_sec']}, 0)"
_KNOWN = "CASE WHEN trim({x}) <> '' AND trim({x}) <> 'UNKNOWN' THEN trim({x}) END"
_FIT = "CASE WHEN n = 0 OR list_contains(dom, {k}) THEN {k} END"
_REJECTED = "list_sort(list_distinct(list_filter(list_transform(list_concat([' S3 ', ''], CASE WHEN status = 'user_corrected' THEN [previous, original] ELSE [] END), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '' AND x IS DISTINCT FROM trim(corrected))))"
_CONFIRMED = "CASE WHEN status = 'user_confirmed' AND coalesce(nullif(trim(corrected), ''), speaker) = speaker THEN speaker END"
_LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_CH = ["(('0x' || substr(hex, {k}, 2))::INT / 255.0::DOUBLE)".format(k=k) for k in (2, 4, 6)]


def _sum(row, names) -> str:
    return " + ".join(f"({k!r})::DOUBLE * {n}" for k, n in zip(row, names))


SQL = {
    "finalized_rows": f"""{_with("raw")}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS nth FROM raw) SELECT session_id, place, coalesce(nullif(trim(row_id), ''), nullif(trim(id), ''), 'row_' || CAST(coalesce("index", nth) AS VARCHAR)) AS row_id, coalesce(nullif(trim(text), ''), nullif(trim(sentence), '')) AS text, coalesce(nullif(speaker_id, ''), assigned_speaker, '') AS speaker_id, coalesce(nullif(trim(speaker_name), ''), nullif(trim(assigned_speaker), ''), 'Unknown') AS speaker_name, {_q(_START)} AS start, {_q(f"coalesce(nullif({_D[chr(34) + 'end' + chr(34)]}, 0), nullif({_D['end_sec']}, 0), {_START})")} AS "end" FROM p WHERE NOT coalesce(pending, false) AND coalesce(nullif(trim(text), ''), nullif(trim(sentence), '')) IS NOT NULL""",
    "visible_speakers": f"""{_with("samples")}, d AS (SELECT *, ['P_view', 'P_click', 'P_purchase'][1:n] AS dom, {_KNOWN.format(x='current_id')} AS k1, {_KNOWN.format(x='fallback')} AS k2 FROM samples) SELECT session_id, event_id, coalesce({_KNOWN.format(x='visible')}, CASE WHEN n = 1 THEN dom[1] END, {_FIT.format(k='k1')}, {_FIT.format(k='k2')}, dom[1], '') AS shown FROM d""",
    "live_speaker_events": f"""{_with("records")}, e AS (SELECT session_id, line, coalesce(nullif(json_extract_string(payload, '$.speaker_id'), ''), json_extract_string(payload, '$.assigned_speaker')) AS speaker, CAST(json_extract(payload, '$.start') AS DOUBLE) AS start, CAST(json_extract(payload, '$.end') AS DOUBLE) AS "end" FROM records WHERE event = 'live_speaker') SELECT * FROM e WHERE speaker <> '' AND speaker <> 'UNKNOWN' AND "end" > start""",
    "live_clear_events": f"""{_with("records")} SELECT session_id, line, coalesce(json_extract_string(payload, '$.speaker_id'), '') AS speaker, coalesce(json_extract_string(payload, '$.reason'), '') AS reason FROM records WHERE event = 'live_speaker_clear'""",
    "trace_sessions": f"""{_with("records")} SELECT session_id, min(line) AS first_line FROM records GROUP BY session_id""",
    "latest_session": f"""{_with("records")} SELECT session_id, line, event FROM records WHERE session_id = (SELECT session_id FROM records GROUP BY session_id ORDER BY min(line) DESC LIMIT 1)""",
    "timed_words": f"""{_with("words")}, c AS (SELECT session_id, word, least(30, greatest(0, CAST(start AS DOUBLE))) AS s, least(30, greatest(0, CAST("end" AS DOUBLE))) AS e FROM words), k AS (SELECT *, lead(s) OVER (PARTITION BY session_id ORDER BY s, e, word) AS n FROM c WHERE e > s) SELECT session_id, word, {_q('s')} AS start, {_q('least(e, least(30, s + 0.8::DOUBLE, CASE WHEN n > s THEN n END))')} AS "end" FROM k""",
    "rejected_labels": f"""{_with("marks")} SELECT session_id, idx, array_to_string({_REJECTED}, ',') AS rejected, {_CONFIRMED} AS confirmed FROM marks""",
    "core_rows": f"""{_with("marks")}, m AS (SELECT *, CASE WHEN idx % 2 = 0 THEN 0 ELSE len({_REJECTED}) END AS k, {_CONFIRMED} AS c, source IN ('embedding', 'section_gap_new_speaker') AS sure FROM marks) SELECT session_id, idx, sure AND duration_ms >= 800 AND (unknown IS NULL OR unknown <= 0.5) AND vector IS NOT NULL AS trusted, c IS NULL AND k = 0 AND duration_ms >= 350 AND vector IS NOT NULL AND (NOT sure OR coalesce(unknown >= 0.5, false)) AS uncertain FROM m""",
    "reassignments": f"""{_with("marks")}, m AS (SELECT *, coalesce(unknown, 1.0) AS u FROM marks) SELECT session_id, idx, source = 'context' OR (NOT created AND duration_ms <= 4000 AND (previous IS NULL OR u >= 0.45)) AS may, previous IS NOT NULL AND (similarity >= 0.62 OR (duration_ms <= 2500 AND similarity >= 0.5 AND margin >= 0.12) OR u <= 0.2) AS holds FROM m""",
    "evidence_items": f"""{_with("citations", "cited_rows")}, j AS (SELECT c.item, r.*, row_number() OVER (PARTITION BY c.item ORDER BY c.place) AS n FROM citations c JOIN cited_rows r ON c.row_id = r.row_id) SELECT item, array_to_string(list_sort(list_distinct(list(row_id))), ',') AS row_ids, min(start_ms) AS start_ms, max(end_ms) AS end_ms, array_to_string(list_sort(list_distinct(list(speaker))), ',') AS speakers, string_agg(text, ' ' ORDER BY n) FILTER (WHERE n <= 4) AS quote FROM j GROUP BY item""",
    "sanitized_items": f"""{_with("citations", "cited_rows")}, g AS (SELECT item, item % 3 <> 0 AS required, count(r.row_id) AS n_cited FROM citations c LEFT JOIN (SELECT row_id FROM cited_rows WHERE start_ms % 3 <> 0) r ON c.row_id = r.row_id GROUP BY ALL) SELECT *, CASE WHEN n_cited > 0 THEN 'grounded' ELSE 'not_required' END AS grounding FROM g WHERE NOT required OR n_cited > 0""",
    "edited_speakers": f"""{_with("edits")}, e0 AS (SELECT s.session_id, s.idx, s.speaker, CASE WHEN e.session_id IS NULL THEN s.speaker ELSE e."to" END AS x FROM sentences s LEFT JOIN edits e ON s.session_id = e.session_id AND e.seq = 0 AND NOT undone AND s.speaker = e."from"), e1 AS (SELECT s.session_id, s.idx, s.speaker, CASE WHEN e.session_id IS NULL THEN s.x ELSE e."to" END AS x FROM e0 s LEFT JOIN edits e ON s.session_id = e.session_id AND e.seq = 1 AND NOT undone AND s.x = e."from") SELECT s.session_id, s.idx, s.speaker, CASE WHEN e.session_id IS NULL THEN s.x ELSE e."to" END AS edited FROM e1 s LEFT JOIN edits e ON s.session_id = e.session_id AND e.seq = 2 AND NOT undone AND s.x = e."from" """,
    "split_speakers": "SELECT session_id, idx, speaker, CASE WHEN speaker = 'S2' AND idx > 20 THEN 'S' || CAST(max(CAST(substr(speaker, 2) AS INT)) OVER (PARTITION BY session_id) + 1 AS VARCHAR) ELSE speaker END AS split FROM sentences",
    "padded_segments": f"""WITH t AS (SELECT session_id, idx, start_ms / 1000.0::DOUBLE AS s, (start_ms + idx % 3 * 900) / 1000.0::DOUBLE AS e, (max(start_ms) OVER (PARTITION BY session_id) + 600) / 1000.0::DOUBLE AS d FROM turns), c AS (SELECT *, greatest(0, (s + e) / 2 - 0.75::DOUBLE) AS low, least(d, (s + e) / 2 + 0.75::DOUBLE) AS high FROM t), m AS (SELECT *, greatest(0, least(low, d - 1.5::DOUBLE)) AS moved, e - s < 1.5 AS short, high - low < 1.5 AS tight FROM c), r AS (SELECT session_id, idx, CASE WHEN NOT short THEN s WHEN tight THEN moved ELSE low END AS f, CASE WHEN NOT short THEN e WHEN tight THEN least(d, moved + 1.5::DOUBLE) ELSE high END AS l FROM m) SELECT session_id, idx, {_q('f')} AS first, {_q('greatest(f, l)')} AS last FROM r""",
    "map_errors": f"""{_with("marks")} SELECT session_id, idx, {_q("CASE WHEN idx % 2 = 0 THEN greatest(similarity, abs(margin - similarity)) ELSE greatest(abs(similarity - margin), margin, 0.3::DOUBLE) END")} AS error FROM marks""",
    "sample_quality": f"""{_with("marks")} SELECT session_id, idx, {_q("greatest(0, least(1, duration_ms / 1000.0::DOUBLE / 8 * least(1, (idx % 5) / 3.0::DOUBLE))) * CASE WHEN idx % 3 > 0 THEN greatest(0.5::DOUBLE, similarity) ELSE 1 END", 4)} AS quality FROM marks""",
    "color_contrast": f"""{_with("colors")}, c AS (SELECT o_orderkey, {", ".join(f"{_LIN.format(c=c)} AS {n}" for c, n in zip(_CH, ("r_", "g_", "b_")))} FROM colors), k AS (SELECT *, {", ".join(f"cbrt({_sum(row, ('r_', 'g_', 'b_'))}) AS c{i}" for i, row in enumerate(R.TO_CONES))} FROM c) SELECT o_orderkey, {_q("(0.2126::DOUBLE * r_ + 0.7152::DOUBLE * g_ + 0.0722::DOUBLE * b_ + 0.05::DOUBLE) / 0.05::DOUBLE")} AS contrast, {", ".join(f"{_q(_sum(row, ('c0', 'c1', 'c2')), 5)} AS {n}" for n, row in zip("lab", R.TO_OKLAB))} FROM k""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
