"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.numbers import quantized
from turnloom.operators import sequence as Q
from turnloom.plans import vectors as PV
from turnloom.plans.views import frame, with_views


def _rows(spark, sf_dir):
    """Sentences laid end to end, every seventh unknown, with pauses after every third."""
    s = frame(spark, sf_dir, "sentences")
    w = W.partitionBy("session_id").orderBy("idx")
    pause = F.when(F.col("idx") % 3 == 0, 400).otherwise(100)
    end = F.sum(F.col("duration_ms") + pause).over(w.rowsBetween(W.unboundedPreceding, 0)) - pause
    rows = s.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))
    return rows.select("session_id", "idx", F.when(F.col("idx") % 7 != 3, F.concat(F.lit("S"), (F.substring("speaker", 2, 3).cast("int") % 3).cast("string"))).alias("speaker"), "duration_ms", "start_ms", "end_ms")


def speaker_runs(spark, sf_dir):
    return Q.run_table(_rows(spark, sf_dir), "session_id")


def small_islands(spark, sf_dir):
    s = frame(spark, sf_dir, "sentences").drop("embedding")
    return Q.absorb_small_islands(s, "session_id").select("session_id", "idx", "speaker", "fixed")


def unknown_fill(spark, sf_dir):
    return Q.fill_unknown_islands(_rows(spark, sf_dir), "session_id").select("session_id", "idx", "speaker", "fixed")


def tail_fill(spark, sf_dir):
    return Q.fill_tails(_rows(spark, sf_dir), "session_id", most_ms=3500).select("session_id", "idx", "speaker", "fixed")


def head_fill(spark, sf_dir):
    return Q.fill_heads(_rows(spark, sf_dir), "session_id", most_ms=3500, previous_gap_ms=100, next_gap_ms=100).select("session_id", "idx", "speaker", "fixed")


def context_anchor(spark, sf_dir):
    r = Q.context_anchors(_rows(spark, sf_dir), "session_id", F.col("speaker").isNotNull() & (F.col("duration_ms") >= 2000))
    return r.select("session_id", "idx", "left_anchor", "right_anchor", "suggested")


def repeated_phrases(spark, sf_dir):
    """Documents whose neighbouring lines repeat."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return Q.repeated_rows(lines, "session_id", T.normalized_match_text(F.col("line")), least_run=2)


def exact_repeats(spark, sf_dir):
    """Lines of a document, of any length, that are one phrase of two words or more, repeated."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(T.is_repeated_phrase(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def ewma_state(spark, sf_dir):
    p = frame(spark, sf_dir, "probes")
    return Q.ema(p, ["session_id"], "hold_ms", ["tick_ms", "event_id"]).select("session_id", "event_id", quantized(F.col("ema")).alias("ema"))


def vad_spans(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").select("session_id", (F.col("tick_ms") / 400).cast("long").alias("frame"), (F.col("hold_ms") >= 900).alias("speech"))
    return Q.flag_spans(p, ["session_id"], "frame", "speech", 400, fill=1)


def vad_padded(spark, sf_dir):
    return Q.padded_spans(vad_spans(spark, sf_dir), ["session_id"])


def review_flags(spark, sf_dir):
    scored = PV.score_existing(spark, sf_dir)
    s = frame(spark, sf_dir, "sentences").select("session_id", "idx", "duration_ms")
    r = Q.review_reasons(scored.join(s, ["session_id", "idx"]))
    return r.select("session_id", "idx", quantized(F.col("suspicion")).alias("suspicion"), F.array_join("reasons", ",").alias("reasons"))


def _words(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("tick_ms", "event_id")))
    return p.select("session_id", (F.floor((F.col("place") - 1) / 12)).alias("part"), "tick_ms", "event_id", (F.col("hold_ms") % 41 - 20).alias("margin"), (F.col("hold_ms") % 5 + 1).alias("support"))


def word_handoff(spark, sf_dir):
    return Q.word_cut(_words(spark, sf_dir), ["session_id", "part"], "tick_ms", "margin", "support")


def boundary_crossing(spark, sf_dir):
    r = Q.zero_crossing(_words(spark, sf_dir), ["session_id", "part"], "tick_ms", "margin")
    return r.select("session_id", "part", quantized(F.col("crossing"), 3).alias("crossing"))


_ROWS = """rows_ AS (SELECT session_id, idx, CASE WHEN idx % 7 <> 3 THEN 'S' || CAST(CAST(substr(speaker, 2) AS INT) % 3 AS VARCHAR) END AS speaker, duration_ms, e - duration_ms AS start_ms, e AS end_ms
FROM (SELECT *, CAST(sum(duration_ms + CASE WHEN idx % 3 = 0 THEN 400 ELSE 100 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - CASE WHEN idx % 3 = 0 THEN 400 ELSE 100 END AS BIGINT) AS e FROM sentences))"""


def _runs(source: str) -> str:
    return f"""m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m),
t AS (SELECT session_id, run, any_value(speaker) AS speaker, count(*) AS rows, CAST(sum(duration_ms) AS BIGINT) AS total_ms, min(idx) AS first_idx, max(idx) AS last_idx FROM r GROUP BY session_id, run),
runs AS (SELECT *, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after FROM t WINDOW w AS (PARTITION BY session_id ORDER BY run))"""


def _q(x: str, k: int = 6) -> str:
    return f"floor(({x}) * {10**k}.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / {10**k}.0::DOUBLE"


_PARTS = "w AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) - 1) // 12 AS part, tick_ms, hold_ms % 41 - 20 AS margin, hold_ms % 5 + 1 AS support FROM probes)"
_SPANS = "f AS (SELECT session_id, tick_ms // 400 AS frame FROM probes WHERE hold_ms >= 900), g AS (SELECT *, lag(frame) OVER (PARTITION BY session_id ORDER BY frame) AS p FROM f), i AS (SELECT *, sum(CASE WHEN p IS NULL OR frame - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM g), spans AS (SELECT session_id, min(frame) * 400 AS start_ms, (max(frame) + 1) * 400 AS end_ms FROM i GROUP BY session_id, island)"

SQL = {
    "speaker_runs": f"WITH {_ROWS}, {_runs('rows_')} SELECT * FROM runs",
    "small_islands": f"WITH {_runs('sentences')}, small AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id, speaker) AS k FROM runs WHERE speaker IS NOT NULL) WHERE k = 1 AND total_ms <= 5000 AND rows <= 3 AND before = after) SELECT r.session_id, r.idx, r.speaker, coalesce(s.before, r.speaker) AS fixed FROM r LEFT JOIN small s ON r.session_id = s.session_id AND r.run = s.run",
    "unknown_fill": f"WITH {_ROWS}, {_runs('rows_')} SELECT r.session_id, r.idx, r.speaker, coalesce(r.speaker, s.before) AS fixed FROM r LEFT JOIN runs s ON r.session_id = s.session_id AND r.run = s.run AND s.speaker IS NULL AND s.rows <= 1 AND s.total_ms <= 3000 AND s.before = s.after",
    "tail_fill": f"WITH {_ROWS}, n AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lag(speaker) OVER w AS ps FROM rows_ WINDOW w AS (PARTITION BY session_id ORDER BY idx)) SELECT session_id, idx, speaker, CASE WHEN speaker IS NULL AND end_ms - start_ms <= 3500 AND start_ms - pe <= 350 AND coalesce(ns - end_ms >= 300, true) THEN ps ELSE speaker END AS fixed FROM n",
    "head_fill": f"WITH {_ROWS}, n AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lead(speaker) OVER w AS ls FROM rows_ WINDOW w AS (PARTITION BY session_id ORDER BY idx)) SELECT session_id, idx, speaker, CASE WHEN speaker IS NULL AND end_ms - start_ms <= 3500 AND start_ms - pe >= 100 AND ns - end_ms <= 100 THEN ls ELSE speaker END AS fixed FROM n",
    "context_anchor": f"WITH {_ROWS}, a AS (SELECT session_id, idx, CASE WHEN duration_ms >= 2000 THEN speaker END AS mark FROM rows_), b AS (SELECT session_id, idx, last_value(mark IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS left_anchor, first_value(mark IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS right_anchor FROM a) SELECT *, CASE WHEN left_anchor IS NOT DISTINCT FROM right_anchor THEN left_anchor WHEN left_anchor IS NULL THEN right_anchor WHEN right_anchor IS NULL THEN left_anchor END AS suggested FROM b",
    "repeated_phrases": "WITH l AS (SELECT doc_id AS session_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), t AS (SELECT session_id, idx, array_to_string(regexp_extract_all(lower(line), '[a-z0-9'']+'), ' ') AS speaker, 0 AS duration_ms FROM l), m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY session_id ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT session_id, any_value(speaker) AS phrase, count(*) AS times, CAST(min(idx) AS INT) AS first_idx FROM r WHERE len(string_split(speaker, ' ')) <= 8 GROUP BY session_id, run HAVING count(*) >= 2",
    "exact_repeats": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+') AS w FROM l), p AS (SELECT doc_id, len(w) > 3 AND list_bool_or(list_transform(list_filter(range(2, len(w) // 2 + 1), lambda k: len(w) % k = 0), lambda k: w[1 : len(w) - k] = w[k + 1 : len(w)])) AS yes FROM t) SELECT doc_id, count(*) AS lines FROM p WHERE yes GROUP BY doc_id",
    "ewma_state": "WITH l AS (SELECT session_id, event_id, " + ", ".join(f"lag(hold_ms, {k}) OVER w AS h{k}" for k in range(4)) + " FROM probes WINDOW w AS (PARTITION BY session_id ORDER BY tick_ms, event_id)) SELECT session_id, event_id, " + _q("(" + " + ".join(f"coalesce(h{k} * 0.55::DOUBLE * {(1 - 0.55) ** k!r}::DOUBLE, 0)" for k in range(4)) + ") / (" + " + ".join(f"CASE WHEN h{k} IS NULL THEN 0 ELSE {0.55 * (1 - 0.55) ** k!r}::DOUBLE END" for k in range(4)) + ")") + " AS ema FROM l",
    "vad_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "vad_padded": f"WITH {_SPANS}, w AS (SELECT session_id, greatest(0, start_ms - 200) AS s, end_ms + 350 AS e FROM spans), r AS (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 850 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r) SELECT session_id, min(s) AS start_ms, max(e) AS end_ms FROM k GROUP BY session_id, g",
    "review_flags": f"WITH s AS ({PV.SQL['score_existing']}), x AS (SELECT s.session_id, s.idx, margin < 0.06 AS a, top_similarity < 0.35 AS b, top_similarity < 0.2 AS c, duration_ms < 1200 AS d FROM s JOIN sentences t ON s.session_id = t.session_id AND s.idx = t.idx) SELECT session_id, idx, {_q('least(1.0, CASE WHEN a THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN b THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN c THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN d THEN 0.15 ELSE 0 END::DOUBLE)')} AS suspicion, array_to_string(list_filter([CASE WHEN a THEN 'low_margin' END, CASE WHEN b THEN 'weak_evidence' END, CASE WHEN c THEN 'possibly_unknown' END, CASE WHEN d THEN 'short_audio' END], lambda v: v IS NOT NULL), ',') AS reasons FROM x",
    "word_handoff": f"WITH {_PARTS}, s AS (SELECT *, sum(-margin * support) OVER (PARTITION BY session_id, part ORDER BY tick_ms ROWS UNBOUNDED PRECEDING) AS l, sum(-margin * support) OVER (PARTITION BY session_id, part) AS a, CAST(row_number() OVER (PARTITION BY session_id, part ORDER BY tick_ms) AS INT) AS cut, count(*) OVER (PARTITION BY session_id, part) AS n FROM w), g AS (SELECT *, CAST(2 * l - a - abs(a) AS BIGINT) AS gain FROM s WHERE cut < n), r AS (SELECT session_id, part, list(cut ORDER BY gain DESC, cut) AS c, list(gain ORDER BY gain DESC, cut) AS k FROM g GROUP BY ALL) SELECT session_id, part, c[1] AS cut, k[1] AS gain, k[2] AS runner_up FROM r",
    "boundary_crossing": f"WITH {_PARTS}, s AS (SELECT *, lag(margin) OVER o AS m, lag(tick_ms) OVER o AS t FROM w WHERE margin <> 0 WINDOW o AS (PARTITION BY session_id, part ORDER BY tick_ms)), c AS (SELECT *, row_number() OVER (PARTITION BY session_id, part ORDER BY tick_ms) AS k FROM s WHERE m < 0 AND margin > 0) SELECT session_id, part, {_q('coalesce((SELECT (min(z.tick_ms) + max(z.tick_ms)) / 2.0 FROM w z WHERE z.session_id = c.session_id AND z.part = c.part AND z.margin = 0 AND z.tick_ms > c.t AND z.tick_ms < c.tick_ms), t + (tick_ms - t) * (-m)::DOUBLE / (margin - m))', 3)} AS crossing FROM c WHERE k = 1",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
