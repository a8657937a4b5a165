"""Queries over texts: retrieval, cues, revisions, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.numbers import clock, quantized, timecode_seconds
from turnloom.operators import reports as P
from turnloom.operators import retrieval as R
from turnloom.operators import vectors as V
from turnloom.plans.views import frame, run_sql, with_views


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _turns(spark, sf_dir):
    return frame(spark, sf_dir, "turns")


def _questions(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id % 50 = 0")
    return b.select("item_id", T.unicode_tokens(F.col("text")).alias("tokens"))


def _tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.unicode_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def token_stats(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("distinct_tokens"))


def token_jaccard(spark, sf_dir):
    r = R.jaccard_to_previous(_turns(spark, sf_dir), "session_id")
    return r.select("session_id", "idx", quantized(F.col("jaccard")).alias("jaccard"), quantized(F.col("overlap")).alias("overlap"))


def hash_embedding(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.struct("session_id", "idx").alias("at"), T.unicode_tokens(F.col("text")).alias("tokens"))
    e = R.hash_embedding(t, "at", "tokens")
    return e.select("at.session_id", "at.idx", F.transform("embedding", lambda x: quantized(x)).alias("embedding"))


def _bm25(spark, sf_dir):
    scored = R.bm25(_tokens(spark, sf_dir), "doc_id", "tokens", _questions(spark, sf_dir), "item_id", "tokens")
    return scored.withColumn("score", quantized(F.col("score")))  # before places are given: sums have no fixed order


def bm25_topk(spark, sf_dir):
    return R.top(_bm25(spark, sf_dir), 30, "doc_id").select("query", "doc_id", "score")


def rrf_search(spark, sf_dir):
    d = R.hashed_vectors(_tokens(spark, sf_dir), "doc_id", "tokens").withColumn("doc_id", F.col("doc_id"))
    q = R.hashed_vectors(_questions(spark, sf_dir), "item_id", "tokens").withColumn("item_id", -1 - F.col("item_id"))
    near = V.nearest(q, d, 30, "item_id", "doc_id", digits=6).select((-1 - F.col("query")).alias("query"), F.col("match").alias("doc_id"), "place")
    lexical = R.top(_bm25(spark, sf_dir), 30, "doc_id")
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id % 50 = 0")
    listed = near.select("query", "doc_id").unionByName(lexical.select("query", "doc_id"))
    bonus = R.title_bonus(questions, _docs(spark, sf_dir), "item_id", "text", "doc_id", "source", listed, 30)
    scored = R.fused(near, lexical, "doc_id", bonus=bonus).withColumn("score", quantized(F.col("score"), 9))
    return R.top(scored, 30, "doc_id").select("query", "doc_id", quantized(F.col("score")).alias("score"))


def evidence_neighbours(spark, sf_dir):
    t = _turns(spark, sf_dir)
    hits = t.filter(F.contains("text", F.lit("than")))
    return R.neighbours(hits, t, "session_id", "idx").select("session_id", "idx", "speaker")


def exact_term_rows(spark, sf_dir):
    terms = F.array(*map(F.lit, ("would", "please", "answer", "tion", "thre", "with", "than")))
    t = _turns(spark, sf_dir)
    return R.exact_rows(t, T.unicode_tokens(F.col("text")), R.query_terms(terms), ["start_ms", "session_id", "idx"]).select("session_id", "idx", "matched")


#: Turns of which two thirds are lines with cues, in both languages, with marks and letters around them.
_SPOKEN = """SELECT session_id, idx, CASE (session_id * 7 + idx) % 21 WHEN 0 THEN 'We AGREED on the final plan' WHEN 1 THEN 'Das ist beschlossen, machen wir so.' WHEN 2 THEN 'Undecided, finally' WHEN 3 THEN 'I''ll follow up' WHEN 4 THEN 'Ich mache das bis Freitag'
 WHEN 5 THEN 'Pleased to see the tasks' WHEN 6 THEN 'Really?' WHEN 7 THEN 'That is an open question; who will clarify it' WHEN 8 THEN 'Das ist noch offen und unklar' WHEN 9 THEN 'A blocker, and a RISK' WHEN 10 THEN 'Kritisch: ein Problem' WHEN 11 THEN 'No problems, no issues'
 WHEN 12 THEN 'Revenue was 12 million' WHEN 13 THEN 'Es sind neun Prozent, sagt er' WHEN 14 THEN 'Ten percent it will be' WHEN 15 THEN 'Can you decide what is 4?' ELSE text END AS text FROM turns"""


def cue_extraction(spark, sf_dir):
    return P.cue_objects(run_sql(spark, sf_dir, _SPOKEN), "session_id").select("session_id", "idx", "type", "number")


def cue_status(spark, sf_dir):
    return P.cue_objects(run_sql(spark, sf_dir, _SPOKEN), "session_id").groupBy("session_id").pivot("type", list(P.CUES)).agg(F.count(F.lit(1))).na.fill(0)


def due_hints(spark, sf_dir):
    t = _turns(spark, sf_dir).select("session_id", "idx", T.due_hint(F.col("text")).alias("due"))
    return t.filter("due IS NOT NULL")


def row_revisions(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("revision", P.row_revision("idx", "speaker", "text"))
    return P.revision_ids(t, "session_id", "revision")


def stale_evidence(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("revision", P.row_revision("idx", "text"))
    old = t.withColumn("revision", F.when(F.col("idx") % 4 == 1, F.lit("before")).otherwise(F.col("revision"))).withColumn("idx", F.when(F.col("session_id") % 5 == 0, F.col("idx") + 1000).otherwise(F.col("idx")))
    return P.stale_evidence(old.select("session_id", "idx", "revision", "speaker"), t, ["session_id", "idx"]).select("session_id", "idx", "state")


def change_set(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = o.filter("o_orderkey % 5 <> 0").withColumn("h", F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.col("o_orderstatus")))
    return P.change_set(old, o.filter("o_orderkey % 3 <> 0").withColumn("h", F.col("o_orderstatus")), ["o_orderkey"], "h").groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def latest_revision(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return P.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def dedupe_last(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return P.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def corrected_rows(spark, sf_dir):
    t = _turns(spark, sf_dir)
    fixes = t.filter("idx % 6 = 2").select("session_id", "idx", F.lit("moderator").alias("speaker"))
    c = P.corrected(t, fixes, ["session_id", "idx"])
    return P.speaker_totals(c, ["session_id", "speaker", "source"])


def speaker_totals(spark, sf_dir):
    return P.speaker_totals(_turns(spark, sf_dir), ["session_id", "speaker"])


def session_summary(spark, sf_dir):
    t = _turns(spark, sf_dir)
    s = t.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("speaker").alias("speakers"), F.max("end_ms").alias("length_ms"), F.min_by("text", "idx").alias("first_text"))
    return s.select("session_id", "rows", "speakers", clock(F.floor(F.col("length_ms") / 1000).cast("double")).alias("length"), T.clean_text(F.col("first_text"), 60).alias("title"))


def diverse_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return P.diverse_top(o, "o_orderpriority", "o_totalprice", "o_orderkey", 12).select("o_orderkey", "o_orderpriority", quantized(F.col("o_totalprice"), 2).alias("o_totalprice"))


def outline_rows(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").withColumnRenamed("event_id", "idx")
    return P.outline(p, "session_id", 10).select("session_id", "idx")


def scope_members(spark, sf_dir):
    """Sessions of each speaker, counted, with the hash of their sorted ids; no list of the ids is built."""
    t = _turns(spark, sf_dir).select("speaker", "session_id").distinct()
    return P.ordered_sha256(t, "speaker", "session_id", "session_id").select("speaker", F.col("rows").alias("sessions"), F.col("digest").alias("scope_id"))


def url_video_id(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    watch = F.concat(F.lit("https://www.youtube.com/watch?t=3&v=vid"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://youtu.be/x-"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, watch).otherwise(F.col("url"))
    return p.select("page_id", T.video_id(url).alias("video_id"))


def title_ladder(spark, sf_dir):
    """Title tag, else first heading, else the last part of the address."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.nullif(T.collapsed(F.regexp_extract("html", r"(?s)<title>([^<]*)</title>", 1)), F.lit(""))
    heading = F.nullif(T.collapsed(F.regexp_extract("html", r"(?s)<h1>([^<]*)</h1>", 1)), F.lit(""))
    last = F.element_at(F.filter(F.split("url", "/"), lambda x: x != ""), -1)
    return p.select("page_id", F.coalesce(title, heading, last).alias("title"), T.slug(F.coalesce(title, heading, last)).alias("slug"))


def timecodes(spark, sf_dir):
    t = _turns(spark, sf_dir)
    code = clock((F.col("start_ms") / 1000).cast("double"))
    return t.select("session_id", "idx", code.alias("at"), timecode_seconds(code).alias("seconds"))


_TOK = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}\p{{M}}_''-]+')"


def _tok(x: str) -> str:
    return _TOK.format(x=x)


def _q(x: str, k: int = 6) -> str:
    return f"floor(({x}) * {10**k}.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / {10**k}.0::DOUBLE"


_ASCII = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
_BM = f"""d AS (SELECT doc_id, {_tok('text')} AS w FROM documents), q AS (SELECT item_id AS query, unnest(list_distinct({_tok('text')})) AS t FROM benchmark WHERE item_id % 50 = 0),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d), tf AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT q.query, tf.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(1.0::DOUBLE, a)))) AS score FROM tf JOIN df ON tf.t = df.t JOIN q ON tf.t = q.t, n GROUP BY ALL),
bmtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_q("score")} DESC, doc_id) AS place FROM bm) WHERE place <= 30)"""


def _hashed(source: str, key: str) -> str:
    return f"(SELECT {key}, list(x ORDER BY slot) AS e FROM (SELECT k.{key}, s.slot, coalesce(sum(CASE WHEN CAST('0x' || substr(sha256(t), 5, 2) AS INT) % 2 = 1 THEN -1.0::DOUBLE ELSE 1 END) FILTER (WHERE CAST('0x' || substr(sha256(t), 1, 2) AS INT) % 64 = s.slot), 0) AS x FROM (SELECT {key}, unnest(w) AS t FROM {source}) k, (SELECT unnest(range(64)) AS slot) s GROUP BY ALL) GROUP BY {key})"


_CUE = " UNION ALL ".join("SELECT session_id, idx, '{}' AS type, {} AS cap FROM spoken WHERE regexp_matches(text, '{}')".format(k, n, p.replace("'", "''")) for k, (p, n) in P.CUES.items())
_CUES = f"spoken AS ({_SPOKEN}), c AS ({_CUE}), cues AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, type ORDER BY idx) AS INT) AS number FROM c) WHERE number <= cap)"


def _clock(x: str) -> str:
    r = f"CAST(round_even({x}, 0) AS BIGINT)"
    return f"CASE WHEN {r} >= 3600 THEN lpad(CAST({r} // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST({r} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({r} % 60 AS VARCHAR), 2, '0')"


_REV = r"substr(sha256(concat_ws(chr(31), '=' || idx, coalesce('=' || speaker, '~'), coalesce('=' || text, '~'))), 1, 16)"
_URL = "CASE page_id % 3 WHEN 0 THEN 'https://youtu.be/x-' || page_id WHEN 1 THEN 'https://www.youtube.com/watch?t=3&v=vid' || page_id ELSE url END"

SQL = {
    "token_stats": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_tokens FROM (SELECT doc_id, {_tok('text')} AS w FROM documents)",
    "token_jaccard": f"WITH t AS (SELECT session_id, idx, {_ASCII} AS w FROM turns), p AS (SELECT *, lag(w) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM t), c AS (SELECT session_id, idx, w, p, len(list_intersect(list_distinct(w), list_distinct(p))) AS i, len(list_distinct(list_concat(w, p))) AS u, coalesce(list_sum(list_transform(list_distinct(w), lambda x: least(len(list_filter(w, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0) AS m FROM p WHERE p IS NOT NULL) SELECT session_id, idx, {_q('CASE WHEN len(w) > 0 AND len(p) > 0 THEN i::DOUBLE / u ELSE 0 END')} AS jaccard, {_q('CASE WHEN len(w) > 0 AND len(p) > 0 THEN m::DOUBLE / least(len(w), len(p)) ELSE 0 END')} AS overlap FROM c",
    "hash_embedding": f"WITH t AS (SELECT session_id * 100000 + idx AS k, session_id, idx, {_tok('text')} AS w FROM turns), h AS {_hashed('t', 'k')}, f AS (SELECT t.session_id, t.idx, coalesce(h.e, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS e FROM t LEFT JOIN h ON t.k = h.k) SELECT session_id, idx, list_transform(e, lambda x: {_q('CASE WHEN list_dot_product(e, e) > 0 THEN x / sqrt(list_dot_product(e, e)) ELSE 0 END')}) AS embedding FROM f",
    "bm25_topk": f"WITH {_BM} SELECT query, doc_id, {_q('score')} AS score FROM bmtop",
    "rrf_search": f"WITH {_BM}, hd AS {_hashed('d', 'doc_id')}, qd AS (SELECT item_id, {_tok('text')} AS w FROM benchmark WHERE item_id % 50 = 0), hq AS {_hashed('qd', 'item_id')}, s AS (SELECT item_id AS query, doc_id, list_dot_product(hq.e, hd.e) / nullif(sqrt(list_dot_product(hq.e, hq.e)) * sqrt(list_dot_product(hd.e, hd.e)), 0) AS c FROM hq, hd), st AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY {_q('coalesce(c, 0)')} DESC, doc_id) AS place FROM s), u AS (SELECT query, doc_id, place FROM st WHERE place <= 30 UNION ALL SELECT query, doc_id, place FROM bmtop), b AS (SELECT item_id AS query, doc_id, 0.04::DOUBLE AS points FROM benchmark q, documents d WHERE item_id % 50 = 0 AND length(source) >= 4 AND contains(lower(q.text), lower(source))), p AS (SELECT query, doc_id, 1.0::DOUBLE / (60 + place) AS points FROM u UNION ALL SELECT * FROM b), f AS (SELECT query, doc_id, {_q('sum(points)', 9)} AS score FROM p GROUP BY query, doc_id) SELECT query, doc_id, {_q('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM f) WHERE place <= 30",
    "evidence_neighbours": "SELECT session_id, idx, speaker FROM turns t WHERE EXISTS (SELECT 1 FROM turns h WHERE h.session_id = t.session_id AND abs(h.idx - t.idx) <= 1 AND contains(h.text, 'than'))",
    "exact_term_rows": f"SELECT session_id, idx, CAST(matched AS INT) AS matched FROM (SELECT session_id, idx, start_ms, len(list_intersect(list_distinct({_tok('text')}), ['please', 'answer', 'tion', 'thre', 'than'])) AS matched FROM turns) WHERE matched > 0 ORDER BY matched DESC, start_ms, session_id, idx LIMIT 6",
    "cue_extraction": f"WITH {_CUES} SELECT session_id, idx, type, number FROM cues",
    "cue_status": f"WITH {_CUES} SELECT session_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in P.CUES) + " FROM cues GROUP BY session_id",
    "due_hints": r"SELECT * FROM (SELECT session_id, idx, nullif(trim(regexp_extract(text, '(?i)\b(by|until|bis)\s+([^,.!?;]{2,40})', 0)), '') AS due FROM turns) WHERE due IS NOT NULL",
    "row_revisions": f"SELECT session_id, substr(sha256(string_agg({_REV}, ',' ORDER BY idx)), 1, 32) AS revision_id, count(*) AS rows FROM turns GROUP BY session_id",
    "stale_evidence": "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN idx + 1000 ELSE idx END AS idx, CASE WHEN session_id % 5 = 0 THEN 'missing' WHEN idx % 4 = 1 THEN 'changed' ELSE 'current' END AS state FROM turns",
    "change_set": "WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0) SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'keep' ELSE 'update' END AS change, count(*) AS rows FROM o FULL JOIN n ON o.k = n.k GROUP BY 1",
    "latest_revision": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1",
    "dedupe_last": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1",
    "corrected_rows": "SELECT session_id, CASE WHEN idx % 6 = 2 THEN 'moderator' ELSE speaker END AS speaker, CASE WHEN idx % 6 = 2 THEN 'user_confirmed' ELSE 'embedding' END AS source, count(*) AS sentences, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS speech_ms FROM turns GROUP BY ALL",
    "speaker_totals": "SELECT session_id, speaker, count(*) AS sentences, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS speech_ms FROM turns GROUP BY ALL",
    "session_summary": f"WITH s AS (SELECT session_id, count(*) AS rows, count(DISTINCT speaker) AS speakers, max(end_ms) // 1000 AS n, trim(regexp_replace(arg_min(text, idx), '\\s+', ' ', 'g')) AS t FROM turns GROUP BY session_id) SELECT session_id, rows, speakers, {_clock('n::DOUBLE')} AS length, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '...' ELSE t END AS title FROM s",
    "diverse_orders": f"SELECT o_orderkey, o_orderpriority, {_q('o_totalprice', 2)} AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) ORDER BY CASE WHEN p = 1 THEN 0 ELSE 1 END, orders.o_totalprice DESC, o_orderkey LIMIT 12".replace("orders.o_totalprice", "o_totalprice"),
    "outline_rows": "SELECT session_id, idx FROM (SELECT session_id, event_id AS idx, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY session_id) AS n FROM probes) WHERE p % greatest(1, n // 10) = 0 AND p::DOUBLE / greatest(1, n // 10) < 10",
    "scope_members": "SELECT speaker, count(*) AS sessions, sha256(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id)) AS scope_id FROM (SELECT DISTINCT speaker, session_id FROM turns) GROUP BY speaker",
    "url_video_id": rf"SELECT page_id, coalesce(nullif(regexp_extract({_URL}, 'youtu\.be/([\w-]+)', 1), ''), nullif(regexp_extract({_URL}, '[?&]v=([\w-]+)', 1), ''), nullif(regexp_extract({_URL}, '/(?:embed|shorts|live)/([\w-]+)', 1), '')) AS video_id FROM pages",
    "title_ladder": r"SELECT page_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1), '\s+', ' ', 'g')), ''), list_filter(string_split(url, '/'), lambda x: x <> '')[-1]) AS title FROM pages)",
    "timecodes": f"SELECT session_id, idx, {_clock('start_ms / 1000.0')} AS at, CAST(round_even(start_ms / 1000.0, 0) AS DOUBLE) AS seconds FROM turns",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL} | {"chunk_transcript": chunk_transcript}


def chunk_transcript(spark, sf_dir):
    return R.chunks(_turns(spark, sf_dir), "session_id")


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
