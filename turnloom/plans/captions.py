"""Queries of the caption rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import speech as S
from turnloom.functions import text as T
from turnloom.functions.numbers import quantized, seconds_to_samples, sigmoid
from turnloom.operators import sequence as Q
from turnloom.plans.views import frame, run_sql, with_views

AT = ("session_id", "idx")


def _captions(spark, sf_dir):
    return frame(spark, sf_dir, "captions")


def evidence_texts(spark, sf_dir):
    return _captions(spark, sf_dir).select(*AT, S.evidence_text(F.col("text")).alias("evidence"), S.normalized(F.col("text")).alias("normalized"))


def stage_directions(spark, sf_dir):
    """Rows that stay once stage directions are filtered out, by session."""
    c = _captions(spark, sf_dir)
    return c.groupBy("session_id").agg(F.count_if(S.stage_direction(F.col("text"))).alias("directions"), F.count_if(~F.coalesce(S.stage_direction(F.col("text")), F.lit(False))).alias("kept"))


def embedding_candidates(spark, sf_dir):
    c = _captions(spark, sf_dir)
    return c.select(*AT, F.size(S.content_words(F.coalesce("text", F.lit("")))).alias("content_words"), S.worth_embedding(F.col("text")).alias("worth"))


def ellipsis_parts(spark, sf_dir):
    return _captions(spark, sf_dir).filter("text IS NOT NULL").select(*AT, F.posexplode(S.ellipsis_parts(F.col("text"))).alias("part", "piece"))


def sentence_case(spark, sf_dir):
    c = _captions(spark, sf_dir)
    return c.select(*AT, S.sentence_case(F.col("text")).alias("cased"), T.ends_sentence(F.col("text")).alias("ends"))


def joined_words(spark, sf_dir):
    """Words put together again, with the place of each word in the joined text."""
    c = _captions(spark, sf_dir).filter("text IS NOT NULL")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return c.select(*AT, T.words_to_text(words).alias("joined"), F.posexplode(S.mapped_words(words)).alias("place", "w")).select(*AT, "joined", "place", "w.word", "w.start", "w.end")


def sentence_spans(spark, sf_dir):
    """Where the second sentence of a row starts, looked for after the first."""
    c = _captions(spark, sf_dir).filter("text IS NOT NULL")
    parts = F.regexp_extract_all("text", F.lit(r"([^.!?]+[.!?]*)"))
    second = F.trim(F.get(parts, F.lit(1)))
    at = F.expr("locate(second, text, first_end + 1)")
    return c.select(*AT, "text", second.alias("second"), F.length(F.get(parts, F.lit(0))).alias("first_end")).filter("second <> ''").select(*AT, (at - 1).alias("start"), (at - 1 + F.length("second")).alias("end"))


#: Captions whose last rows often thank for watching, some by a guest who says nothing else.
_CREDITS = """SELECT session_id, idx, end_ms - start_ms AS duration_ms, CASE WHEN (session_id + idx) % 4 < 2 AND idx >= 2 THEN CONCAT('G', CAST(idx % 3 AS VARCHAR(20))) WHEN session_id % 7 = 1 AND idx = 0 THEN NULL ELSE speaker END AS speaker,
 CASE WHEN (session_id + idx) % 3 <> 1 AND idx >= 2 THEN 'So, Like and SUBSCRIBE.' ELSE text END AS text FROM captions"""


def promo_outro(spark, sf_dir):
    """Promotional rows at the end of a session, by someone heard nowhere else, given to the first speaker."""
    out = Q.promotional_outro(run_sql(spark, sf_dir, _CREDITS), "session_id", S.promotional(F.col("text")))
    return out.select(*AT, S.promotional(F.col("text")).alias("promo"), "outro", "fixed")


def stock_phrases(spark, sf_dir):
    c = _captions(spark, sf_dir).withColumn("media", F.max("end_ms").over(W.partitionBy("session_id")))
    return c.select(*AT, S.made_up(F.col("text"), F.col("start_ms") / 1000.0, F.col("media") / 1000.0).alias("m")).filter("m IS NOT NULL").select(*AT, "m.rule", "m.risk", "m.suspicion", "m.verification")


def token_sequences(spark, sf_dir):
    c = _captions(spark, sf_dir)
    return c.filter(T.contains_tokens(T.text_tokens(F.col("text")), F.array(F.lit("for"), F.lit("watching")))).select(*AT)


def repaired_texts(spark, sf_dir):
    """Texts that control characters were put into, without them."""
    c = _captions(spark, sf_dir).filter("text IS NOT NULL").withColumn("text", F.concat(F.char(F.lit(1)), F.col("text"), F.char(F.lit(27)), F.char(F.lit(9)), F.char(F.lit(8))))
    return c.select(*AT, S.repaired(F.col("text")).alias("text"))


def session_topics(spark, sf_dir):
    """A title from the first eight rows of each session."""
    c = _captions(spark, sf_dir)
    first = F.row_number().over(W.partitionBy("session_id").orderBy("idx"))
    texts = c.withColumn("n", first).filter("n <= 8").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))).alias("rows"))
    return texts.select("session_id", F.coalesce(S.topic(F.array_join("rows.text", " ")), F.lit("")).alias("topic"))


def language_codes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spelled = F.when(F.col("doc_id") % 4 == 0, F.upper("lang")).when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("_XX"))).when(F.col("doc_id") % 4 == 2, F.lit(" German ")).otherwise(F.lit("klingon"))
    return d.select("doc_id", S.language_code(spelled).alias("code"))


def speaker_keys(spark, sf_dir):
    s = frame(spark, sf_dir, "sentences")
    key = F.when(F.col("idx") % 3 == 0, F.lower("speaker")).when(F.col("idx") % 3 == 1, F.concat(F.lit("Speaker"), F.substring("speaker", 2, 9))).otherwise(F.lit("unknown"))
    return s.select(*AT, S.speaker_of_key(key).alias("from_key"), T.label_index(F.col("speaker")).alias("number"))


def datetime_labels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.date_format("ts", "MMM d HH:mm").alias("label"))


def sample_counts(spark, sf_dir):
    t = frame(spark, sf_dir, "turns")
    return t.select(*AT, seconds_to_samples((F.col("end_ms") - F.col("start_ms")).cast("decimal(18,0)") / 1000, 16000).alias("samples"), quantized(sigmoid((F.col("idx") - 5) * 20.0), 9).alias("s"))


def json_bodies(spark, sf_dir):
    t = frame(spark, sf_dir, "turns")
    fenced = F.concat(F.when(F.col("idx") % 2 == 0, F.lit("```json\n")).otherwise(F.lit("")), F.lit('{"idx": '), F.col("idx").cast("string"), F.lit("}"), F.when(F.col("idx") % 2 == 0, F.lit("\n```")).otherwise(F.lit("  ")))
    return t.select(*AT, F.get_json_object(S.without_fence(fenced), "$.idx").cast("long").alias("value"))


def source_hashes(spark, sf_dir):
    return _captions(spark, sf_dir).select(*AT, F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"))


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_N = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:[''’]\p{L}+)*')"
_CONTENT = f"list_filter({_WORDS}, lambda w: w NOT IN ({_list(S.VOCABLES)}))"
_SPLIT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_PROMO = "(SELECT *, coalesce(list_contains(w, 'subscribe') OR (list_contains(w, 'youtube') AND list_has_any(w, ['like', 'watch', 'catch', 'channel'])) OR (list_contains(w, 'notification') AND list_contains(w, 'bell')), false) AS promo FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS w FROM ({})))"

SQL = {
    "evidence_texts": rf"SELECT session_id, idx, array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+'), ' ') AS evidence, {_N} AS normalized FROM captions",
    "stage_directions": "SELECT session_id, count(*) FILTER (WHERE d) AS directions, count(*) FILTER (WHERE NOT coalesce(d, false)) AS kept FROM (SELECT session_id, regexp_matches(text, '(^|[^A-Za-z])(LAUGHTER|APPLAUSE|CHEERING)($|[^A-Za-z])') AS d FROM captions) GROUP BY session_id",
    "embedding_candidates": f"SELECT session_id, idx, CAST(len(c) AS INT) AS content_words, len(c) > 0 AND NOT (regexp_matches(text, '[♪♫]') AND len(c) <= 2) AND NOT (len(w) >= 4 AND (len(w) - len(c)) * 10 >= len(w) * 6) AS worth FROM (SELECT *, {_WORDS} AS w, {_CONTENT} AS c FROM captions)",
    "ellipsis_parts": r"WITH p AS (SELECT session_id, idx, list_filter(list_transform(string_split(regexp_replace(text, '(\.{3,}|…)(\s*[\p{L}\p{N}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM captions WHERE text IS NOT NULL) SELECT session_id, idx, CAST(k.k - 1 AS INT) AS part, ps[k.k] AS piece FROM p, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS k) k",
    "sentence_case": r"""SELECT session_id, idx, CASE WHEN a <= length(text) AND text[a] <> upper(text[a]) AND NOT (text[a + 1] <> lower(text[a + 1]) AND regexp_matches(text[a + 1], '\p{L}')) THEN concat(text[1 : a - 1], upper(text[a]), text[a + 1 :]) ELSE text END AS cased, regexp_matches(regexp_replace(trim(text), '["''”’)\]]+$', ''), '[.?!…]$') AS ends FROM (SELECT *, length(regexp_extract(text, '^[^\p{L}]*')) + 1 AS a FROM captions)""",
    "joined_words": rf"WITH s AS (SELECT session_id, idx, {_SPLIT} AS ws FROM captions WHERE text IS NOT NULL), e AS (SELECT session_id, idx, regexp_replace(array_to_string(ws, ' '), '\s+([,.;:!?])', '\1', 'g') AS joined, CAST(k.k - 1 AS INT) AS place, ws[k.k] AS word FROM s, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS k) k), l AS (SELECT *, length(word) + CASE WHEN place = 0 OR contains('.,?!;:%)]}}…', word[1]) THEN 0 ELSE 1 END AS step FROM e), t AS (SELECT *, CAST(sum(step) OVER (PARTITION BY session_id, idx ORDER BY place) AS INT) AS last FROM l) SELECT session_id, idx, joined, place, word, CAST(last - length(word) AS INT) AS start, last AS end FROM t",
    "sentence_spans": r"WITH p AS (SELECT session_id, idx, text, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ps FROM captions WHERE text IS NOT NULL), q AS (SELECT *, trim(ps[2]) AS second, length(ps[1]) AS n FROM p), f AS (SELECT *, CAST(instr(text[n + 1 :], second) AS INT) AS k FROM q WHERE second <> '') SELECT session_id, idx, CAST(CASE WHEN k > 0 THEN n + k - 1 ELSE -1 END AS INT) AS start, CAST(CASE WHEN k > 0 THEN n + k - 1 ELSE -1 END + length(second) AS INT) AS end FROM f",
    "promo_outro": f"""WITH p AS {_PROMO.format(_CREDITS)}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS late, count(*) OVER (PARTITION BY session_id, speaker) AS n,
 first_value(speaker IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS host FROM p),
 t AS (SELECT session_id, speaker AS host, sum(duration_ms) AS ms FROM p GROUP BY ALL),
 m AS (SELECT o.*, coalesce(promo AND late <= 2 AND n = 1 AND speaker <> o.host AND duration_ms <= 12000 AND ms >= 5000, false) AS outro FROM o LEFT JOIN t ON t.session_id = o.session_id AND t.host = o.host)
SELECT session_id, idx, promo, outro, CASE WHEN outro THEN host ELSE speaker END AS fixed FROM m""",
    "stock_phrases": f"""WITH t AS (SELECT *, {_N} AS n, start_ms / 1000.0::DOUBLE AS s, max(end_ms) OVER (PARTITION BY session_id) / 1000.0::DOUBLE AS media FROM captions), c(text_, rule_) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in S.CREDITS.items())}),
r AS (SELECT t.*, CASE WHEN c.rule_ IS NOT NULL THEN c.rule_ WHEN contains(' ' || n || ' ', ' amara ') AND contains(' ' || n || ' ', ' org ') THEN 'amara_org' WHEN n IN ('thanks for watching', 'thank you for watching') THEN 'thanks_for_watching' WHEN contains(' ' || n || ' ', ' thanks for watching ') OR contains(' ' || n || ' ', ' thank you for watching ') THEN 'thanks_for_watching_in_context' WHEN contains(' ' || n || ' ', ' amara ') THEN 'amara_name' END AS rule FROM t LEFT JOIN c ON t.n = c.text_)
SELECT session_id, idx, rule, CAST(CASE WHEN rule LIKE 'credit%' THEN 100 WHEN rule = 'thanks_for_watching' THEN 85 WHEN rule = 'amara_name' THEN 30 ELSE 60 END AS INT) AS risk,
CAST(CASE WHEN rule LIKE 'credit%' THEN 0.9 WHEN rule = 'amara_org' THEN 0.8 WHEN rule = 'amara_name' THEN 0.5 WHEN s <= 3 THEN 0.82 WHEN s >= media * 0.9::DOUBLE THEN 0.6 ELSE 0.72 END AS DOUBLE) AS suspicion,
CAST(CASE WHEN rule LIKE 'credit%' THEN 0.7 WHEN rule = 'amara_org' THEN 0.65 WHEN rule = 'amara_name' THEN 0.5 WHEN s <= 3 THEN 0.62 WHEN s >= media * 0.9::DOUBLE THEN 0.5 ELSE 0.56 END AS DOUBLE) AS verification FROM r WHERE rule IS NOT NULL""",
    "token_sequences": "SELECT session_id, idx FROM captions WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') || ' ', ' for watching ')",
    "repaired_texts": "SELECT session_id, idx, concat(text, chr(9)) AS text FROM captions WHERE text IS NOT NULL",
    "session_topics": r"WITH f AS (SELECT session_id, lower(string_agg(coalesce(text, ''), ' ' ORDER BY idx)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM captions) WHERE n <= 8 GROUP BY session_id) SELECT session_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in S.TOPICS) + " ELSE '' END AS topic FROM f",
    "language_codes": "SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'de' WHEN doc_id % 4 < 2 AND lang IN ('en', 'de', 'fr', 'es') THEN lang END AS code FROM documents",
    "speaker_keys": "SELECT session_id, idx, CASE WHEN idx % 3 < 2 THEN speaker END AS from_key, CAST(substr(speaker, 2) AS INT) AS number FROM sentences",
    "datetime_labels": "SELECT event_id, strftime(ts, '%b %-d %H:%M') AS label FROM events",
    "sample_counts": "SELECT session_id, idx, CAST((end_ms - start_ms) * 16 AS BIGINT) AS samples, floor(1.0::DOUBLE / (1 + exp(-greatest(-60.0, least(60.0, (idx - 5) * 20.0)))::DOUBLE) * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE AS s FROM turns",
    "json_bodies": "SELECT session_id, idx, CAST(idx AS BIGINT) AS value FROM turns",
    "source_hashes": "SELECT session_id, idx, sha256(coalesce(text, '')) AS source_hash FROM captions",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
