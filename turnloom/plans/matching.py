"""Queries of the text joins. The alignment has no SQL form here; tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import matching as M
from turnloom.functions import speech as S
from turnloom.functions import text as T
from turnloom.functions.numbers import quantized
from turnloom.operators import matching as J
from turnloom.plans.views import frame, with_views


def _pairs(spark, sf_dir, reach):
    return J.near_pairs(frame(spark, sf_dir, "captions").select("session_id", "idx", "text"), frame(spark, sf_dir, "turns").select("session_id", "idx", "speaker", "text"), "session_id", "idx", reach)


def lcs_lengths(spark, sf_dir):
    p = _pairs(spark, sf_dir, 1)
    return p.select("session_id", F.col("place").alias("idx"), "other", M.lcs_length(T.text_tokens(F.col("text")), T.text_tokens(F.col("other_text"))).alias("common"))


def lcs_alignments(spark, sf_dir):
    p = _pairs(spark, sf_dir, 0)
    return p.select("session_id", F.col("place").alias("idx"), F.explode(M.lcs_alignment(T.text_tokens(F.col("text")), T.text_tokens(F.col("other_text")))).alias("p")).select("session_id", "idx", "p.left", "p.right")


def speaker_votes(spark, sf_dir):
    out = J.speaker_votes(_pairs(spark, sf_dir, 2), "session_id", "speaker")
    return out.withColumn("share", quantized(F.col("share")))


def evidence_matches(spark, sf_dir):
    """Whether the first twelve words of a row, without the third, nearly occur in the row itself and in the next one."""
    p = _pairs(spark, sf_dir, 1)
    words = F.split(S.evidence_text(F.col("other_text")), " ")
    quote = F.concat(F.slice(words, 1, 2), F.slice(words, 4, 9))
    return p.select("session_id", F.col("place").alias("idx"), "other", M.evidence_matches(quote, F.split(S.evidence_text(F.coalesce("text", F.lit(""))), " ")).alias("matches"))


SQL = {
    # A row of the table from the one before it, word by word; each word of the left text comes as its matches in the right.
    "lcs_lengths": """WITH p AS (SELECT c.session_id, c.idx, t.idx AS other, coalesce(regexp_extract_all(lower(c.text), '[a-z0-9'']+'), []) AS a, regexp_extract_all(lower(t.text), '[a-z0-9'']+') AS b FROM captions c JOIN turns t ON c.session_id = t.session_id AND abs(c.idx - t.idx) <= 1),
m AS (SELECT session_id, idx, other, list_prepend(list_transform(b, lambda x: 0), list_transform(a, lambda w: list_transform(b, lambda x: CASE WHEN x = w THEN 1 ELSE 0 END))) AS rows FROM p)
SELECT session_id, idx, other, CAST(coalesce(list_reduce(rows, lambda prev, hits: list_transform(range(1, len(hits) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN hits[k] = 1 THEN CASE WHEN k > 1 THEN prev[k - 1] ELSE 0 END + 1 ELSE prev[k] END))))[-1], 0) AS INT) AS common FROM m""",
}


def queries() -> dict:
    return {q.__name__: q for q in (lcs_lengths, lcs_alignments, speaker_votes, evidence_matches)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
