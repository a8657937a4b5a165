"""Queries of the speaker memory. Each row depends on all before it, so SQL has no plain form; tests use a second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import memory as M
from turnloom.plans.views import frame


def _assigned(spark, sf_dir, limits):
    s = frame(spark, sf_dir, "sentences").withColumn("seconds", F.col("duration_ms") / 1000.0)
    out = M.assigned(s, "session_id", ["idx"], "embedding", "seconds", limits)
    return out.select("session_id", "idx", "assigned", "created", "source", *(quantized(F.col(c), 4).alias(c) for c in ("unknown", "similarity", "margin")))


def speaker_memory(spark, sf_dir):
    return _assigned(spark, sf_dir, M.Limits())


def confirmed_memory(spark, sf_dir):
    """The same where a speaker needs two vectors, and vectors unlike all speakers wait."""
    return _assigned(spark, sf_dir, M.Limits(confirmations=2, first_now_s=2.5, known_similarity=0.5))


def queries() -> dict:
    return {q.__name__: q for q in (speaker_memory, confirmed_memory)}


def oracle_sql() -> dict[str, str]:
    return {}
