"""Queries of the guarded filter and of its folds. The filter itself has no SQL; a test holds it against a second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import bayes as B
from turnloom.operators import quarantine as Q
from turnloom.plans import bayes
from turnloom.plans.views import run_sql, with_views

#: Holding times as a signal between -1 and 2, unknown for some probes.
_SIGNAL = "SELECT session_id, tick_ms, event_id, CASE WHEN event_id % 11 = 3 THEN NULL ELSE (hold_ms % 300 - 100) / 100.0 END AS signal FROM probes"


def _signal(spark, sf_dir):
    return run_sql(spark, sf_dir, _SIGNAL).withColumn("signal", F.col("signal").cast("double"))


def running_moments(spark, sf_dir):
    """Weighted mean and variance of the signal up to each probe."""
    out = Q.running_moments(_signal(spark, sf_dir), "session_id", ["tick_ms", "event_id"], "signal")
    return out.withColumns({c: quantized(F.col(c)) for c in ("mean", "variance")})


def running_sums(spark, sf_dir):
    """Decaying sums of the signal and their alerts."""
    out = Q.running_sums(_signal(spark, sf_dir), "session_id", ["tick_ms", "event_id"], "signal")
    return out.withColumn("total", quantized(F.col("total")))


def quarantine_filter(spark, sf_dir):
    """Who speaks at each probe, behind the guard."""
    out = Q.quarantined(*bayes.inputs(spark, sf_dir), "session_id", "at_ms", B.Limits(unknown_bias=-3.0))
    return out.withColumns({c: quantized(F.col(c), 4) for c in ("unknown_sum", "challenger_sum")})


def _walk(state: str, first: str, after: str) -> str:
    return f"""s AS (SELECT session_id, tick_ms, event_id, signal::DOUBLE AS x, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) AS place FROM ({_SIGNAL}) t),
w AS (SELECT session_id, 0::BIGINT AS place, 0::BIGINT AS tick_ms, 0::BIGINT AS event_id, {first} FROM (SELECT DISTINCT session_id FROM s) f
 UNION ALL SELECT s.session_id, s.place, s.tick_ms, s.event_id, {after} FROM w JOIN s ON s.session_id = w.session_id AND s.place = w.place + 1)
SELECT session_id, tick_ms, event_id, {state} FROM w WHERE place > 0"""


SQL = {
    "running_moments": _walk(
        "n AS count, FLOOR(mean * 1000000 + 0.5) / 1000000 AS mean, FLOOR(variance * 1000000 + 0.5) / 1000000 AS variance",
        "0::BIGINT AS n, 0::DOUBLE AS mean, 0::DOUBLE AS variance",
        "CASE WHEN x IS NULL THEN n ELSE n + 1 END, CASE WHEN x IS NULL THEN mean WHEN n = 0 THEN x ELSE mean + 0.16::DOUBLE * (x - mean) END, CASE WHEN x IS NULL OR n = 0 THEN variance ELSE 0.84::DOUBLE * (variance + 0.16::DOUBLE * (x - mean) * (x - mean)) END",
    ),
    "running_sums": _walk("FLOOR(total * 1000000 + 0.5) / 1000000 AS total, total >= 0.9 AS alert", "0::DOUBLE AS total", "GREATEST(0, 0.86::DOUBLE * total + COALESCE(x, 0) - 0.12::DOUBLE)"),
}


def queries() -> dict:
    return {q.__name__: q for q in (running_moments, running_sums, quarantine_filter)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views("WITH " + sql).replace("WITH ", "WITH RECURSIVE ", 1) for name, sql in SQL.items()}
