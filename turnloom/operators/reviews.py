"""Checks before a result is kept: hand-offs between two speakers, timings of words, review states of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import speech as S
from turnloom.operators.evaluation import sentence_groups

#: Least similarity, lead over the other speaker, lead over all others, and sum of the two leads.
GATES = (0.35, 0.15, 0.08, 0.50)
#: States of an object that somebody has looked at.
REVIEWED = ("accepted", "rejected", "edited")


def _side(side: str, expected: str, other: str) -> dict[str, Column]:
    here = F.col("side") == side
    best = lambda speaker: F.max(F.when(here & speaker, F.col("similarity")))
    mine = F.col("speaker") == F.col(expected)
    return {f"{side}_own": best(mine), f"{side}_other": best(F.col("speaker") == F.col(other)), f"{side}_next": best(~mine)}


def context_handoffs(similarities: DataFrame, key: list[str], gates: tuple[float, float, float, float] = GATES) -> DataFrame:
    """Whether the context on both sides of a gap bears out a hand-off from ``speaker_a`` to ``speaker_b``.

    ``similarities`` has for each case (``key``, speaker_a, speaker_b) rows of side ('left' or 'right'), speaker and
    similarity; null and non-finite similarities count as absent. One aggregate: (key, accepted, reason, left_pair,
    right_pair, left_lead, right_lead, separation), the leads over the other speaker and over all others. A side
    without both speakers has leads of 0 and the reason is 'missing_context_profile_score'.
    """
    finite = similarities.withColumn("similarity", F.col("similarity").cast("double"))
    finite = finite.withColumn("similarity", F.when(~F.isnan("similarity") & (F.abs("similarity") < float("inf")), F.col("similarity")))
    sums = _side("left", "speaker_a", "speaker_b") | _side("right", "speaker_b", "speaker_a")
    g = finite.groupBy(*key, "speaker_a", "speaker_b").agg(*(c.alias(n) for n, c in sums.items()))
    for side in ("left", "right"):
        own, other, nearest = (F.col(f"{side}_{n}") for n in ("own", "other", "next"))
        whole = own.isNotNull() & other.isNotNull()
        g = g.withColumns({f"{side}_whole": whole, f"{side}_pair": F.when(whole, own - other).otherwise(0.0), f"{side}_lead": F.when(whole, own - nearest).otherwise(0.0)})
    g = g.withColumn("separation", F.col("left_pair") + F.col("right_pair"))
    least = lambda n: F.least(f"left_{n}", f"right_{n}")
    reason = (
        F.when(~(F.col("left_whole") & F.col("right_whole")), "missing_context_profile_score")
        .when(least("own") < gates[0], "weak_context_similarity")
        .when(least("pair") < gates[1], "weak_context_pair_margin")
        .when(least("lead") < gates[2], "context_matches_third_speaker")
        .when(F.col("separation") < gates[3], "weak_context_separation")
        .otherwise("accepted")
    )
    return g.withColumn("reason", reason).select(*key, (F.col("reason") == "accepted").alias("accepted"), "reason", "left_pair", "right_pair", "left_lead", "right_lead", "separation")


def timing_faults(words: DataFrame, key: str, order_by: list[str], text: str, segment: str, start_ms: str, end_ms: str) -> DataFrame:
    """Words with ``sentence`` and ``impossible``: whether the times of their sentence cannot be those of speech.

    Judged on the words that have a letter or digit: no time at all, under 40 ms for each of two or more words, or two
    or more words without length in under 250 ms. A sentence without such words is never at fault.
    """
    g = sentence_groups(words, key, order_by, text, segment)
    tokens = F.size(F.filter(F.split(S.normalized(F.coalesce(F.col(text), F.lit(""))), " "), lambda t: t != ""))
    w = W.partitionBy(key, "sentence")
    spoken = F.col("_tokens") > 0
    g = g.withColumn("_tokens", tokens).withColumns({
        "_span": F.greatest(F.lit(0), F.max(F.when(spoken, F.col(end_ms))).over(w) - F.min(F.when(spoken, F.col(start_ms))).over(w)),
        "_flat": F.count(F.when(spoken & (F.col(end_ms) <= F.col(start_ms)), 1)).over(w),
        "_all": F.sum("_tokens").over(w),
    })
    fault = (F.col("_all") > 0) & ((F.col("_span") <= 0) | ((F.col("_all") >= 2) & (F.col("_span") < 40 * F.col("_all"))) | ((F.col("_flat") >= 2) & (F.col("_span") < 250)))
    return g.withColumn("impossible", F.coalesce(fault, F.lit(False))).drop("_tokens", "_span", "_flat", "_all")


def review_states(reports: DataFrame, objects: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, status, needs_review, stale_objects) for each report from the states of its objects; no state is 'draft'.

    Stale goes before all, then 'reviewed' if every object was looked at, 'partially_reviewed' if one was, else
    'draft', which a report without objects is too.
    """
    seen = F.col(status).isin(*REVIEWED)
    o = objects.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(seen).alias("_seen"), F.count_if(F.col(status) == "stale").alias("_stale"))
    r = reports.select(key, F.col(status).alias("_was")).join(o, key, "left").fillna(0, ["_n", "_seen", "_stale"])
    state = (
        F.when((F.col("_stale") > 0) | (F.col("_was") == "stale"), "stale")
        .when((F.col("_n") > 0) & (F.col("_seen") == F.col("_n")), "reviewed")
        .when(F.col("_seen") > 0, "partially_reviewed")
        .otherwise("draft")
    )
    return r.select(key, state.alias("status"), F.col("_stale").alias("stale_objects")).withColumn("needs_review", F.col("status") != "reviewed")
