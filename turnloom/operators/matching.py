"""Joins of rows by their texts: near rows, votes of aligned words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import matching as M
from turnloom.functions import text as T


def near_pairs(rows: DataFrame, others: DataFrame, key: str, place: str, reach: int) -> DataFrame:
    """Pairs of a row and the other rows at most ``reach`` places away in the same session: an equi-join on the places."""
    a = rows.select(key, F.col(place).alias("place"), F.col("text").alias("text"), F.explode(F.sequence(F.col(place) - reach, F.col(place) + reach)).alias("_p"))
    b = others.select(F.col(key).alias("_k"), F.col(place).alias("other"), F.col("text").alias("other_text"), *(c for c in others.columns if c not in (key, place, "text")))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_p") == F.col("other"))).drop("_k", "_p")


def speaker_votes(pairs: DataFrame, key: str, speaker: str) -> DataFrame:
    """For each row the speaker most of whose words align with it among the paired rows, with the share of its words."""
    a, b = T.text_tokens(F.col("text")), T.text_tokens(F.col("other_text"))
    met = pairs.withColumns({"_n": F.size(a), "_m": M.lcs_length(a, b)})
    votes = met.groupBy(key, "place", "_n", speaker).agg(F.sum("_m").alias("_v")).filter("_v > 0")
    best = votes.groupBy(key, "place", "_n").agg(F.max_by(F.struct(speaker, "_v"), F.struct("_v", speaker)).alias("b"))
    return best.select(key, "place", F.col(f"b.{speaker}").alias(speaker), (F.col("b._v") / F.greatest("_n", F.lit(1))).alias("share"))
