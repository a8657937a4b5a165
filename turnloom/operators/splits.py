"""Late corrections of live labels: splits of a label that holds two voices, and unknown rows seen again.

Everything is grouped sums, joins of rows with the few profiles of their session, and windows over time; no session's
vectors are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import vectors as V
from turnloom.operators.vectors import scores

#: How a label was given by the voice itself.
TRUSTED = ("embedding", "section_gap_new_speaker")


@dataclass(frozen=True)
class Limits:
    """Fixed values; times in milliseconds, similarities are cosines."""

    core_unknown: float = 0.50
    core_ms: int = 800
    core_rows: int = 4
    core_total_ms: int = 8000
    candidate_unknown: float = 0.50
    candidate_ms: int = 350
    seed_similarity: float = 0.45
    candidate_similarity: float = 0.20
    candidate_gain: float = 0.02
    rows: int = 4
    total_ms: int = 8000
    anchor_ms: int = 0
    span_ms: int = 12_000
    time_groups: int = 2
    time_gap_ms: int = 8000
    average_gain: float = 0.22
    leave_one_out: float = 0.16
    core_similarity: float = 0.58
    iterations: int = 8


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total): rows and weighted sum of their unit vectors ``_u``."""
    parts = rows.select(*keys, "_w", F.posexplode("_u").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum(F.col("_x") * F.col("_w")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(*keys).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda s: s["_t"]).alias("total"))


def _marked(rows: DataFrame, limits: Limits) -> DataFrame:
    """Rows with a vector and a label, their weight, whether the voice gave the label, and whether that is uncertain."""
    trusted = F.coalesce(F.lower(F.trim("source")).isin(*TRUSTED), F.lit(False))
    seconds = F.greatest(F.lit(0.20), F.least(F.lit(2.25), F.col("duration_ms") / 1000.0))
    free = ~F.coalesce("confirmed", F.lit(False)) & ~F.coalesce("rejected", F.lit(False))
    core = trusted & (F.col("duration_ms") >= limits.core_ms) & F.coalesce(F.col("unknown") <= limits.core_unknown, F.lit(True))
    doubtful = free & (F.col("duration_ms") >= limits.candidate_ms) & (~trusted | F.coalesce(F.col("unknown") >= limits.candidate_unknown, F.lit(False)))
    marked = rows.filter("speaker <> ''").withColumns({"_u": V.normalized(V.doubles(F.col("embedding"))), "_w": F.sqrt(seconds), "_core": core, "_pool": doubtful})
    return marked.filter("_u IS NOT NULL AND (_core OR _pool)")


def split_candidates(rows: DataFrame, session: str, place: str, limits: Limits = Limits()) -> DataFrame:
    """Uncertain rows that fit a second voice better than every trusted one: (session, speaker, place, start_ms, end_ms,
    duration_ms, _u, _w, gain, total, n), before the gates of ``delayed_splits``."""
    marked = _marked(rows, limits).select(F.col(session).alias("_s"), "speaker", F.col(place).alias("_p"), "start_ms", "end_ms", "duration_ms", "_u", "_w", "_core", "_pool")
    core = marked.filter("_core")
    enough = core.groupBy("_s", "speaker").agg(F.count(F.lit(1)).alias("_n"), F.sum("duration_ms").alias("_ms")).filter((F.col("_n") >= limits.core_rows) & (F.col("_ms") >= limits.core_total_ms)).select("_s", "speaker")
    cores = _sums(core, ["_s", "speaker"]).join(enough, ["_s", "speaker"], "left_semi").select("_s", F.col("speaker").alias("_label"), V.normalized(F.col("total")).alias("_c"))
    pairs = marked.filter("_pool").join(cores, "_s").withColumn("_d", V.dot(F.col("_u"), F.col("_c")))
    own = F.max(F.when(F.col("_label") == F.col("speaker"), F.col("_d")))
    pool = pairs.groupBy("_s", "speaker", "_p", "start_ms", "end_ms", "duration_ms", "_u", "_w").agg(F.max("_d").alias("_best"), own.alias("_own")).filter("_own IS NOT NULL")
    pool = _cut(pool)
    found = pool.filter(F.col("_own") <= limits.seed_similarity)
    key = ["_s", "speaker"]
    before = None
    for _ in range(max(1, limits.iterations)):
        second = _sums(found, key).filter(F.col("n") >= limits.rows).select(*key, V.normalized(F.col("total")).alias("_c"))
        like = V.dot(F.col("_u"), F.col("_c"))
        found = _cut(pool.join(second, key).filter((like >= limits.candidate_similarity) & (like - F.col("_best") >= limits.candidate_gain)).drop("_c"))
        now = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*key, "_p"))).first()
        if now == before:
            break
        before = now
    totals = _sums(found, key).filter(F.col("n") >= limits.rows)
    near = cores.join(totals.select(*key, V.normalized(F.col("total")).alias("_t")), "_s").groupBy(*key).agg(F.max(V.dot(F.col("_t"), F.col("_c"))).alias("core_similarity"))
    out = found.join(totals, key).join(near, key)
    return out.select(F.col("_s").alias(session), "speaker", F.col("_p").alias(place), "start_ms", "end_ms", "duration_ms", "_u", "_w", (V.dot(F.col("_u"), V.normalized(F.col("total"))) - F.col("_best")).alias("gain"), "total", "n", "core_similarity")


def _cut(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint, as every round reads them again; where no folder is set for it, as they are."""
    return df.checkpoint(eager=True) if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def delayed_splits(rows: DataFrame, session: str, place: str, limits: Limits = Limits()) -> DataFrame:
    """(session, speaker, rows, speech_ms, average_gain, leave_one_out, core_similarity, time_groups, members): labels that
    hold a second voice, found from all rows so far.

    ``rows``: session, place, speaker, source, unknown (its probability), start_ms, end_ms, duration_ms, confirmed,
    rejected, embedding. A label needs a core of rows that the voice itself labelled; the uncertain rows of the label that
    are far from the core seed a second centroid, around which they gather until nothing changes, in at most
    ``iterations`` rounds. The gates ask for enough speech, spread over time, that is close to itself and far from all
    cores. ``members`` are the places of the rows, ascending. Rows without a label, a vector or a session don't count.
    """
    found = split_candidates(rows, session, place, limits)
    key = [session, "speaker"]
    order = W.partitionBy(*key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("start_ms") - reach > limits.time_gap_ms), 1).otherwise(0)
    others = F.zip_with("total", "_u", lambda t, x: t - x * F.col("_w"))
    each = found.withColumns({"_new": starts, "_loo": V.dot(F.col("_u"), V.normalized(others))})
    stats = each.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("duration_ms").alias("speech_ms"), F.avg("gain").alias("average_gain"), F.avg("_loo").alias("leave_one_out"),
        F.first("core_similarity").alias("core_similarity"), F.sum("_new").alias("time_groups"), F.array_sort(F.collect_list(place)).alias("members"),
        F.max("duration_ms").alias("_longest"), (F.max("end_ms") - F.min("start_ms")).alias("_span"),
    )
    kept = (F.col("rows") >= limits.rows) & (F.col("speech_ms") >= limits.total_ms) & (F.col("_longest") >= limits.anchor_ms) & (F.col("_span") >= limits.span_ms) & (F.col("time_groups") >= limits.time_groups)
    kept = kept & (F.col("core_similarity") <= limits.core_similarity) & (F.col("average_gain") >= limits.average_gain) & (F.col("leave_one_out") >= limits.leave_one_out)
    return stats.filter(kept).drop("_longest", "_span")


def with_splits(rows: DataFrame, splits: DataFrame, session: str, place: str) -> DataFrame:
    """The rows with ``fixed``: the members of the k-th split of a session (by speaker) get the label speaker + "/2"."""
    moved = splits.select(F.col(session).alias("_s"), F.col("speaker").alias("_l"), F.explode("members").alias("_p"))
    out = rows.join(moved, F.col(session).eqNullSafe(F.col("_s")) & (F.col(place) == F.col("_p")), "left")
    return out.withColumn("fixed", F.when(F.col("_l").isNotNull(), F.concat("_l", F.lit("/2"))).otherwise(F.col("speaker"))).drop("_s", "_l", "_p")


def revisited(rows: DataFrame, profiles: DataFrame, session: str, place: str, least_similarity: float = 0.02, least_margin: float = 0.0, strong: float = 0.45, confirmation: float = 0.5801, short_ms: int = 0, short_similarity: float = 0.45) -> DataFrame:
    """Unknown rows scored against the profiles that there are now: (session, place, speaker, similarity, margin) of those assigned.

    ``rows``: session, place, source, speech_ms, needs_review, embedding, all unknown; ``profiles``: session, label, centroid.
    A row waiting as a new speaker (source ``new_speaker_pending``) has to be as similar as a confirmed one, a row of less
    than ``short_ms`` at least ``short_similarity``, and with a single profile any row at least ``strong``; rows that need
    review stay unknown. Ties go to the first label; without a second profile the margin is 1.
    """
    open_ = rows.filter(~F.coalesce("needs_review", F.lit(False)))
    pending = F.coalesce(F.col("source") == "new_speaker_pending", F.lit(False))
    least = F.greatest(F.lit(least_similarity), F.when(pending, max(strong, confirmation)), F.when(F.col("speech_ms") < short_ms, F.lit(short_similarity)))
    scored = scores(open_.select(session, place, "embedding", least.alias("_least")), profiles, [session]).filter("similarity IS NOT NULL")
    ranked = scored.groupBy(session, place, "_least").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "label"))), 1, 2).alias("_r"))
    top, second = -F.col("_r")[0]["s"], -F.get(F.col("_r"), F.lit(1))["s"]
    out = ranked.select(session, place, F.col("_r")[0]["label"].alias("speaker"), top.alias("similarity"), F.coalesce(top - second, F.lit(1.0)).alias("margin"), "_least", (F.size("_r") == 1).alias("_single"))
    enough: Column = (F.col("similarity") >= F.col("_least")) & (F.col("margin") >= least_margin) & (~F.col("_single") | (F.col("similarity") >= strong))
    return out.filter(enough).drop("_least", "_single")
