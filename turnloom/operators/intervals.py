"""Operators over half-open intervals [start, end) in whole milliseconds, one group per key.

Unless said otherwise, rows whose end isn't after their start, or is null, don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.filter(F.col(end) > F.col(start))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", gap_ms: int = 0) -> DataFrame:
    """Coalesced intervals of each key: overlapping, touching or at most ``gap_ms`` apart."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap_ms), 1).otherwise(0)
    islands = valid(df, start, end).withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int | None = None) -> DataFrame:
    """Pairs of intervals that overlap: columns of both (start_ms and end_ms of the right as r_start_ms, r_end_ms) and overlap_ms.

    With ``bucket_ms``, both sides are dealt into time buckets and joined on them too, so that a key with long
    timelines is spread over tasks; each pair appears once, in the bucket in which it starts to overlap.
    """
    a, b = valid(left), valid(right).withColumnsRenamed({"start_ms": "r_start_ms", "end_ms": "r_end_ms"})
    meets = (F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms"))
    low = F.greatest("start_ms", "r_start_ms")
    on = [F.col(f"_a.{k}") == F.col(f"_b.{k}") for k in keys]
    if bucket_ms:
        a, b = (df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor((F.col(e) - 1) / bucket_ms)))) for df, s, e in ((a, "start_ms", "end_ms"), (b, "r_start_ms", "r_end_ms")))
        on.append(F.col("_a._bucket") == F.col("_b._bucket"))
        meets = meets & (F.col("_a._bucket") == F.floor(low / bucket_ms))
    pairs = a.alias("_a").join(b.alias("_b"), [*on, meets])
    kept = [F.col(f"_a.{c}") for c in a.columns if c != "_bucket"] + [F.col(f"_b.{c}") for c in b.columns if c not in keys and c != "_bucket"]
    return pairs.select(*kept, (F.least("end_ms", "r_end_ms") - low).alias("overlap_ms"))


def subtract_intervals(df: DataFrame, blockers: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """What is left of each interval of ``df`` outside the blockers of its key, piece by piece."""
    carry = carry or []
    a = valid(df).select(*keys, *carry, "start_ms", "end_ms")
    b = merge_intervals(blockers, keys).withColumnsRenamed({"start_ms": "b_start", "end_ms": "b_end"})
    rows = a.join(b, [*(a[k] == b[k] for k in keys), F.col("start_ms") < F.col("b_end"), F.col("b_start") < F.col("end_ms")], "left").select(*(a[c] for c in a.columns), "b_start", "b_end")
    cut = rows.groupBy(*keys, *carry, "start_ms", "end_ms").agg(F.array_sort(F.collect_list(F.when(F.col("b_start").isNotNull(), F.struct("b_start", "b_end")))).alias("cuts"))
    starts = F.concat(F.array("start_ms"), F.transform("cuts", lambda x: F.greatest(x["b_end"], F.col("start_ms"))))
    ends = F.concat(F.transform("cuts", lambda x: F.least(x["b_start"], F.col("end_ms"))), F.array("end_ms"))
    pieces = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["e"] > p["s"])
    return cut.withColumn("_p", F.explode(pieces)).select(*keys, *carry, F.col("_p.s").alias("start_ms"), F.col("_p.e").alias("end_ms"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """Each left row with the newest right row of its key whose ``since`` isn't after ``at``; nulls where there is none.

    One shuffle: both sides are laid end to end and the last right row is carried forward. Of right rows with
    equal ``since`` the last by ``tie`` counts; at equal times right rows come first.
    """
    tie = tie or []
    row = F.struct(F.col(since).alias("_since"), *columns)
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_right"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(tie)))
    b = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), row.alias("_right"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)))
    order = W.partitionBy(*keys).orderBy("_t", "_side", *(f"_tie{i}" for i in range(len(tie)))).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(order))
    return both.filter("_side = 1").select("_left.*", F.col("_found._since").alias(since), *(F.col(f"_found.{c}").alias(c) for c in columns))


def speaker_turns(df: DataFrame, key: str = "session_id", gap_ms: int = 500) -> DataFrame:
    """Consecutive intervals of one speaker, at most ``gap_ms`` apart, as turns with joined text."""
    order = W.partitionBy(key).orderBy("start_ms", "end_ms", "idx")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = valid(df).withColumns({"_reach": F.max("end_ms").over(before), "_prev": F.lag("speaker").over(order)})
    new = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("speaker")) | (F.col("start_ms") > F.col("_reach") + gap_ms), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("turn", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(key, "turn").agg(F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("segments"), F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "idx", "text"))).alias("_t"))
    return out.withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), " ")).drop("_t")


def newly_covered(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The part of each interval that no earlier one of its key reached, where there is any."""
    reach = F.max("end_ms").over(W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1))
    rows = valid(df).withColumn("start_ms", F.greatest(F.col("start_ms"), F.coalesce(reach, F.col("start_ms"))))
    return valid(rows)


def held_slices(ticks: DataFrame, keys: list[str], at: str, hold: str, order_by: list[str], clear: str | None = None) -> DataFrame:
    """From ticks to visible slices: a tick shows until its hold ends, the next tick comes, or the next row clears.

    ``clear`` names a boolean column of rows that only clear.
    """
    following = F.lead(at).over(W.partitionBy(*keys).orderBy(*order_by))
    end = F.least(F.col(at) + F.col(hold), F.coalesce(following, F.col(at) + F.col(hold)))
    rows = ticks.withColumns({"start_ms": F.col(at), "end_ms": end})
    return valid(rows.filter(~F.col(clear)) if clear else rows)


def state_slices(samples: DataFrame, key: str, at: str, state: str, max_gap_ms: int = 500) -> DataFrame:
    """Sample and hold up to ``max_gap_ms``; equal neighbours without a pause are one slice. A null state is a state."""
    order = W.partitionBy(key).orderBy(at, "sample")
    rows = samples.withColumns({"start_ms": F.col(at), "end_ms": F.least(F.lead(at).over(order), F.col(at) + max_gap_ms)})
    rows = valid(rows.withColumn("end_ms", F.coalesce("end_ms", F.col(at) + max_gap_ms)))
    by = W.partitionBy(key).orderBy("start_ms", "sample")
    new = F.when(F.lag("end_ms").over(by).isNull() | (F.col("start_ms") > F.lag("end_ms").over(by) + 1) | ~F.lag(state).over(by).eqNullSafe(F.col(state)), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("slice", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "slice").agg(F.first(state).alias(state), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def gaps_between(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Positive pauses between an interval and the furthest end before it."""
    reach = F.max("end_ms").over(W.partitionBy(*keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1))
    rows = valid(df).withColumn("gap_start_ms", reach).filter(F.col("start_ms") > F.col("gap_start_ms"))
    return rows.select(*keys, "gap_start_ms", F.col("start_ms").alias("gap_end_ms"), (F.col("start_ms") - F.col("gap_start_ms")).alias("gap_ms"))


def gap_groups(df: DataFrame, keys: list[str], thresholds_ms: list[int]) -> DataFrame:
    """For each threshold: groups of intervals with no longer pause inside, how many mix speakers, and their lengths."""
    rows = valid(df).withColumn("threshold_ms", F.explode(F.array(*map(F.lit, thresholds_ms))))
    order = W.partitionBy(*keys, "threshold_ms").orderBy("start_ms", "end_ms", "idx")
    reach = F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start_ms") - reach > F.col("threshold_ms")), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    groups = rows.groupBy(*keys, "threshold_ms", "_group").agg(F.count_distinct("speaker").alias("speakers"), (F.max("end_ms") - F.min("start_ms")).alias("length_ms"))
    mixed = F.col("speakers") > 1
    return groups.groupBy("threshold_ms").agg(F.count(F.lit(1)).alias("groups"), F.count_if(mixed).alias("mixed_groups"), F.coalesce(F.sum(F.when(mixed, F.col("length_ms"))), F.lit(0)).alias("mixed_ms"), F.max("length_ms").alias("longest_ms"))


def atomic_slices(df: DataFrame, key: str) -> DataFrame:
    """Slices between all neighbouring boundaries; in each the speaker with most intervals, then the latest end, or nobody on a tie."""
    cuts = valid(df).select(key, F.explode(F.array("start_ms", "end_ms")).alias("s")).distinct()
    slices = cuts.withColumn("e", F.lead("s").over(W.partitionBy(key).orderBy("s"))).filter("e IS NOT NULL")
    held = slices.join(valid(df), [slices[key] == df[key], F.col("start_ms") <= F.col("s"), F.col("end_ms") >= F.col("e")]).groupBy(slices[key], "s", "e", "speaker").agg(F.count(F.lit(1)).alias("votes"), F.max("end_ms").alias("latest"))
    rank = W.partitionBy(key, "s", "e")
    best = held.withColumns({"place": F.rank().over(rank.orderBy(F.desc("votes"), F.desc("latest")))}).filter("place = 1")
    return best.groupBy(key, "s", "e").agg(F.count(F.lit(1)).alias("n"), F.first("speaker").alias("speaker")).filter("n = 1").select(key, F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "speaker")


def consensus_spans(primary: DataFrame, secondary: DataFrame, key: str, least_ms: int = 120, least_percent: int = 5) -> DataFrame:
    """Primary spans that secondary ones confirm, and the secondary spans that touch a confirmed one.

    A span is confirmed by an overlap of at least its own length, or else the larger of ``least_ms`` and so many
    per cent of it.
    """
    both = merge_intervals(secondary, [key])
    seen = overlap_join(primary, both, [key]).groupBy(key, "start_ms", "end_ms").agg(F.sum("overlap_ms").alias("seen"))
    length = F.col("end_ms") - F.col("start_ms")
    sure = seen.filter(F.col("seen") * 100 >= F.least(length * 100, F.greatest(F.lit(least_ms * 100), length * least_percent))).select(key, "start_ms", "end_ms")
    sure = sure.distinct()
    s, p = both.alias("s"), sure.alias("p")
    touching = s.join(p, (F.col(f"s.{key}") == F.col(f"p.{key}")) & (F.col("s.start_ms") <= F.col("p.end_ms")) & (F.col("p.start_ms") <= F.col("s.end_ms")), "left_semi")
    return sure.withColumn("detector", F.lit("primary")).unionByName(touching.select(key, "start_ms", "end_ms").withColumn("detector", F.lit("secondary")))


def hop_windows(lengths: DataFrame, key: str, length: str, hop: int, window: int) -> DataFrame:
    """Full causal windows [edge - window, edge) on a grid of right edges that are multiples of ``hop``."""
    first = -(-window // hop) * hop
    edges = F.when(F.col(length) >= first, F.sequence(F.lit(first).cast("long"), F.col(length).cast("long"), F.lit(hop).cast("long")))
    return lengths.withColumn("edge", F.explode(edges)).select(key, (F.col("edge") - window).alias("start_ms"), F.col("edge").alias("end_ms"))


def window_count(length: Column, hop: int, window: int) -> Column:
    """How many windows ``hop_windows`` gives."""
    first = -(-window // hop) * hop
    return F.when(length >= first, F.floor((length - first) / hop) + 1).otherwise(F.lit(0)).cast("long")
