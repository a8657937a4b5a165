"""Clean-up of ordered transcript rows: islands, neighbour fills, repeats, running state.

Rows of a session are ordered by ``idx``; every window is partitioned by session. A null speaker is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(key: str):
    return W.partitionBy(key).orderBy("idx")


def runs(df: DataFrame, key: str, label: str = "speaker") -> DataFrame:
    """Adds ``run``: number of the stretch of equal labels (null equals null) within the session."""
    order = _order(key)
    new = F.when((F.row_number().over(order) == 1) | ~F.lag(label).over(order).eqNullSafe(F.col(label)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def run_table(df: DataFrame, key: str, label: str = "speaker", duration: str = "duration_ms") -> DataFrame:
    """One row per run: label, rows, time, first and last idx, labels of the runs before and after."""
    r = runs(df, key, label).groupBy(key, "run").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("rows"), F.sum(duration).alias("total_ms"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    order = W.partitionBy(key).orderBy("run")
    return r.withColumns({"before": F.lag(label).over(order), "after": F.lead(label).over(order)})


def absorb_small_islands(df: DataFrame, key: str, most_ms: int = 5000, most_rows: int = 3, label: str = "speaker") -> DataFrame:
    """A label with a single, short run between two runs of one other label takes that label (``fixed``)."""
    table = run_table(df, key, label)
    lone = F.count(F.lit(1)).over(W.partitionBy(key, label)) == 1
    small = table.filter(f"{label} IS NOT NULL").withColumn("_lone", lone).filter(F.col("_lone") & (F.col("total_ms") <= most_ms) & (F.col("rows") <= most_rows) & (F.col("before") == F.col("after")))
    return runs(df, key, label).join(small.select(key, "run", F.col("before").alias("_to")), [key, "run"], "left").withColumn("fixed", F.coalesce("_to", label)).drop("_to", "run")


def fill_unknown_islands(df: DataFrame, key: str, most_ms: int = 3000, most_rows: int = 1, label: str = "speaker") -> DataFrame:
    """Short unknown runs between runs of one speaker take that speaker (``fixed``)."""
    small = run_table(df, key, label).filter(F.col(label).isNull() & (F.col("rows") <= most_rows) & (F.col("total_ms") <= most_ms) & (F.col("before") == F.col("after")))
    return runs(df, key, label).join(small.select(key, "run", F.col("before").alias("_to")), [key, "run"], "left").withColumn("fixed", F.coalesce(label, "_to")).drop("_to", "run")


def fill_tails(df: DataFrame, key: str, most_ms: int = 750, previous_gap_ms: int = 350, next_gap_ms: int = 300, label: str = "speaker") -> DataFrame:
    """A short unknown row right after a speaker and well before the next row continues that speaker.

    A filled row serves the row after it: rows that qualify take the last known label before their unbroken chain.
    """
    order = _order(key)
    gap = F.col("start_ms") - F.lag("end_ms").over(order)
    ahead = F.lead("start_ms").over(order) - F.col("end_ms")
    able = F.col(label).isNull() & (F.col("end_ms") - F.col("start_ms") <= most_ms) & (gap <= previous_gap_ms) & F.coalesce(ahead >= next_gap_ms, F.lit(True))
    rows = df.withColumn("_able", F.coalesce(able, F.lit(False)))
    # Rows that don't qualify start a new chain with what they have, known or not.
    chain = F.sum(F.when(F.col("_able"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_chain", chain)
    return rows.withColumn("fixed", F.first(label).over(W.partitionBy(key, "_chain").orderBy("idx"))).drop("_able", "_chain")


def fill_heads(df: DataFrame, key: str, most_ms: int = 1750, previous_gap_ms: int = 150, next_gap_ms: int = 50, label: str = "speaker") -> DataFrame:
    """A short unknown row after a pause and right before a speaker begins that speaker."""
    order = _order(key)
    able = F.col(label).isNull() & (F.col("end_ms") - F.col("start_ms") <= most_ms) & (F.col("start_ms") - F.lag("end_ms").over(order) >= previous_gap_ms) & (F.lead("start_ms").over(order) - F.col("end_ms") <= next_gap_ms)
    return df.withColumn("fixed", F.when(able, F.lead(label).over(order)).otherwise(F.col(label)))


def context_anchors(df: DataFrame, key: str, anchor: Column, reach: int = 3, label: str = "speaker") -> DataFrame:
    """Nearest stable labels within ``reach`` rows on either side, and the label if both agree or only one is there."""
    order = _order(key)
    mark = F.when(anchor, F.col(label))
    rows = df.withColumns({"left_anchor": F.last(mark, ignorenulls=True).over(order.rowsBetween(-reach, -1)), "right_anchor": F.first(mark, ignorenulls=True).over(order.rowsBetween(1, reach))})
    agreed = F.when(F.col("left_anchor").eqNullSafe(F.col("right_anchor")), F.col("left_anchor")).when(F.col("left_anchor").isNull(), F.col("right_anchor")).when(F.col("right_anchor").isNull(), F.col("left_anchor"))
    return rows.withColumn("suggested", agreed)


def repeated_rows(df: DataFrame, key: str, text: Column, most_words: int = 8, least_run: int = 3) -> DataFrame:
    """Runs of at least ``least_run`` neighbouring rows with the same short text."""
    rows = df.withColumn("_t", text).withColumn("_n", F.size(F.split("_t", " ")))
    r = runs(rows, key, "_t").filter(F.col("_n") <= most_words)
    out = r.groupBy(key, "run").agg(F.first("_t").alias("phrase"), F.count(F.lit(1)).alias("times"), F.min("idx").alias("first_idx"))
    return out.filter(F.col("times") >= least_run).drop("run")


def ema(df: DataFrame, keys: list[str], value: str, order_by: list[str], count: int = 4, alpha: float = 0.55) -> DataFrame:
    """Exponential mean of the last ``count`` values, newest first, weights renormalised where there are fewer."""
    w = W.partitionBy(*keys).orderBy(*order_by)
    terms = [F.lag(value, k).over(w) * alpha * (1 - alpha) ** k for k in range(count)]
    weights = [F.when(F.lag(value, k).over(w).isNotNull(), alpha * (1 - alpha) ** k).otherwise(0.0) for k in range(count)]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    return df.withColumn("ema", total / sum(weights, F.lit(0.0)))


def flag_spans(frames: DataFrame, keys: list[str], frame: str, flag: str, frame_ms: int, fill: int = 0) -> DataFrame:
    """Runs of true flags as spans; interior false runs of at most ``fill`` frames count as true."""
    w = W.partitionBy(*keys).orderBy(frame)
    true = frames.filter(F.col(flag))
    new = F.when(F.lag(frame).over(w).isNull() | (F.col(frame) - F.lag(frame).over(w) > fill + 1), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = true.withColumn("_new", new).withColumn("_island", island)
    return rows.groupBy(*keys, "_island").agg((F.min(frame) * frame_ms).alias("start_ms"), ((F.max(frame) + 1) * frame_ms).alias("end_ms")).drop("_island")


def padded_spans(spans: DataFrame, keys: list[str], before_ms: int = 200, after_ms: int = 350, gap_ms: int = 850, least_ms: int = 200) -> DataFrame:
    """Spans with padding, merged where close, without short ones."""
    from turnloom.operators.intervals import merge_intervals

    kept = spans.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    wide = kept.withColumns({"start_ms": F.greatest(F.lit(0), F.col("start_ms") - before_ms), "end_ms": F.col("end_ms") + after_ms})
    return merge_intervals(wide, keys, gap_ms=gap_ms)


def review_reasons(df: DataFrame, margin: str = "margin", similarity: str = "top_similarity", duration: str = "duration_ms", duplicate: Column | None = None) -> DataFrame:
    """Suspicion from 0 to 1 and its reasons, in order: low margin, weak evidence, possibly unknown, short, duplicate."""
    rules = [("low_margin", F.col(margin) < 0.06, 0.35), ("weak_evidence", F.col(similarity) < 0.35, 0.3), ("possibly_unknown", F.col(similarity) < 0.2, 0.25), ("short_audio", F.col(duration) < 1200, 0.15)]
    if duplicate is not None:
        rules.append(("duplicate_profile", duplicate, 0.2))
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c, _ in rules)))
    points = sum((F.when(c, F.lit(w)).otherwise(0.0) for _, c, w in rules), F.lit(0.0))
    return df.withColumns({"suspicion": F.least(F.lit(1.0), points), "reasons": reasons})


def word_cut(words: DataFrame, keys: list[str], order_by: str, margin: str, support: str) -> DataFrame:
    """Best place to hand a row over from speaker A to B: the cut with the largest support-weighted evidence for A before and B after.

    ``margin`` is positive for B. Returns cut (words before it), its gain over no cut, and the runner-up's gain.
    """
    gain = -F.col(margin) * F.col(support)
    w = W.partitionBy(*keys).orderBy(order_by)
    rows = words.withColumns({"_left": F.sum(gain).over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(gain).over(W.partitionBy(*keys)), "cut": F.row_number().over(w), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    rows = rows.filter("cut < _n").withColumn("score", 2 * F.col("_left") - F.col("_all")).withColumn("gain", F.col("score") - F.abs("_all"))
    best = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), "cut"))).alias("b"))
    return best.select(*keys, F.col("b")[0]["cut"].alias("cut"), (-F.col("b")[0]["g"]).alias("gain"), (-F.get(F.col("b"), F.lit(1))["g"]).alias("runner_up"))


def zero_crossing(points: DataFrame, keys: list[str], at: str, margin: str) -> DataFrame:
    """First change of the margin from negative to positive, interpolated; a stretch of zeros counts at its middle."""
    w = W.partitionBy(*keys).orderBy(at)
    signed = points.filter(F.col(margin) != 0).withColumns({"_m": F.lag(margin).over(w), "_t": F.lag(at).over(w)})
    cross = signed.filter((F.col("_m") < 0) & (F.col(margin) > 0))
    zeros = points.filter(F.col(margin) == 0).select(*keys, F.col(at).alias("_z"))
    hit = cross.join(zeros, [*(cross[k] == zeros[k] for k in keys), (F.col("_z") > F.col("_t")) & (F.col("_z") < F.col(at))], "left")
    flat = hit.groupBy(*(cross[k] for k in keys), at, "_t", margin, "_m").agg(((F.min("_z") + F.max("_z")) / 2).alias("_middle"))
    point = F.coalesce("_middle", F.col("_t") + (F.col(at) - F.col("_t")) * (-F.col("_m")) / (F.col(margin) - F.col("_m")))
    return flat.withColumn("_p", point).groupBy(*keys).agg(F.min(F.struct(F.col(at).alias("a"), F.col("_p").alias("p"))).alias("b")).select(*keys, F.col("b.p").alias("crossing"))


def promotional_outro(rows: DataFrame, key: str, promotional: Column, last_rows: int = 2, most_ms: int = 12_000, least_ms: int = 5000, label: str = "speaker", duration: str = "duration_ms") -> DataFrame:
    """Promotional rows at the end of a session go to the session's first speaker (``fixed``, ``outro``).

    Such a row is among the last ``last_rows``, has a label of its own that no other row of the session has, and lasts at
    most ``most_ms``; the first speaker, that of the first row with a label, has ``least_ms`` or more in all. A session of
    one row stays as it is; rows of a null session are one session; a null duration counts 0.
    """
    ms = F.greatest(F.coalesce(F.col(duration), F.lit(0)), F.lit(0))
    totals = rows.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(label).alias("_l")).agg(F.sum(ms).alias("_ms"), F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_first"))
    first = totals.groupBy("_k").agg(F.min_by(F.struct(F.col("_l").alias("label"), F.col("_ms").alias("ms")), "_first").alias("_host"))
    own = totals.filter("_n = 1 AND _ms <= " + str(int(most_ms))).join(first.filter(F.col("_host.ms") >= least_ms).withColumnRenamed("_k", "_k2"), F.expr("_k <=> _k2 AND _l <> _host.label"))
    late = rows.select(key, "idx", label, promotional.alias("_p"), F.row_number().over(W.partitionBy(key).orderBy(F.desc("idx"))).alias("_late")).filter(F.col("_late") <= last_rows)
    moved = late.filter("_p").join(own, F.col(key).eqNullSafe(F.col("_k")) & (F.col(label) == F.col("_l"))).select(F.col(key).alias("_key"), F.col("idx").alias("_idx"), F.col("_host.label").alias("_to"))
    out = rows.join(moved, F.col(key).eqNullSafe(F.col("_key")) & (F.col("idx") == F.col("_idx")), "left")
    return out.select(*(rows[c] for c in rows.columns), F.col("_to").isNotNull().alias("outro"), F.coalesce("_to", label).alias("fixed"))
