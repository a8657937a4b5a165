"""Evaluation: parameter grids, gates of one variant against another, checks of recorded runs, costs and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Room for rounding in comparisons with a tolerance.
SLACK = 1e-12


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """One row for each combination of parameter values; a grid is written by hand, so it is small."""
    out = spark.range(1).drop("id")
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return out


def neighbours(configs: DataFrame, steps: dict[str, float]) -> DataFrame:
    """Configurations that differ from one of ``configs`` in one parameter by one step either way, each once."""
    moved = [F.struct(*((F.col(c) + sign * step if c == name else F.col(c)).alias(c) for c in steps)) for name, step in steps.items() for sign in (-1, 1)]
    return configs.select(F.explode(F.array(*moved)).alias("c")).select("c.*").distinct()


def tried(rows: DataFrame, configs: DataFrame, group: list[str], parameters: list[str], shown: Column, right: Column) -> DataFrame:
    """Score of every configuration in every group: rows shown rightly less those shown wrongly, over all rows.

    The grid is sent to all tasks; the rows are read once and summed before they move.
    """
    pairs = rows.crossJoin(F.broadcast(configs))
    sums = pairs.groupBy(*group, *parameters).agg(F.sum(F.when(shown, F.when(right, 1).otherwise(-1)).otherwise(0)).alias("net"), F.count(F.lit(1)).alias("rows"))
    return sums.withColumn("score", F.col("net") / F.col("rows"))


def cohort_gates(baseline: DataFrame, candidates: DataFrame, key: str, variant: str, score_tolerance: float = 0.005, wrong_tolerance: float = 0.005) -> DataFrame:
    """For each candidate: does it hold the mean score, every group's score and every group's wrong ratio, over one cohort?"""
    b = baseline.select(F.col(key).alias("_k"), F.col("score").alias("_score"), F.col("wrong").alias("_wrong"))
    size = baseline.agg(F.count(F.lit(1)).alias("_size"))
    met = candidates.join(b, F.col(key) == F.col("_k"), "left")
    per = met.groupBy(variant).agg(
        (F.avg("score") - F.avg("_score")).alias("score_delta"), F.min(F.col("score") - F.col("_score")).alias("worst_delta"), F.max(F.col("wrong") - F.col("_wrong")).alias("wrong_delta"),
        F.count("_k").alias("_both"), F.count(F.lit(1)).alias("_all"),
    )
    per = per.crossJoin(F.broadcast(size)).withColumn("same_cohort", (F.col("_both") == F.col("_all")) & (F.col("_all") == F.col("_size")))
    gates = {"mean_gate": F.col("score_delta") >= -score_tolerance - SLACK, "score_gate": F.col("worst_delta") >= -score_tolerance - SLACK, "wrong_gate": F.col("wrong_delta") <= wrong_tolerance + SLACK}
    out = per.withColumns(gates)
    return out.withColumn("passed", F.expr("same_cohort AND mean_gate AND score_gate AND wrong_gate")).drop("_both", "_all", "_size")


def paired(a: DataFrame, b: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Wins, losses and ties of a over b, and the mean difference."""
    d = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key).withColumn("_d", F.round(F.col("_a") - F.col("_b"), 9))
    return d.agg(F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") < 0).alias("losses"), F.count_if(F.col("_d") == 0).alias("ties"), F.avg("_d").alias("mean_difference"))


def trace_parity(left: DataFrame, right: DataFrame, key: str, order_by: list[str], fields: list[str]) -> DataFrame:
    """Two traces compared step by step: steps of each, steps compared, mismatches, share of matches, whether exact."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.row_number().over(W.partitionBy(key).orderBy(*order_by)).alias("_n"), F.struct(*fields).alias(name))

    both = numbered(left, "_l").join(numbered(right, "_r"), [key, "_n"], "full")
    same, here, there = F.col("_l").eqNullSafe(F.col("_r")), F.col("_l").isNotNull(), F.col("_r").isNotNull()
    out = both.groupBy(key).agg(F.count_if(here).alias("left_steps"), F.count_if(there).alias("right_steps"), F.count_if(here & there).alias("compared"), F.count_if(~same).alias("mismatches"), F.count_if(here & there & same).alias("_same"), F.min(F.when(~same, F.col("_n"))).alias("first_mismatch"))
    ratio = F.when(F.col("compared") > 0, F.col("_same") / F.col("compared")).otherwise(0.0)
    return out.withColumn("match_ratio", ratio).withColumn("exact", F.col("mismatches") == 0).drop("_same")


def tape_checks(rows: DataFrame, key: str, sequence: str, clock: str, index: str, size: int) -> DataFrame:
    """Per recording: sequence 1..n without gaps, a clock that never goes back, indexes inside the array."""
    w = W.partitionBy(key).orderBy(sequence)
    marked = rows.withColumns({"_n": F.row_number().over(w), "_before": F.lag(clock).over(w)})
    return marked.groupBy(key).agg(F.bool_and(F.col(sequence) == F.col("_n")).alias("sequence_ok"), F.bool_and(F.col("_before").isNull() | (F.col(clock) >= F.col("_before"))).alias("clock_ok"), F.bool_and((F.col(index) >= 0) & (F.col(index) < size)).alias("index_ok"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, rows): how many rows break each check; a null counts as broken. One pass over the rows."""
    counts = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks))).alias("c")).select("c.*")


def run_groups(runs: DataFrame, group: str, artifact: str, least: int) -> DataFrame:
    """Groups with at least so many runs that are all bound to one artifact."""
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(artifact).alias("artifacts")).filter((F.col("runs") >= least) & (F.col("artifacts") == 1))


def changed_inputs(old: DataFrame, new: DataFrame, key: list[str], group: str, digest: str) -> DataFrame:
    """Per group: inputs that changed, went or came since they were frozen, and whether none did."""
    b = new.select(*key, F.col(digest).alias("_d"))
    both = old.select(*key, digest).join(b, key, "full")
    counts = both.groupBy(group).agg(F.count_if(F.col(digest) != F.col("_d")).alias("changed"), F.count_if(F.col("_d").isNull()).alias("gone"), F.count_if(F.col(digest).isNull()).alias("new"))
    return counts.withColumn("unchanged", F.expr("changed + gone + new = 0"))


def slowest(rates: DataFrame, group: list[str], order: str, jobs: int, count: int) -> DataFrame:
    """The ``count`` providers of each group that would take longest for so many jobs."""
    cost = F.col("load_s") + jobs / F.col("per_s")
    return rates.withColumn("cost_s", cost).withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("cost_s"), order))).filter(F.col("_n") <= count).drop("_n")


def forecast(rates: DataFrame, group: list[str], jobs: int, safety: float = 1.5, planning_h: float = 18.0, hard_h: float = 24.0) -> DataFrame:
    """Seconds that a group's providers need one after another, with a safety factor, against two limits."""
    raw = F.sum(F.col("load_s") + jobs / F.col("per_s"))
    out = rates.groupBy(*group).agg(F.count(F.lit(1)).alias("providers"), raw.alias("raw_s")).withColumn("planned_s", F.col("raw_s") * safety)
    status = F.when(F.col("planned_s") > hard_h * 3600, "hard_limit_exceeded").when(F.col("planned_s") > planning_h * 3600, "planning_limit_exceeded").otherwise("within_planning_limit")
    return out.withColumn("status", status)


def threshold_scan(rows: DataFrame, value: Column, wrong: Column, low: bool = True, least: int = 3, keep: int = 12) -> DataFrame:
    """Thresholds of a feature that select most wrong and fewest right rows: cumulative sums over rounded values.

    Rows are counted by value (three decimals) first, so what is sorted is as long as there are values.
    """
    counts = rows.filter(value.isNotNull()).groupBy(F.round(value.cast("double"), 3).alias("threshold")).agg(F.count_if(wrong).alias("_w"), F.count_if(~wrong).alias("_r"))
    upto = W.orderBy(F.col("threshold") if low else F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = counts.select("threshold", F.sum("_w").over(upto).alias("wrong"), F.sum("_r").over(upto).alias("correct"), F.sum("_w").over(total).alias("_all"))
    out = s.withColumns({"selected": F.col("wrong") + F.col("correct"), "net": F.col("wrong") - F.col("correct")}).filter(F.col("selected") >= least)
    out = out.withColumns({"precision_wrong": F.col("wrong") / F.greatest("selected", F.lit(1)), "wrong_recall": F.col("wrong") / F.greatest("_all", F.lit(1))})
    return out.orderBy(F.desc("net"), F.desc("precision_wrong"), "threshold").limit(keep).drop("_all")


def runs_of(rows: DataFrame, key: str, order_by: list[str], flag: Column, clock: str) -> DataFrame:
    """Neighbouring rows with a flag as runs: rows, first and last clock."""
    w = W.partitionBy(key).orderBy(*order_by)
    marked = rows.withColumn("_f", flag).withColumn("_new", (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("int"))
    numbered = marked.withColumn("run", F.sum("_new").over(w)).filter("_f")
    return numbered.groupBy(key, "run").agg(F.count(F.lit(1)).alias("rows"), F.min(clock).alias("first_ms"), F.max(clock).alias("last_ms"))


def nearest_percentiles(rows: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """Values at rank round((n - 1) f), half to even, of each group, without gathering it."""
    w = W.partitionBy(key)
    marked = rows.withColumns({"_n": F.row_number().over(w.orderBy(value)) - 1, "_c": F.count(F.lit(1)).over(w)})
    return marked.groupBy(key).agg(*(F.max(F.when(F.col("_n") == F.bround((F.col("_c") - 1) * f), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions))


def evidence_score(words: DataFrame, key: list[str]) -> DataFrame:
    """Weighted geometric mean of speech, sequence and word evidence; null where one of them is missing."""
    low = 1e-4

    def unit(x: Column) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(1.0), x))

    sums = words.groupBy(*key).agg(F.max("no_speech").alias("n"), F.min("logprob").alias("l"), F.avg(F.ln(unit(F.col("probability")))).alias("w"))
    parts = ((0.35, unit(1 - F.col("n"))), (0.35, unit(F.exp("l"))), (0.30, F.greatest(F.lit(low), F.exp("w"))))
    return sums.select(*key, F.exp(sum((k * F.ln(x) for k, x in parts), F.lit(0.0))).alias("evidence"))


def sentence_groups(words: DataFrame, key: str, order_by: list[str], text: str, segment: str) -> DataFrame:
    """Words numbered by sentence: a new one after closing punctuation and where the segment changes."""
    w = W.partitionBy(key).orderBy(*order_by)
    before = F.lag(F.struct(text, segment)).over(w)
    ended = F.trim(before[text]).rlike("[.!?][\"'\\])]*\\s*$")
    moved = before[segment].isNotNull() & F.col(segment).isNotNull() & (before[segment] != F.col(segment))
    return words.withColumn("_b", F.coalesce((ended | moved).cast("int"), F.lit(0))).withColumn("sentence", F.sum("_b").over(w)).drop("_b")


def segment_groups(words: DataFrame, key: str, order_by: list[str], segment: str) -> DataFrame:
    """Neighbouring words of one segment are a group; a word without a segment is its own."""
    w = W.partitionBy(key).orderBy(*order_by)
    first = F.row_number().over(w) == 1
    same = F.col(segment).isNotNull() & F.col(segment).eqNullSafe(F.lag(segment).over(w))
    return words.withColumn("_b", F.when(first | same, 0).otherwise(1)).withColumn("part", F.sum("_b").over(w)).drop("_b")


def speech_state(spans: DataFrame, key: str, left: int, right: int, least_ms: int = 180, silence_ms: int = 600) -> DataFrame:
    """Speech inside a window: first start, last end, sum, silence after it and whether that is enough to flush."""
    cut = spans.withColumns({"start_ms": F.greatest("start_ms", F.lit(left)), "end_ms": F.least("end_ms", F.lit(right))}).filter("end_ms > start_ms")
    sums = cut.groupBy(key).agg(F.min("start_ms").alias("speech_start"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("speech_end"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return sums.filter(F.col("speech_ms") >= least_ms).withColumn("silence_ms", F.greatest(F.lit(0), right - F.col("speech_end"))).withColumn("flush", F.col("silence_ms") >= silence_ms)


def bounded_ema(rows: DataFrame, key: str, order_by: list[str], clock: str, value: str, within: int, count: int = 3, alpha: float = 0.55) -> DataFrame:
    """Exponential mean that starts at the oldest of the last ``count`` values not older than ``within``."""
    w = W.partitionBy(key).orderBy(*order_by)
    recent = [F.when(F.col(clock) - F.lag(clock, k).over(w) <= within, F.lag(value, k).over(w)) for k in range(count)]
    ema = None
    for k in reversed(range(count)):
        ema = recent[k] if ema is None else F.when(ema.isNull(), recent[k]).otherwise(alpha * recent[k] + (1 - alpha) * ema)
    return rows.withColumn("ema", ema)


def section_gaps(rows: DataFrame, key: str, place: str, speaker: str, least_ms: int = 60_000) -> DataFrame:
    """Rows whose speaker was last heard ``least_ms`` or longer before they start."""
    heard = F.max("end_ms").over(W.partitionBy(key, speaker).orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("silent_ms", F.col("start_ms") - heard).filter(F.col("silent_ms") >= least_ms)


def first_parity(rows: DataFrame, group: str, order_by: str, vector: str, cosine) -> DataFrame:
    """Smallest cosine of a group's vectors to its first one."""
    first = rows.groupBy(group).agg(F.min_by(vector, order_by).alias("_f"))
    return rows.join(first, group).groupBy(group).agg(F.min(cosine(F.col(vector), F.col("_f"))).alias("parity"), F.count(F.lit(1)).alias("rows"))


def frame_speech(samples: Column, frame: int, threshold: float) -> Column:
    """Flags of frames whose root mean square reaches the threshold; a tail shorter than half a frame is left out."""
    n = F.size(samples)
    frames = F.floor((n + frame - F.ceil(F.lit(frame) / 2)) / frame)
    starts = F.when(frames > 0, F.transform(F.sequence(F.lit(0).cast("long"), frames - 1), lambda k: k * frame + 1)).otherwise(F.array().cast("array<bigint>"))

    def rms(at: Column) -> Column:
        part = F.slice(samples, at.cast("int"), frame)
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x) / F.size(part))

    return F.transform(starts, lambda at: rms(at) >= threshold)


def newest(rows: DataFrame, key: str, order_by: list[str], count: int) -> DataFrame:
    """The last ``count`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order_by)))).filter(F.col("_n") <= count).drop("_n")


def probe_score(card: DataFrame, latencies: DataFrame, key: str, most_penalty: float = 0.15) -> DataFrame:
    """0.35 F1 + 0.25 each of the latency scores + 0.15 share right where shown on speech, less the wrong share.

    The latency scores are means over all turns and over turns that change the speaker (1 where none does).
    """
    means = latencies.groupBy(key).agg(F.avg("score").alias("first_score"), F.coalesce(F.avg(F.when(F.col("changed"), F.col("score"))), F.lit(1.0)).alias("change_score"))
    rows = card.join(means, key, "left").na.fill(0.0, ["first_score", "change_score"])
    spoken = F.col("correct_ms") + F.col("wrong_ms")
    right = F.when(spoken > 0, F.col("correct_ms") / spoken).otherwise(0.0)
    wrong = F.least(F.lit(most_penalty), F.when(F.col("truth_ms") > 0, F.col("wrong_ms") / F.col("truth_ms")).otherwise(0.0))
    return rows.withColumn("probe_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * F.col("f1") + 0.25 * F.col("first_score") + 0.25 * F.col("change_score") + 0.15 * right - wrong)))
