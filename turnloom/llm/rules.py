"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base rules are fixed. Further rules compare a text statistic, in whole thousandths, with a cutoff per stratum
(a length class, so there are four at most). Cutoffs come from labelled documents: for each rule and stratum the
grid is walked from the loosest cutoff to stricter ones, and a cutoff is accepted while an exact binomial test shows,
at level ``delta`` / (rules x strata), that it rejects less than ``alpha`` / rules of the good documents. The walk
stops at the first cutoff that fails (fixed-sequence testing, so the grid needs no further correction). So, with
probability 1 - delta, in no stratum do the rules together reject more than ``alpha`` of good documents. A rule
without enough labels in a stratum rejects nothing there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.storage import written

WINDOW = 5
ALPHA, DELTA = 0.05, 0.05
#: Upper bounds (exclusive) of the number of words in each stratum but the last.
STRATA = (100, 400, 1600)
#: Statistics in thousandths: name, numerator, denominator.
RULES = (("symbols", "n_symbols", "word_chars"), ("duplicate_lines", "n_dup_lines", "n_lines"), ("repeated_words", "n_repeat_words", "n_words"), ("exclamations", "n_exclaims", "word_chars"), ("word_length", "word_chars", "n_words"))
#: From the loosest to the strictest, in thousandths (word_length: 1000 is one character a word).
GRID = {"word_length": (40000, 30000, 20000, 15000, 12000, 10000, 9000, 8000, 7000, 6000)}
SHARES = (900, 700, 500, 400, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10, 5, 0)
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the counts behind the rules, for each row, and columns to carry as _name; null texts count as empty.

    Repeated windows are found on hashes that carry their position in the low bits, so that one sort of a
    primitive array brings equal ones together; those found are then compared as words.
    """
    f = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
    kept = [f"_{c}" for c in carry]
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    f = f.select("doc_id", *kept, F.length("text").alias("chars"), F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"), F.length(without(F.col("text"), SYMBOLS)).alias("plain"), F.length(without(F.col("text"), "!")).alias("calm"), lines.alias("lines"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    f = f.select("*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    whole = F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))
    f = f.withColumn("grams", F.transform(whole, lambda x, i: F.xxhash64(x, *(F.get(F.col("h"), i + k) for k in range(1, WINDOW)))))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    low = F.ceil(F.log2(F.size("grams") + 1.0)).cast("int")
    f = f.withColumns({"low": low, "some": repeats})

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("low"))

    marked = F.transform("grams", lambda x, i: F.call_function("shiftleft", high(x), F.col("low")).bitwiseOR(i.cast("long")))
    f = f.withColumn("sorted", F.when(F.col("some"), F.sort_array(marked)))
    alike = F.filter("sorted", lambda x, i: (high(x) == high(F.get(F.col("sorted"), i - 1))) | (high(x) == high(F.get(F.col("sorted"), i + 1))))
    position = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("low")) - 1
    at = F.transform(alike, lambda x: x.bitwiseAND(position))
    f = f.withColumn("found", F.sort_array(F.transform(at, lambda p: F.struct(F.array_join(F.slice(F.col("words"), (p + 1).cast("int"), F.lit(WINDOW)), " ").alias("gram"), p.alias("p")))))
    twice = F.filter("found", lambda x, i: (x["gram"] == F.get(F.col("found"), i - 1)["gram"]) | (x["gram"] == F.get(F.col("found"), i + 1)["gram"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return f.select("doc_id", "n_words", "word_chars", (F.col("chars") - F.col("plain")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(F.col("some"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), (F.col("chars") - F.col("calm")).cast("long").alias("n_exclaims"), *kept)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[k], F.lit(k)).otherwise(out)
    return out


def statistic(numerator: str, denominator: str) -> Column:
    """Thousandths, rounded down; 0 where the denominator is."""
    return F.when(F.col(denominator) > 0, F.floor(F.col(numerator) * 1000 / F.col(denominator))).otherwise(F.lit(0)).cast("long")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact but for rounding; 1 where k >= n p, which no test accepts anyway."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("t"), F.exp(n * math.log(1 - p)).alias("sum"))

    def more(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (a["sum"] + F.exp(t)).alias("sum"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.when(k == 0, F.exp(n * math.log(1 - p))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, more, lambda a: a["sum"])))


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest accepted cutoff; no row where none is accepted.

    ``labels`` has doc_id and quality; a document is good if one of its labels is 1. Documents that fail the base
    rules don't count.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = found.filter(~base_failed()).join(good, "doc_id", "left_semi")
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), statistic(a, b).alias("value"), F.array(*map(F.lit, GRID.get(name, SHARES))).alias("grid")) for name, a, b in RULES))
    values = held.select(stratum().alias("stratum"), F.explode(rules).alias("r")).select("stratum", "r.rule", "r.value", F.posexplode("r.grid").alias("step", "cutoff"))
    counts = values.groupBy("stratum", "rule", "step", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("k"))
    level = delta / (len(RULES) * (len(STRATA) + 1))
    tested = counts.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level)
    walk = tested.groupBy("stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(1 << 30)).alias("stop"), F.collect_list(F.struct("step", "cutoff")).alias("steps"))
    accepted = F.filter("steps", lambda s: s["step"] < F.col("stop"))
    return walk.select("stratum", "rule", F.array_max(accepted)["cutoff"].alias("cutoff")).filter("cutoff IS NOT NULL")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base_failed, kept and reasons (names of the rules that reject) for each row of ``docs``.

    Takes doc_id and text, and labels with doc_id and quality; other columns are ignored. A null or empty text has
    no words and fails the base rules. Rows that repeat a doc_id are judged one by one. Without labels only the
    base rules apply. At most rules x strata cutoffs (20) pass through the driver. Columns named in ``carry`` come along as
    _name.
    """
    found = written(features(docs, carry), "features")
    limits: dict[str, dict[int, int]] = {}
    for row in cutoffs(found, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), alpha, delta).collect():
        limits.setdefault(row.rule, {})[row.stratum] = row.cutoff
    reasons = [F.when(base_failed(), F.lit("base"))]
    for name, a, b in RULES:
        over = F.lit(False)
        for k, cutoff in limits.get(name, {}).items():
            over = over | ((stratum() == k) & (statistic(a, b) > cutoff))
        reasons.append(F.when(over, F.lit(name)))
    out = found.withColumn("base_failed", base_failed()).withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("kept", F.size("reasons") == 0)
