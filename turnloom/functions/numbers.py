"""Scalar arithmetic as column expressions. Nulls give null; divisions are guarded, as ANSI mode is on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantized(x: Column, digits: int = 6) -> Column:
    """x with so many decimals, rounded up at .5 by floor, which all engines do alike."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator isn't positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def f1_score(recall: Column, precision: Column) -> Column:
    return F.when((recall > 0) & (precision > 0), 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))


def latency_score(latency_ms: Column, grace_ms: int = 500, cap_ms: int = 2500) -> Column:
    """1 up to the grace period, then falling to 0 after ``cap_ms`` more."""
    return clamp(1 - F.greatest(F.lit(0), latency_ms - grace_ms) / float(cap_ms))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -60.0, 60.0)))


def duration_quality(duration_ms: Column) -> Column:
    """0.25 to 1, linear from 0.45 s to 2.6 s."""
    return clamp((duration_ms / 1000.0 - 0.45) / 2.15, 0.25, 1.0)


def seconds_to_samples(seconds: Column, rate: int) -> Column:
    """Exact sample count of decimal seconds; an error where it isn't whole."""
    exact = seconds.cast("decimal(18,6)") * F.lit(rate).cast("decimal(9,0)")
    whole = exact.cast("long")
    return F.when(exact == whole, whole).otherwise(F.raise_error(F.concat(seconds.cast("string"), F.lit(" s is not a whole number of samples"))).cast("long"))


def timecode_seconds(value: Column) -> Column:
    """hh:mm:ss, mm:ss or ss as seconds."""
    return F.aggregate(F.split(value, ":"), F.lit(0.0), lambda a, part: a * 60 + part.cast("double"))


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; half seconds round to even."""
    s = F.greatest(F.bround(seconds, 0), F.lit(0)).cast("long")

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    short = F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))).otherwise(short)
