"""Change logs of live rows, leases and speech sessions: expressions that batch and stream share.

What a revised row means depends on the row before it under the same key. Batch plans get that row by ``lag``; the
streaming counterparts keep it as state. Both then apply the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEARTBEAT_S, COMPLETED_S, IDLE_S, RUN_S = 45, 10, 120, 900


def with_previous(rows: DataFrame, keys: list[str], order_by: list[str], columns: list[str]) -> DataFrame:
    """Adds previous_<column> and ``seen``: whether the key had a row before."""
    w = W.partitionBy(*keys).orderBy(*order_by)
    return rows.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns} | {"seen": F.row_number().over(w) > 1})


def sentence_events() -> Column:
    """Public events of a revision: pending; final with its speaker or none; speaker revised, assigned or cleared; updated.

    Reads pending, speaker, revision, seen, previous_pending and previous_speaker.
    """
    final_before = F.col("seen") & ~F.coalesce("previous_pending", F.lit(False))
    first = F.array(F.lit("final"), F.when(F.col("speaker").isNull(), "final_unknown").otherwise("speaker_assigned"))
    change = F.when(F.col("speaker").isNull(), F.array(F.lit("speaker_revised"), F.lit("speaker_cleared"))).when(F.col("previous_speaker").isNull(), F.array(F.lit("speaker_revised"), F.lit("speaker_assigned"))).otherwise(F.array(F.lit("speaker_revised")))
    return (
        F.when(F.col("pending"), F.array(F.lit("pending")))
        .when(~final_before, first)
        .when(~F.col("speaker").eqNullSafe(F.col("previous_speaker")), change)
        .when(F.col("revision") > 0, F.array(F.lit("updated")))
        .otherwise(F.array().cast("array<string>"))
    )


def speaker_event() -> Column:
    """changed where the live speaker differs from the one before (none at first), else updated."""
    return F.when(F.col("speaker").eqNullSafe(F.col("previous_speaker")), "updated").otherwise("changed")


def lease_end(now: Column, heartbeat_s: int = HEARTBEAT_S, completed_s: int = COMPLETED_S, idle_s: int = IDLE_S, run_s: int = RUN_S) -> Column:
    """Why a lease (created_s, last_seen_s, run_started_s, completed_s) has ended by ``now``; null while it holds."""
    return (
        F.when(now - F.col("last_seen_s") > heartbeat_s, "heartbeat timeout")
        .when(now - F.col("completed_s") > completed_s, "completed")
        .when(F.col("run_started_s").isNull() & (now - F.col("created_s") > idle_s), "idle timeout")
        .when(now - F.col("run_started_s") > run_s, "time limit")
    )


def speech_sessions(rows: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Rows of a key with no silence longer than ``gap`` between them, as sessions; the same plan in batch and stream.

    Start and end are aggregates: a filter on the session window's own fields would be pushed below the merging of
    its rows, and so cut sessions short.
    """
    s = rows.groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.min(ts).alias("start"), (F.max(ts) + F.expr(f"INTERVAL {gap}")).alias("end"), F.count(F.lit(1)).alias("rows"))
    return s.drop("s")
