"""Structured Streaming counterparts of ``turnloom.operators.live``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from turnloom.operators import live


def with_previous(rows: DataFrame, keys: list[str], order_by: str, columns: list[str], ts: str, late: str = "10 minutes", keep_ms: int = 120_000) -> DataFrame:
    """``live.with_previous`` on a stream: the last row of each key is its state.

    Rows of a micro-batch are taken by ``order_by``; one that isn't after the key's last row is stale and dropped.
    State of a key goes ``keep_ms`` of event time after its last row, once the watermark has passed.
    """
    fields = {f.name: f for f in rows.schema}
    out = StructType([*rows.schema, *(StructField(f"previous_{c}", fields[c].dataType) for c in columns), StructField("seen", BooleanType())])
    state_type = StructType([StructField("place", fields[order_by].dataType), *(StructField(c, fields[c].dataType) for c in columns)])

    def step(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        for pdf in [pd.concat(list(batches)).sort_values(order_by, kind="stable")]:
            if last is not None:
                pdf = pdf[pdf[order_by] > last[0]]
            pdf = pdf.drop_duplicates(order_by)
            if not len(pdf):
                continue
            new = pdf.copy()
            for k, c in enumerate(columns):
                before = [None if last is None else last[k + 1], *pdf[c].tolist()[:-1]]
                new[f"previous_{c}"] = pd.Series(before, index=pdf.index, dtype=object)
            new["seen"] = [last is not None] + [True] * (len(pdf) - 1)
            end = pdf.iloc[-1]
            last = tuple(None if pd.isna(end[c]) else getattr(end[c], "item", lambda v=end[c]: v)() for c in (order_by, *columns))
            state.update(last)
            state.setTimeoutTimestamp(max(int(pdf[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
            yield new

    marked = rows.withWatermark(ts, late)
    return marked.groupBy(*keys).applyInPandasWithState(step, out, state_type, "append", "EventTimeTimeout")


def sentence_events(rows: DataFrame, keys: list[str], order_by: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Revisions with their public events; see ``live.sentence_events``."""
    return with_previous(rows, keys, order_by, ["pending", "speaker"], ts, late).withColumn("events", live.sentence_events())


def speech_sessions(rows: DataFrame, keys: list[str], ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions are emitted when the watermark has passed their end."""
    return live.speech_sessions(rows.withWatermark(ts, late), keys, ts, gap)


def tick_windows(rows: DataFrame, keys: list[str], ts: str, length_ms: int = 700, hop_ms: int = 400, late: str = "10 minutes") -> DataFrame:
    """Rows in sliding windows that share right edges at multiples of ``hop_ms``."""
    shift = -length_ms % hop_ms
    w = F.window(ts, f"{length_ms} milliseconds", f"{hop_ms} milliseconds", f"{shift} milliseconds")
    counts = rows.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")
