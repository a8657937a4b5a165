"""Committed sentences on a stream of windows: what a session keeps lives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.operators import sentences as S

_STATE = "left_ms bigint, last_right bigint, ended boolean, count int, seen_ms bigint, flushed boolean"


def stable(windows: DataFrame, session: str, ts: str, late: str = "10 minutes", keep_ms: int = 3_600_000, limits: S.Limits = S.Limits()) -> DataFrame:
    """``operators.sentences.stable`` on a stream of windows with an event time ``ts``.

    A window that isn't after the session's last one (a flush is after another window of the same moment) is stale and
    dropped. A session's state goes ``keep_ms`` of event time after its last window.
    """
    out = StructType([windows.schema[session], *StructType.fromDDL(S.COLUMNS)])

    def run(key, batches: Iterator[pd.DataFrame], held):
        if held.hasTimedOut:
            held.remove()
            return
        *saved, seen, flushed = held.get if held.exists else (*vars(S.State()).values(), -1, True)
        state, found, newest = S.State(*saved), [], 0
        pdf = pd.concat(list(batches)).sort_values(["right_ms", "flush"], kind="stable")
        for at, right, flush, texts, starts, ends in zip(*(pdf[c] for c in (ts, "right_ms", "flush", "_texts", "_starts", "_ends"))):
            if (right, flush) <= (seen, flushed):
                continue
            seen, flushed, newest = int(right), bool(flush), max(newest, int(at.timestamp() * 1000))
            words = [{"text": t, "start_ms": int(a), "end_ms": int(b)} for t, a, b in zip(texts, starts, ends)]
            found += [(*key, *row) for row in S.moved(state, seen, flushed, words, limits)]
        if not newest:
            return
        held.update((*vars(state).values(), seen, flushed))
        held.setTimeoutTimestamp(max(newest, held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(found, columns=out.names).astype({"next_word_ms": "Int64"})

    usable = F.filter(F.coalesce("words", F.array().cast(windows.schema["words"].dataType)), lambda w: w["text"].isNotNull() & w["start_ms"].isNotNull() & w["end_ms"].isNotNull())
    flat = windows.filter("right_ms IS NOT NULL").select(session, ts, F.col("right_ms").cast("long").alias("right_ms"), F.coalesce("flush", F.lit(False)).alias("flush"), usable.alias("_w"))
    flat = flat.select(session, ts, "right_ms", "flush", F.col("_w.text").alias("_texts"), F.col("_w.start_ms").alias("_starts"), F.col("_w.end_ms").alias("_ends"))
    return flat.withWatermark(ts, late).groupBy(session).applyInPandasWithState(run, out, StructType.fromDDL(_STATE), "append", "EventTimeTimeout")
