"""Speaker memory on a stream: the state of a session lives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from turnloom.operators import memory as M

_STATE = "size int, centroids array<double>, counts array<bigint>, seconds array<double>, speakers int, place bigint"


def _load(saved) -> tuple[M.State, int]:
    size, flat, counts, seconds, n, place = saved
    c = np.array(flat, float).reshape(-1, size)
    return M.State(M.Groups(c[:n], list(counts[:n]), list(seconds[:n])), M.Groups(c[n:], list(counts[n:]), list(seconds[n:]))), place


def _save(state: M.State, place: int) -> tuple:
    both = np.vstack([state.speakers.centroids, state.waiting.centroids])
    return both.shape[1], both.reshape(-1).tolist(), state.speakers.counts + state.waiting.counts, state.speakers.seconds + state.waiting.seconds, len(state.speakers.counts), place


def assigned(rows: DataFrame, session: str, place: str, vector: str, seconds: str, ts: str, late: str = "10 minutes", keep_ms: int = 3_600_000, limits: M.Limits = M.Limits()) -> DataFrame:
    """``operators.memory.assigned`` on a stream, for a whole-number ``place`` that grows in a session.

    A row that isn't after the session's last is stale and dropped. A session's state goes ``keep_ms`` of event time
    after its last row.
    """
    out = StructType([*rows.select(session, place).schema, *StructType.fromDDL(M.COLUMNS)])

    def run(key, batches: Iterator[pd.DataFrame], held):
        if held.hasTimedOut:
            held.remove()
            return
        state, last = _load(held.get) if held.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values(place, kind="stable").drop_duplicates(place)
        if last is not None:
            pdf = pdf[pdf[place] > last]
        if not len(pdf):
            return
        found = []
        for v, s in zip(pdf[vector], pdf[seconds]):
            if v is None:
                found.append(M.row_of(M.Decision()))
                continue
            state = state or M.State.empty(len(v))
            found.append(M.row_of(M.step(state, np.array(v, float), float(s), limits)))
        if state is not None:
            held.update(_save(state, int(pdf[place].iloc[-1])))
            held.setTimeoutTimestamp(max(int(pdf[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.concat([pdf[[session, place]].reset_index(drop=True), pd.DataFrame(found, columns=out.names[2:])], axis=1)

    return rows.withWatermark(ts, late).groupBy(session).applyInPandasWithState(run, out, StructType.fromDDL(_STATE), "append", "EventTimeTimeout")
