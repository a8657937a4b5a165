"""Live ticks on a stream: the state of a session lives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.operators import ticks as T

#: The probabilities kept are flat: how many entries each map has, then all names and all values.
_STATE = "visible string, pending string, waited int, unknowns int, silences int, sizes array<int>, names array<string>, shares array<double>, place bigint"


def _load(saved) -> tuple[T.State, int]:
    *plain, sizes, names, shares, place = saved
    entries = iter(zip(names, shares))
    return T.State(*plain, [dict(next(entries) for _ in range(n)) for n in sizes]), place


def _save(s: T.State, place: int) -> tuple:
    names, shares = [k for m in s.history for k in m], [float(p) for m in s.history for p in m.values()]
    return s.visible, s.pending, s.waited, s.unknowns, s.silences, [len(m) for m in s.history], names, shares, place


def shown(ticks: DataFrame, session: str, place: str, ts: str, late: str = "10 minutes", keep_ms: int = 3_600_000, limits: T.Limits = T.Limits()) -> DataFrame:
    """``operators.ticks.shown`` on a stream, for a whole-number ``place`` that grows in a session.

    A tick that isn't after the session's last is stale and dropped. A session's state goes ``keep_ms`` of event time
    after its last tick.
    """
    out = StructType([*ticks.select(session, place).schema, *StructType.fromDDL(T.COLUMNS)])

    def run(key, batches: Iterator[pd.DataFrame], held):
        if held.hasTimedOut:
            held.remove()
            return
        state, last = _load(held.get) if held.exists else (T.State(), None)
        pdf = pd.concat(list(batches)).sort_values(place, kind="stable").drop_duplicates(place)
        if last is not None:
            pdf = pdf[pdf[place] > last]
        if not len(pdf):
            return
        found = [
            T.moved(state, due, release, speech, None if names is None else dict(zip(names, shares)), fallback, limits)
            for due, release, speech, names, shares, fallback in zip(*(pdf[c] for c in ("due", "release", "speech", "_names", "_shares", "fallback")))
        ]
        held.update(_save(state, int(pdf[place].iloc[-1])))
        held.setTimeoutTimestamp(max(int(pdf[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.concat([pdf[[session, place]].reset_index(drop=True), pd.DataFrame(found, columns=out.names[2:])], axis=1)

    flags = (F.coalesce(c, F.lit(False)).alias(c) for c in ("due", "release", "speech"))
    flat = ticks.select(session, place, ts, *flags, "fallback", F.map_keys("probabilities").alias("_names"), F.map_values("probabilities").alias("_shares"))
    return flat.withWatermark(ts, late).groupBy(session).applyInPandasWithState(run, out, StructType.fromDDL(_STATE), "append", "EventTimeTimeout")
