"""The Bayesian filter on streams of probes and published profiles: a session's state lives between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.operators import bayes as B

_COLUMNS = "visible string, candidate string, action string, reason string, profiles int, names array<string>, probabilities array<double>, expired array<string>"


def tracked(probes: DataFrame, events: DataFrame, session: str, at: str, ts: str, late: str = "10 minutes", keep_ms: int = 3_600_000, limits: B.Limits = B.Limits()) -> DataFrame:
    """``operators.bayes.tracked`` on streams with an event time ``ts``; moments grow in a session.

    A row that is before the session's last moment is stale and dropped. The probabilities come as two arrays, by name. A
    session's state goes ``keep_ms`` of event time after its last row.
    """
    out = StructType([probes.schema[session], *StructType.fromDDL(f"{at} long, {_COLUMNS}")])
    flat = B.rows(probes, events, session, at, ts).withColumnRenamed("_session", session)
    values = ["_at", "_event", *(f"_{c}" for c in B.PROBE), *(f"_{c}" for c in B.EVENT)]
    flags = {f"_{c}": F.coalesce(f"_{c}", F.lit(False)) for c in ("due", "release", "speech")}
    flat = flat.withColumns({**flags, "_generation": F.coalesce("_generation", F.lit(0)), "_seconds": F.coalesce("_seconds", F.lit(0.0))})

    def run(key, batches: Iterator[pd.DataFrame], held):
        if held.hasTimedOut:
            held.remove()
            return
        text, last = held.get if held.exists else (None, None)
        state = B.State() if text is None else B.State.load(text)
        pdf = pd.concat(list(batches))
        pdf = pdf.assign(_probe=~pdf["_event"]).sort_values(["_at", "_probe", "_generation", "_speaker"], kind="stable")
        if last is not None:
            pdf = pdf[pdf["_at"] >= last]
        if not len(pdf):
            return
        found = []
        for row in zip(*(pdf[c] for c in values)):
            moved = B.moved(state, *row, limits)
            if moved is not None:
                *plain, posterior, _, _, expired = moved
                names = sorted(posterior)
                found.append((*key, row[0], *plain, names, [posterior[n] for n in names], expired))
        held.update((state.dump(), int(pdf["_at"].iloc[-1])))
        held.setTimeoutTimestamp(max(int(pdf[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(found, columns=out.names)

    return flat.withWatermark(ts, late).groupBy(session).applyInPandasWithState(run, out, StructType.fromDDL("state string, at bigint"), "append", "EventTimeTimeout")
