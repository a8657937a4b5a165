"""Temporary identities on a stream of probes: the voices of a session live between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnloom.operators import tracklets as T

#: Voices are flat: a name and a last moment each, then all short and all long vectors with their lengths (-1: none);
#: the voice that waits for confirmation is the last one, with its count.
_STATE = (
    "names array<string>, lasts array<bigint>, sizes array<int>, numbers array<double>, waiting int, seen array<string>, profiles array<string>, bound array<string>,"
    " visible string, contradicted boolean, created int, generation int, at bigint"
)


def _save(s: T.State, at: int) -> tuple:
    voices = s.voices + ([s.pending] if s.pending else [])
    vectors = [v for voice in voices for v in (voice.short, voice.long)]
    numbers = [float(x) for v in vectors if v is not None for x in v]
    sizes = [-1 if v is None else len(v) for v in vectors]
    return [v.name for v in voices], [v.last for v in voices], sizes, numbers, s.pending_count if s.pending else 0, sorted(s.seen), list(s.names), list(s.names.values()), s.visible, s.contradicted, s.created, s.generation, at


def _load(saved) -> tuple[T.State, int]:
    names, lasts, sizes, numbers, waiting, seen, profiles, bound, visible, contradicted, created, generation, at = saved
    numbers, place, vectors = np.array(numbers, float), 0, []
    for n in sizes:
        vectors.append(None if n < 0 else numbers[place : place + n])
        place += max(n, 0)
    voices = [T.Voice(name, short, long, last) for name, last, short, long in zip(names, lasts, vectors[::2], vectors[1::2])]
    pending = voices.pop() if waiting else None
    return T.State(voices, pending, waiting, set(seen), dict(zip(profiles, bound)), visible, contradicted, created, generation), at


def shown(probes: DataFrame, session: str, at: str, ts: str, late: str = "10 minutes", keep_ms: int = 3_600_000, limits: T.Limits = T.Limits()) -> DataFrame:
    """``operators.tracklets.shown`` on a stream with an event time ``ts``; moments grow in a session.

    A probe that isn't after the session's last one is stale and dropped. A session's state goes ``keep_ms`` of event time
    after its last probe. Aliases come as text: generation, profile, name, retired.
    """
    plain, _, _ = T.COLUMNS.partition(", aliases")
    out = StructType([probes.schema[session], *StructType.fromDDL(f"{at} long, {plain}, aliases array<string>")])

    def run(key, batches: Iterator[pd.DataFrame], held):
        if held.hasTimedOut:
            held.remove()
            return
        state, last = _load(held.get) if held.exists else (T.State(), None)
        pdf = pd.concat(list(batches)).sort_values(at, kind="stable").drop_duplicates(at)
        if last is not None:
            pdf = pdf[pdf[at] > last]
        if not len(pdf):
            return
        found = []
        for now, due, release, speech, short, long, names, vectors, base, action, reason in zip(*(pdf[c] for c in (at, "due", "release", "speech", "short", "long", "_names", "_vectors", "base", "base_action", "base_reason"))):
            profiles = {} if names is None else dict(zip(names, vectors))
            *row, aliases = T.moved(state, now, due, release, speech, short, long, profiles, base, action, reason, limits)
            found.append((*key, now, *row, [f"{a['generation']} {a['profile']} {a['name']} {a['retired']}" for a in aliases]))
        held.update(_save(state, int(pdf[at].iloc[-1])))
        held.setTimeoutTimestamp(max(int(pdf[ts].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(found, columns=out.names)

    flags = (F.coalesce(c, F.lit(False)).alias(c) for c in ("due", "release", "speech"))
    flat = probes.filter(F.col(at).isNotNull()).select(session, F.col(at).cast("long").alias(at), ts, *flags, "short", "long", F.map_keys("profiles").alias("_names"), F.map_values("profiles").alias("_vectors"), "base", "base_action", "base_reason")
    return flat.withWatermark(ts, late).groupBy(session).applyInPandasWithState(run, out, StructType.fromDDL(_STATE), "append", "EventTimeTimeout")
