"""Live ticks: who is shown, moved by one tick after the other in media time.

A tick carries what the probe saw: whether a probe was due, whether the release gate fired, whether there was speech,
and the probabilities of the speakers and of 'unknown' (null where there is no vector or no profile yet). The state
of a session is a few counters and the last ``Limits.smoothing`` probabilities, so ``shown`` runs over sorted rows as
a stream and ``turnloom.streaming.ticks`` keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Limits:
    """Least probability, smoothing, and how many ticks in a row each change takes."""

    least_known: float = 0.50
    smoothing: int = 3
    alpha: float = 0.55
    acquire: int = 1
    switch: int = 1
    unknown_release: int = 2
    silence_release: int = 1


@dataclass
class State:
    visible: str | None = None
    pending: str | None = None
    waited: int = 0
    unknowns: int = 0
    silences: int = 0
    history: list[dict[str, float]] = field(default_factory=list)

    def forget_pending(self) -> None:
        self.pending, self.waited = None, 0


@dataclass
class Tick:
    due: bool = True
    release: bool = False
    speech: bool = True
    probabilities: dict[str, float] | None = None
    fallback: str | None = None


def smoothed(history: list[dict[str, float]], alpha: float) -> dict[str, float]:
    """Exponential mean of the maps, oldest first, with a sum of 1; a key that a map lacks counts 0 there.

    The total is added up key by key: ``sum`` corrects its rounding from Python 3.12 on, which other engines don't.
    """
    mean, total = {}, 0.0
    for key in sorted(set().union(*history)):
        first, *later = (max(0.0, m.get(key, 0.0)) for m in history)
        for p in later:
            first = alpha * p + (1.0 - alpha) * first
        mean[key] = first
        total += first
    return {k: p / total for k, p in mean.items()} if total > 0 else mean


def best_known(probabilities: dict[str, float], least: float) -> tuple[str | None, float | None]:
    """The likeliest speaker (of equals the first by name) and its probability; no speaker where 'unknown' is as likely."""
    known = sorted((-p, k) for k, p in probabilities.items() if k != UNKNOWN)
    if not known:
        return None, None
    p, k = -known[0][0], known[0][1]
    return (k if p > probabilities.get(UNKNOWN, 0.0) and p >= least else None), p


def _held(state: State, shown: str, hidden: str) -> tuple[str, str]:
    return ("hold", shown) if state.visible else ("none", hidden)


def _left(state: State, enough: bool, reason: str, waiting: str) -> tuple[str, str]:
    """Clear what is shown once ``enough`` ticks asked for it."""
    if not (state.visible and enough):
        return _held(state, waiting, reason)
    state.visible = None
    state.history.clear()
    return "clear", reason


def _moved(state: State, candidate: str, limits: Limits) -> tuple[str, str]:
    if candidate == state.visible:
        state.forget_pending()
        return "hold", "confirmed"
    state.waited = state.waited + 1 if candidate == state.pending else 1
    state.pending = candidate
    if state.waited < (limits.switch if state.visible else limits.acquire):
        return _held(state, "candidate_debounce", "candidate_debounce")
    action = "switch" if state.visible else "acquire"
    state.visible = candidate
    state.forget_pending()
    state.history.clear()
    return action, "known_candidate"


def step(state: State, tick: Tick, limits: Limits) -> tuple[str | None, float | None, str, str]:
    """(candidate, its smoothed probability, action, reason), and the state moved by the tick."""
    if not tick.due and not tick.release:
        return None, None, *_held(state, "non_probe_tick", "non_probe_tick")
    if tick.release:
        state.silences, state.unknowns = state.silences + 1, 0
        state.forget_pending()
        if tick.due:
            state.history.clear()
        return None, None, *_left(state, state.silences >= limits.silence_release, "release_gate", "release_debounce")
    state.silences = 0
    if not tick.speech:
        state.unknowns = 0
        state.forget_pending()
        return None, None, *_held(state, "probe_gate_silence", "probe_gate_silence")
    candidate = p = None
    if tick.probabilities is not None:
        state.history = [*state.history, tick.probabilities][-limits.smoothing :]
        best, p = best_known(smoothed(state.history, limits.alpha), limits.least_known)
        candidate = best or tick.fallback
        if candidate is not None:
            state.unknowns = 0
            return candidate, p, *_moved(state, candidate, limits)
        state.forget_pending()
    state.unknowns += 1
    return None, p, *_left(state, state.unknowns >= limits.unknown_release, "unknown", "unknown_debounce")


COLUMNS = "visible string, candidate string, known double, action string, reason string"
INPUTS = ("due", "release", "speech", "probabilities", "fallback")


def moved(state: State, due, release, speech, probabilities, fallback, limits: Limits) -> tuple:
    """Values of COLUMNS for one tick; a null flag is false."""
    candidate, p, action, reason = step(state, Tick(bool(due), bool(release), bool(speech), None if probabilities is None else dict(probabilities), fallback), limits)
    return state.visible, candidate, p, action, reason


def shown(ticks: DataFrame, session: str, order_by: list[str], limits: Limits = Limits()) -> DataFrame:
    """(session, order_by, COLUMNS) for each tick; ``ticks`` has the columns INPUTS, and order_by orders a session's.

    Rows of a null session are one session. A session is read as a stream by one task, which holds one batch and the
    state of one session.
    """
    keys = [session, *order_by]
    out = StructType([*ticks.select(*keys).schema, *StructType.fromDDL(COLUMNS)])
    schema = to_arrow_schema(out)
    names = [f"_{c}" for c in INPUTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), State()
        for batch in batches:
            found = []
            for key, *values in zip(*(batch.column(c).to_pylist() for c in (session, *names))):
                if now != (key,):
                    now, state = (key,), State()
                found.append(moved(state, *values, limits))
            new = [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 5, schema.types[len(keys) :])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(schema.field(k).type) for k in keys), *new], schema=schema)

    body = ticks.select(*keys, *(F.col(c).alias(f"_{c}") for c in INPUTS))
    return body.repartition(session).sortWithinPartitions(*keys).mapInArrow(run, out)
