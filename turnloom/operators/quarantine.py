"""A guard around the Bayesian filter: change signals add up, and a speaker they speak against is hidden for a while.

Each probe compares its vectors with the profiles, normalised by what the profiles share and by how each of them used to
score. Decaying sums of those signals raise an alert; a change of speaker that comes with one is quarantined until the new
speaker is confirmed. The two folds that this rests on, weighted moments and decaying sums, are operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnloom.operators import bayes as B
from turnloom.operators.tracklets import unit


@dataclass
class Moments:
    """Exponentially weighted mean and variance."""

    count: int = 0
    mean: float = 0.0
    variance: float = 0.0

    def update(self, value: float, alpha: float) -> None:
        if self.count == 0:
            self.mean = value
        else:
            delta = value - self.mean
            self.mean += alpha * delta
            self.variance = (1.0 - alpha) * (self.variance + alpha * delta * delta)
        self.count += 1


def decayed(total: float, observation: float, decay: float, drift: float) -> float:
    """A sum of observations above ``drift`` that fades and never falls below 0."""
    return max(0.0, decay * total + observation - drift)


@dataclass(frozen=True)
class Gate:
    """Fixed values."""

    short_weight: float = 0.80
    long_weight: float = 0.20
    single_anchor: float = 0.02
    cohort_weight: float = 1.0
    accept: float = -0.10
    scale: float = 0.075
    min_fused: float = 0.05
    min_short: float = -0.10
    min_long: float = -0.10
    min_margin: float = -0.20
    adaptive_samples: int = 4
    adaptive_sigma: float = 2.25
    adaptive_std: float = 0.035
    adaptive_weight: float = 0.20
    learn_margin: float = 0.04
    learn_alpha: float = 0.16
    decay: float = 0.86
    drift: float = 0.12
    temporal_floor: float = 0.35
    temporal_gain: float = 1.0
    drop_gain: float = 0.75
    challenger_gain: float = 0.80
    alert: float = 0.90
    switch: float = 1.40
    least_profiles: int = 2
    only_changes: bool = True  # an alert quarantines only where another speaker is proposed
    after_switch: bool = False
    least_probes: int = 1
    exit_count: int = 1
    exit_margin: float = 0.025
    strong_exit: float = 1.20
    grace_ms: int = 1200


@dataclass
class Evidence:
    fused: float
    normalized: float
    llr: float
    margin: float
    ok: bool


@dataclass
class State:
    base: B.State = field(default_factory=B.State)
    visible: str | None = None
    unknown_sum: float = 0.0
    challenger: tuple[str, float] | None = None
    quarantine: bool = False
    probes: int = 0
    leaving: str | None = None
    left: int = 0
    first_seen: dict[str, int] = field(default_factory=dict)
    centroids: dict[str, np.ndarray] = field(default_factory=dict)
    moments: dict[str, Moments] = field(default_factory=dict)
    stable: np.ndarray | None = None

    def release(self) -> None:
        self.quarantine, self.probes, self.leaving, self.left = False, 0, None, 0

    def settle(self, label: str) -> None:
        self.visible, self.unknown_sum, self.challenger = label, 0.0, None


def evidence(state: State, profiles: dict[str, np.ndarray], short: np.ndarray, long: np.ndarray, gate: Gate) -> dict[str, Evidence]:
    """What a probe says for each profile."""
    scores = {k: (float(short @ c), float(long @ c)) for k, c in profiles.items()}
    fused = {k: (gate.short_weight * s + gate.long_weight * l) / (gate.short_weight + gate.long_weight) for k, (s, l) in scores.items()}
    ranked = sorted(fused.items(), key=lambda kv: (-kv[1], kv[0]))
    out = {}
    for k, c in profiles.items():
        shared = max((float(c @ o) for j, o in profiles.items() if j != k), default=gate.single_anchor)
        anchor = gate.cohort_weight * shared + (1.0 - gate.cohort_weight) * gate.single_anchor
        normalized = (fused[k] - anchor) / max(0.10, 1.0 - anchor)
        llr = (normalized - gate.accept) / gate.scale
        m = state.moments.get(k)
        if m is not None and m.count >= gate.adaptive_samples:
            std = max(gate.adaptive_std, m.variance**0.5)
            llr += gate.adaptive_weight * (fused[k] - (m.mean - gate.adaptive_sigma * std)) / std
        margin = fused[k] - (ranked[0][1] if k != ranked[0][0] else ranked[1][1] if len(ranked) > 1 else -1.0)
        ok = fused[k] >= gate.min_fused and scores[k][0] >= gate.min_short and scores[k][1] >= gate.min_long and normalized >= gate.accept and margin >= gate.min_margin
        out[k] = Evidence(fused[k], normalized, llr, margin, ok)
    return out


def _sums(state: State, found: dict[str, Evidence], short: np.ndarray, gate: Gate) -> float:
    """The sum that speaks for the likeliest other speaker, 0 where it is who is shown; both sums move."""
    if not found:
        state.unknown_sum = decayed(state.unknown_sum, 1.0, gate.decay, gate.drift)
        return 0.0
    top = max(found, key=lambda k: (found[k].fused, k))
    shown = found.get(state.visible or "")
    alike = float(short @ state.stable) if state.stable is not None and state.stable.shape == short.shape else 1.0
    change = max(0.0, gate.temporal_floor - alike) / max(0.05, 1.0 - gate.temporal_floor)
    drop = max(0.0, -(shown or found[top]).llr)
    state.unknown_sum = decayed(state.unknown_sum, max(0.0, -found[top].llr) + gate.drop_gain * drop + gate.temporal_gain * change, gate.decay, gate.drift)
    if state.visible and top != state.visible:
        before = state.challenger[1] if state.challenger and state.challenger[0] == top else 0.0
        value = decayed(before, gate.challenger_gain * max(0.0, found[top].llr - (shown.llr if shown else -2.0)), gate.decay, gate.drift)
        state.challenger = (top, value)
        return value
    if state.challenger:
        value = decayed(state.challenger[1], 0.0, gate.decay, gate.drift)
        state.challenger = (state.challenger[0], value) if state.challenger[1] > 0 else None
    return 0.0


def _leaves(state: State, proposed: str | None, at: int, fresh: set[str], found: dict[str, Evidence], gate: Gate) -> bool:
    """Is the proposed speaker confirmed, so that the quarantine ends?"""
    state.probes += 1
    item = found.get(proposed or "")
    ok = item is not None and item.ok and item.normalized >= gate.accept + gate.exit_margin
    state.left = (state.left + 1 if proposed == state.leaving else 1) if ok else 0
    state.leaving = proposed if ok else None
    new = ok and proposed in fresh and at - state.first_seen[proposed] <= gate.grace_ms
    return state.probes >= gate.least_probes and (state.left >= gate.exit_count or new or (item is not None and item.llr >= gate.strong_exit and state.left >= 1))


def _profiles(state: State, at: int) -> tuple[dict[str, np.ndarray], set[str]]:
    """The base filter's profiles and those that are new; a renewed one loses its moments."""
    now, fresh = {k: p.centroid for k, p in state.base.profiles.items()}, set()
    for k, c in now.items():
        if k not in state.centroids:
            fresh.add(k)
            state.first_seen[k] = at
        elif not np.array_equal(state.centroids[k], c):
            state.moments.pop(k, None)
        state.centroids[k] = c
    return now, fresh


def step(state: State, probe: B.Probe, limits: B.Limits, gate: Gate) -> tuple[str, str]:
    """(action, reason) of a probe, and the state moved by it; the base filter moves too."""
    profiles, fresh = _profiles(state, probe.at)
    B.step(state.base, probe, limits)
    proposed, before = state.base.visible, state.visible

    def action() -> str:
        if not state.visible:
            return "clear" if before else "none"
        return "acquire" if not before else "hold" if before == state.visible else "switch"

    if not (probe.due and probe.speech and not probe.release and probe.vectors):
        if proposed is None and before is not None:
            state.visible, state.quarantine, state.leaving, state.left = None, False, None, 0
        elif proposed is not None and before is None and not state.quarantine:
            state.visible = proposed
        return action(), "non_probe"
    short, long = probe.vectors[0], probe.vectors[-1]
    found = evidence(state, profiles, short, long, gate) if profiles else {}
    challenge = _sums(state, found, short, gate)
    fits = proposed in found and found[proposed].ok
    if proposed is None:
        state.visible = None
        state.release()
    change = state.visible is not None and proposed is not None and proposed != state.visible
    alarmed = max(state.unknown_sum, challenge) >= gate.alert and (change or not gate.only_changes)
    if proposed is not None and state.visible is not None and len(profiles) >= gate.least_profiles and (alarmed or (gate.after_switch and change and fits)):
        state.visible, state.quarantine, state.probes, state.leaving, state.left = None, True, 0, None, 0
    if state.quarantine:
        if _leaves(state, proposed, probe.at, fresh, found, gate):
            state.settle(proposed)
            state.quarantine, state.leaving, state.left = False, None, 0
    elif state.visible is None and fits:
        state.visible = proposed
    elif change and fits and state.challenger and state.challenger[0] == proposed and challenge >= gate.switch:
        state.settle(proposed)
    item = found.get(state.visible or "")
    if item is not None and item.ok and item.margin >= gate.learn_margin:
        state.moments.setdefault(state.visible, Moments()).update(item.fused, gate.learn_alpha)
        state.stable = short
    return action(), "quarantine" if state.quarantine else "normalized"


COLUMNS = "visible string, proposed string, action string, reason string, quarantine boolean, unknown_sum double, challenger string, challenger_sum double"


def moved(state: State, at, event, *values, limits: B.Limits, gate: Gate) -> tuple | None:
    """COLUMNS of a probe, or None for the publication of a profile."""
    due, release, speech, short, long, *profile = values
    if event:
        B.moved(state.base, at, True, *[None] * 5, *profile, limits)
        return None
    short, long = unit(short), unit(long)
    vectors = () if short is None else (short,) if long is None or long.shape != short.shape else (short, long)
    done = step(state, B.Probe(int(at), bool(due), bool(release), bool(speech), vectors), limits, gate)
    return state.visible, state.base.visible, *done, state.quarantine, state.unknown_sum, *(state.challenger or (None, 0.0))


def _folded(rows: DataFrame, keys: list[str], out: StructType, new: Callable, move: Callable) -> DataFrame:
    """Rows sorted by session (first column) read as a stream, each moved through its session's state by one task."""
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            found = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key,):
                    now, state = (key,), new()
                row = move(state, *values)
                if row is not None:
                    found.append((key, *row))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    # By a hash of the session, as in bayes.tracked: it may be a union of tables that are dealt by session.
    return rows.repartition(F.xxhash64(rows.columns[0])).sortWithinPartitions(*keys).mapInArrow(run, out)


def quarantined(probes: DataFrame, events: DataFrame, session: str, at: str, limits: B.Limits = B.Limits(), gate: Gate = Gate()) -> DataFrame:
    """(session, at, COLUMNS) for each probe; inputs, order and nulls as for ``bayes.tracked``."""
    out = StructType([probes.schema[session], *StructType.fromDDL(f"{at} long, {COLUMNS}")])

    def move(state: State, when, *values):
        row = moved(state, when, *values, limits=limits, gate=gate)
        return row and (when, *row)

    keys = ["_session", "_at", F.desc("_event"), "_generation", "_speaker", "_due", "_release", "_speech", "_short", "_long"]
    return _folded(B.rows(probes, events, session, at), keys, out, State, move)


def running_moments(rows: DataFrame, session: str, order: list[str], value: str, alpha: float = 0.16) -> DataFrame:
    """(session, order, count, mean, variance): exponentially weighted moments of the values up to each row.

    Null values are skipped: their rows have the moments so far. Rows of a null session are one session.
    """
    out = StructType([*rows.select(session, *order).schema, *StructType.fromDDL("count long, mean double, variance double")])

    def move(m: Moments, *values):
        *place, x = values
        if x is not None:
            m.update(x, alpha)
        return *place, m.count, m.mean, m.variance

    return _folded(rows.select(session, *order, F.col(value).cast("double").alias("_value")), [session, *order], out, Moments, move)


def running_sums(rows: DataFrame, session: str, order: list[str], signal: str, decay: float = 0.86, drift: float = 0.12, alert: float = 0.90) -> DataFrame:
    """(session, order, total, alert): the decaying sum of a signal above its drift, and whether it has reached ``alert``.

    A null signal is 0. Rows of a null session are one session.
    """
    out = StructType([*rows.select(session, *order).schema, *StructType.fromDDL("total double, alert boolean")])

    def move(total: list[float], *values):
        *place, x = values
        total[0] = decayed(total[0], x or 0.0, decay, drift)
        return *place, total[0], total[0] >= alert

    return _folded(rows.select(session, *order, F.col(signal).cast("double").alias("_value")), [session, *order], out, lambda: [0.0], move)
