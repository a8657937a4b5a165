"""Who speaks at each probe, as a Bayesian filter over the profiles known so far and 'unknown'.

A probe brings a short and a long vector. Their similarities with each profile are fused, turned into evidence for each
state, and combined with what the filter expected. Profiles are published and renewed over time, and a voice that no
profile explains may become a provisional one that expires when it is not heard. The state of a session is a few numbers
and its profiles, so ``tracked`` runs over sorted rows as a stream and ``turnloom.streaming.bayes`` keeps the same state
between micro-batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnloom.operators.tracklets import unit

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Limits:
    """Fixed values; options that are None or 0 are off."""

    short_weight: float = 1.0
    long_weight: float = 1.0
    confidence_power: float = 0.0  # the window that tells profiles apart counts more
    confidence_floor: float = 0.02
    min_similarity: float = 0.25
    min_margin: float = 0.0
    temperature: float = 0.075
    unknown_bias: float = 0.0
    few_profiles: int = 0  # up to so many profiles few_bias holds, above many_bias, instead of unknown_bias
    few_bias: float = 0.0
    many_bias: float = 0.0
    bias_slope: float = 0.0
    history: int = 1  # centroids kept of a profile, and weight of the best of them
    history_weight: float = 0.0
    maturity: float = 0.0
    maturity_seconds: float = 1.0
    cohort_mean: float = 0.0
    cohort_max: float = 0.0
    stay: float = 0.80
    prior: float = 1.0
    evidence: float = 1.0
    min_known: float = 0.45
    switch_margin: float = 0.0
    unknown_release: int = 2
    silence_release: int = 2
    hold_agreement: float = -1.0  # of both windows, for what is shown to be seen again
    continuity: float | None = None  # similarity with the last vectors of who is shown that holds it
    continuity_history: int = 3
    crossover_margin: float | None = None  # lead in the short window that counts before the long one follows
    crossover_similarity: float | None = None
    crossover_count: int = 1
    provisional: bool = False
    creation_count: int = 2
    ceiling: float = 0.20
    agreement: float = -1.0
    consistency: float = -1.0
    merge: float = 0.25
    update_alpha: float = 0.0
    reactivation: float | None = None
    expiry_ms: int = 0


@dataclass
class Profile:
    centroid: np.ndarray
    generation: int = 0
    history: list[np.ndarray] = field(default_factory=list)
    seconds: float = 0.0
    provisional: bool = False
    seen: int = -1


@dataclass
class State:
    profiles: dict[str, Profile] = field(default_factory=dict)
    posterior: dict[str, float] = field(default_factory=lambda: {UNKNOWN: 1.0})
    visible: str | None = None
    unknowns: int = 0
    silences: int = 0
    aliases: dict[str, str] = field(default_factory=dict)
    created: int = 0
    pending: list[np.ndarray] = field(default_factory=list)
    heard: dict[str, list[np.ndarray]] = field(default_factory=dict)  # last short vectors of who was shown
    leader: str | None = None
    led: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self), default=lambda v: v.tolist())

    @staticmethod
    def load(text: str) -> State:
        s = State(**json.loads(text))
        rows = lambda vs: [np.array(v) for v in vs]
        s.profiles = {k: Profile(**{**p, "centroid": np.array(p["centroid"]), "history": rows(p["history"])}) for k, p in s.profiles.items()}
        s.pending, s.heard = rows(s.pending), {k: rows(v) for k, v in s.heard.items()}
        return s


@dataclass
class Probe:
    at: int
    due: bool = True
    release: bool = False
    speech: bool = True
    vectors: tuple[np.ndarray, ...] = ()  # directions, short then long; one where only one is known
    short_ms: int = 700


def softmax(logits: dict[str, float]) -> dict[str, float]:
    most = max(logits.values())
    masses = {k: math.exp(max(-60.0, v - most)) for k, v in logits.items()}
    total = sum(masses.values())
    return {k: v / total for k, v in masses.items()}


def _spread(state: State, only: str | None = None) -> None:
    """The posterior over the states that there are now, none below a small floor; with ``only`` it is sure of one."""
    masses = {k: max(1e-9, state.posterior.get(k, 0.0)) if only is None else 1.0 if k == only else 1e-9 for k in (UNKNOWN, *sorted(state.profiles))}
    total = sum(masses.values())
    state.posterior = {k: v / total for k, v in masses.items()}


def publish(state: State, speaker: str, generation: int, centroid: np.ndarray, seconds: float, limits: Limits) -> str | None:
    """Take over a profile that is published or renewed: the label it goes by, or None where a newer one is known.

    The first time, the most similar provisional profile becomes it, if it is similar enough.
    """
    label = state.aliases.get(speaker, speaker)
    if label == speaker and limits.provisional:
        near = max(((float(centroid @ p.centroid), k) for k, p in state.profiles.items() if p.provisional), default=None)
        if near and near[0] >= limits.merge:
            label = state.aliases[speaker] = near[1]
    old = state.profiles.get(label)
    if old is not None and generation < old.generation:
        return None
    history = [*(old.history if old else ()), centroid][-limits.history :]
    state.profiles[label] = Profile(centroid, generation, history, max(0.0, seconds), False, old.seen if old else -1)
    _spread(state)
    return label


def _expired(state: State, at: int, limits: Limits) -> list[str]:
    gone = sorted(k for k, p in state.profiles.items() if limits.expiry_ms and p.provisional and p.seen >= 0 and at - p.seen >= limits.expiry_ms)
    for k in gone:
        del state.profiles[k]
        state.heard.pop(k, None)
        if state.visible == k:
            state.visible = None
    if gone:
        _spread(state)
    return gone


def similarity(vector: np.ndarray, profile: Profile, limits: Limits) -> float:
    """With the centroid, and by ``history_weight`` with the most similar of the kept ones."""
    best = max(float(vector @ h) for h in profile.history or [profile.centroid])
    return (1.0 - limits.history_weight) * float(vector @ profile.centroid) + limits.history_weight * best


def fused(state: State, vectors: tuple[np.ndarray, ...], limits: Limits) -> dict[str, float]:
    """Similarity of each profile over both windows, less what it shares with the other profiles."""
    scores = [{k: similarity(v, p, limits) for k, p in state.profiles.items()} for v in vectors]
    weights = [limits.short_weight, limits.long_weight][: len(vectors)]
    if limits.confidence_power > 0:
        lead = lambda s: (s[0] - s[1]) if len(s) > 1 else max(0.0, s[0] - limits.min_similarity)
        weights = [max(0.0, w) * (limits.confidence_floor + max(0.0, lead(sorted(s.values(), reverse=True)))) ** limits.confidence_power for w, s in zip(weights, scores)]
    total = sum(weights)
    weights = [w / total for w in weights] if total > 0 else [1.0 / len(vectors)] * len(vectors)
    out = {k: sum(w * s[k] for w, s in zip(weights, scores)) for k in state.profiles}
    if (limits.cohort_mean or limits.cohort_max) and len(out) > 1:
        for k, p in state.profiles.items():
            others = [float(p.centroid @ q.centroid) for j, q in state.profiles.items() if j != k]
            out[k] -= limits.cohort_mean * sum(others) / len(others) + limits.cohort_max * max(others)
    return out


def observed(state: State, similarities: dict[str, float], limits: Limits) -> dict[str, float]:
    """Evidence of a probe for each state; the posterior of ``state`` moves by it."""
    n = len(state.profiles)
    bias = limits.unknown_bias if not limits.few_profiles else limits.few_bias if n <= limits.few_profiles else limits.many_bias
    logits = {k: (s - limits.min_similarity) / limits.temperature for k, s in similarities.items()}
    if limits.maturity:
        age = {k: math.log(limits.maturity_seconds + p.seconds) for k, p in state.profiles.items()}
        logits = {k: v + limits.maturity * (age[k] - max(age.values())) for k, v in logits.items()}
    logits[UNKNOWN] = (limits.min_similarity - max(similarities.values())) / limits.temperature + bias + limits.bias_slope * math.log(n)
    raw = softmax(logits)
    states = (UNKNOWN, *sorted(state.profiles))
    before = {k: max(0.0, state.posterior.get(k, 0.0)) for k in states}
    total = sum(before.values())
    before = {k: v / total if total > 0 else 1.0 / len(states) for k, v in before.items()}
    expected = {k: limits.stay * v + (1.0 - limits.stay) * (1.0 - v) / n for k, v in before.items()}
    state.posterior = softmax({k: limits.evidence * math.log(max(1e-12, raw[k])) + limits.prior * math.log(max(1e-12, expected[k])) for k in states})
    return raw


def _ranked(scores: dict[str, float]) -> list[tuple[str, float]]:
    return sorted(((k, v) for k, v in scores.items() if k != UNKNOWN), key=lambda kv: (-kv[1], kv[0]))


def _likeliest(state: State, probe: Probe, similarities: dict[str, float], limits: Limits) -> str | None:
    """The most probable profile, where it is probable, similar and ahead enough."""
    (top, p), *others = _ranked(state.posterior)
    best = sorted(similarities.values(), reverse=True)
    ahead = best[0] - best[1] if len(best) > 1 else 1.0
    agreement = float(probe.vectors[0] @ probe.vectors[1]) if len(probe.vectors) == 2 else 1.0
    enough = p >= limits.min_known and p >= state.posterior[UNKNOWN] and p - (others[0][1] if others else 0.0) >= limits.switch_margin
    enough = enough and similarities[top] >= limits.min_similarity and ahead >= limits.min_margin
    return top if enough and (top != state.visible or agreement >= limits.hold_agreement) else None


def _crossing(state: State, probe: Probe, limits: Limits) -> str | None:
    """Another profile that leads in the short window while the long one still hears who is shown, often enough in a row."""
    if limits.crossover_margin is None or state.visible is None or len(probe.vectors) != 2:
        state.leader, state.led = None, 0
        return None
    short, long = (_ranked({k: similarity(v, p, limits) for k, p in state.profiles.items()}) for v in probe.vectors)
    floor = limits.min_similarity if limits.crossover_similarity is None else limits.crossover_similarity
    leader, s = short[0]
    if leader == state.visible or s < floor or s - (short[1][1] if len(short) > 1 else -1.0) < limits.crossover_margin or long[0][0] != state.visible:
        state.leader, state.led = None, 0
        return None
    state.led = state.led + 1 if state.leader == leader else 1
    state.leader = leader
    return leader if state.led >= limits.crossover_count else None


def _created(state: State, probe: Probe, similarities: dict[str, float], limits: Limits) -> str | None:
    """A provisional profile for a voice that was heard often enough and is unlike all others, or one that it belongs to."""
    short, known = probe.vectors[0] if probe.vectors else None, max(similarities.values(), default=-1.0)
    if not limits.provisional or short is None or known >= limits.ceiling or (len(probe.vectors) == 2 and float(short @ probe.vectors[1]) < limits.agreement):
        state.pending = []
        return None
    if state.pending and float(short @ _mean(state.pending)) < limits.consistency:
        state.pending = []
    state.pending = [*state.pending, short][-limits.creation_count :]
    if len(state.pending) < limits.creation_count:
        return None
    centroid, state.pending = _mean(state.pending), []
    near = max(((float(centroid @ p.centroid), k) for k, p in state.profiles.items() if p.provisional), default=None)
    if limits.reactivation is not None and near and near[0] >= limits.reactivation:
        label = near[1]
        state.profiles[label].seen = probe.at
    else:
        state.created += 1
        label = f"provisional_{state.created}"
        state.profiles[label] = Profile(centroid, 0, [centroid], probe.short_ms / 1000.0, True, probe.at)
    _spread(state, label)
    return label


def _mean(vectors: list[np.ndarray]) -> np.ndarray:
    mean = unit(np.mean(vectors, axis=0))
    return vectors[-1] if mean is None else mean


def _remember(state: State, label: str, probe: Probe, limits: Limits) -> None:
    if probe.vectors:
        state.heard[label] = [*state.heard.get(label, ()), probe.vectors[0]][-limits.continuity_history :]


def _adapted(state: State, label: str, probe: Probe, limits: Limits) -> None:
    """A provisional profile that was heard stays alive and moves a little."""
    p = state.profiles[label]
    if not p.provisional:
        return
    p.seen = probe.at
    if limits.update_alpha > 0:
        moved = unit((1.0 - limits.update_alpha) * p.centroid + limits.update_alpha * probe.vectors[0])
        p.centroid = p.centroid if moved is None else moved
        p.history = [*p.history, p.centroid][-limits.history :]
        p.seconds += probe.short_ms / 1000.0


def _held(state: State, shown: str, hidden: str) -> tuple[str, str]:
    return ("hold", shown) if state.visible else ("none", hidden)


def _cleared(state: State, enough: bool, reason: str, waiting: str, forget: bool = True) -> tuple[str, str]:
    if not (state.visible and enough):
        return _held(state, waiting, reason)
    state.visible = None
    if forget:
        state.posterior = {UNKNOWN: 1.0}
    return "clear", reason


def _acquired(state: State, label: str, probe: Probe, reason: str, limits: Limits) -> tuple[str, str]:
    before, state.visible, state.unknowns = state.visible, label, 0
    _remember(state, label, probe, limits)
    return "acquire" if before is None else "hold" if before == label else "switch", reason


def step(state: State, probe: Probe, limits: Limits) -> tuple:
    """(candidate, action, reason, raw, similarities, expired) of a probe, and the state moved by it."""
    expired = _expired(state, probe.at, limits)
    raw, similarities = {UNKNOWN: 1.0}, {}
    if not probe.due or probe.release or not probe.speech or len(probe.vectors) != 2:
        state.leader, state.led = None, 0
    if not probe.due or probe.release or not probe.speech:
        state.pending = []
        if probe.release:
            state.silences, state.unknowns = state.silences + 1, 0
            return None, *_cleared(state, state.silences >= limits.silence_release, "release_gate", "release_debounce"), raw, similarities, expired
        if not probe.due:
            return None, *_held(state, "non_probe_tick", "non_probe_tick"), raw, similarities, expired
        state.silences = state.unknowns = 0
        return None, *_held(state, "probe_gate_silence", "probe_gate_silence"), raw, similarities, expired
    state.silences = 0
    if not probe.vectors or not state.profiles:
        state.unknowns += 1
        label = _created(state, probe, similarities, limits)
        if label is not None:
            return label, *_acquired(state, label, probe, "provisional_acquire", limits), raw, similarities, expired
        return None, *_cleared(state, state.unknowns >= limits.unknown_release, "unknown", "unknown_debounce"), raw, similarities, expired
    similarities = fused(state, probe.vectors, limits)
    raw = observed(state, similarities, limits)
    candidate = _likeliest(state, probe, similarities, limits)
    crossing = _crossing(state, probe, limits)
    if crossing is not None:
        candidate = crossing
        _spread(state, candidate)
    if candidate is not None:
        state.pending = []
        _adapted(state, candidate, probe, limits)
        return candidate, *_acquired(state, candidate, probe, "bayes_posterior", limits), raw, similarities, expired
    last = state.heard.get(state.visible or "")
    if limits.continuity is not None and last and float(probe.vectors[0] @ _mean(last)) >= limits.continuity:
        state.unknowns = 0
        return state.visible, "hold", "incumbent_continuity", raw, similarities, expired
    state.unknowns += 1
    label = _created(state, probe, similarities, limits)
    if label is not None:
        return label, *_acquired(state, label, probe, "provisional_acquire", limits), raw, similarities, expired
    return None, *_cleared(state, state.unknowns >= limits.unknown_release, "bayes_unknown", "bayes_unknown_debounce", forget=False), raw, similarities, expired


COLUMNS = "visible string, candidate string, action string, reason string, profiles int, probabilities map<string,double>, raw map<string,double>, similarities map<string,double>, expired array<string>"
PROBE = ("due", "release", "speech", "short", "long")
EVENT = ("speaker", "generation", "centroid", "seconds")


def moved(state: State, at, event: bool, due, release, speech, short, long, speaker, generation, centroid, seconds, limits: Limits) -> tuple | None:
    """COLUMNS of a probe, or None for the publication of a profile; the state moves by either. A null flag is false; vectors
    without a direction don't count, nor do profiles without a name or a direction, and a long vector without a short one."""
    if event:
        centroid = unit(centroid)
        if speaker and centroid is not None:
            publish(state, speaker, int(generation or 0), centroid, float(seconds or 0.0), limits)
        return None
    short, long = unit(short), unit(long)
    vectors = () if short is None else (short,) if long is None or long.shape != short.shape else (short, long)
    candidate, action, reason, raw, similarities, expired = step(state, Probe(int(at), bool(due), bool(release), bool(speech), vectors), limits)
    return state.visible, candidate, action, reason, len(state.profiles), dict(state.posterior), raw, similarities, expired


def rows(probes: DataFrame, events: DataFrame, session: str, at: str, *more: str) -> DataFrame:
    """Probes and published profiles as one table: _session, _at, _event, PROBE, EVENT and the columns ``more`` of both."""
    types = {"due": "boolean", "release": "boolean", "speech": "boolean", "short": "array<double>", "long": "array<double>", "speaker": "string", "generation": "int", "centroid": "array<double>", "seconds": "double"}

    def side(df: DataFrame, event: bool, have: tuple[str, ...]) -> DataFrame:
        columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(f"_{c}") for c, t in types.items()]
        return df.filter(F.col(at).isNotNull()).select(F.col(session).alias("_session"), F.col(at).cast("long").alias("_at"), F.lit(event).alias("_event"), *columns, *more)

    return side(events, True, EVENT).unionByName(side(probes, False, PROBE))


def tracked(probes: DataFrame, events: DataFrame, session: str, at: str, limits: Limits = Limits()) -> DataFrame:
    """(session, at, COLUMNS) for each probe (columns PROBE), with the profiles of ``events`` (columns EVENT) from their ``at`` on.

    Profiles of one moment come before its probes, by generation, then name. Rows without ``at`` don't count; rows of a
    null session are one session; all vectors of a session have one length. A session is read as a stream by one task.
    """
    out = StructType([probes.schema[session], *StructType.fromDDL(f"{at} long, {COLUMNS}")])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), State()
        for batch in batches:
            found = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (key,):
                    now, state = (key,), State()
                row = moved(state, *values, limits)
                if row is not None:
                    found.append((key, values[0], *row))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(t) else list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    # Not by _session itself: where both tables are dealt by it, Spark leaves that shuffle out and merges the partitions
    # of each table by its own sizes, so that probes and profiles of a session may part.
    return rows(probes, events, session, at).repartition(F.xxhash64("_session")).sortWithinPartitions("_session", "_at", F.desc("_event"), "_generation", "_speaker", "_due", "_release", "_speech", "_short", "_long").mapInArrow(run, out)
