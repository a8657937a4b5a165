"""Temporary identities for voices that no profile explains, shown over an unchanged base tracker.

A probe brings a short and a long vector, the profiles known so far and what the base tracker shows. A voice that is far
from every profile in two probes in a row gets a temporary name; the name is used again while the voice came back within
some seconds, and a profile that is published later and sounds like it is shown under the temporary name from then on,
until the profile goes. The state of a session is at most ``Limits.most`` voices, so ``shown`` runs over sorted rows as a
stream and ``turnloom.streaming.tracklets`` keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Limits:
    """Fixed values. Similarities are cosines of the short (s) and the long (l) vector, times are in milliseconds."""

    confirmations: int = 2
    novel_s: float = 0.20
    novel_l: float = 0.25
    pending_s: float = 0.30
    pending_gap_ms: int = 1200
    reuse_s: float = 0.40
    weak_s: float = 0.25
    weak_l: float = 0.45
    known_margin: float = 0.02
    weak_known_margin: float = 0.0
    merge: float = 0.35
    alpha: float = 0.25
    most: int = 12
    idle_ms: int = 8000
    prefix: str = "LIVE_TRACKLET_"
    #: With so many profiles or more a voice below both ceilings contradicts what the base tracker shows; 0: never.
    contradiction_profiles: int = 0
    contradiction_s: float = 0.36
    contradiction_l: float = 0.36


@dataclass
class Voice:
    name: str
    short: np.ndarray
    long: np.ndarray | None
    last: int


@dataclass
class State:
    voices: list[Voice] = field(default_factory=list)
    pending: Voice | None = None
    pending_count: int = 0
    seen: set[str] = field(default_factory=set)  # profiles that were ever published
    names: dict[str, str] = field(default_factory=dict)  # temporary name of a profile
    visible: str | None = None
    contradicted: bool = False
    created: int = 0
    generation: int = 0


@dataclass
class Probe:
    at: int
    due: bool = True
    release: bool = False
    speech: bool = True
    short: np.ndarray | None = None
    long: np.ndarray | None = None
    profiles: dict[str, np.ndarray] = field(default_factory=dict)
    base: str | None = None
    action: str = ""
    reason: str = ""


def unit(v) -> np.ndarray | None:
    """The direction of a vector; none for no vector, and for one without a finite length."""
    if v is None or any(x is None for x in v):
        return None
    v = np.asarray(v, float).reshape(-1)
    n = float(np.sqrt(v @ v))
    return v / n if np.isfinite(n) and n > 1e-8 else None


def cosine(a: np.ndarray | None, b: np.ndarray | None) -> float:
    return float(a @ b) if a is not None and b is not None and a.shape == b.shape else -1.0


def _mixed(old: np.ndarray | None, new: np.ndarray | None, alpha: float) -> np.ndarray | None:
    if old is None or new is None or old.shape != new.shape:
        return old if old is not None else new
    mixed = unit((1.0 - alpha) * old + alpha * new)
    return old if mixed is None else mixed


def _best(voices: list[Voice], short, long, at: int, limits: Limits) -> tuple[Voice | None, float, float]:
    """The most similar voice heard lately, the first of equals, and its similarities."""
    best = (None, -1.0, -1.0)
    most = -np.inf
    for v in voices:
        if at - v.last > limits.idle_ms:
            continue  # the voice keeps its name, but only a profile can bring it back
        s, l = cosine(v.short, short), cosine(v.long, long)
        rank = 0.7 * s + 0.3 * (s if long is None else l)
        if rank > most:
            most, best = rank, (v, s, l)
    return best


def _published(state: State, profiles: dict[str, np.ndarray], limits: Limits) -> list[tuple]:
    """Names given to profiles that are new, and taken from those that are gone: (generation, profile, name, similarity, retired)."""
    out = []
    for profile in sorted(state.names.keys() - profiles.keys()):
        state.generation += 1
        out.append((state.generation, profile, state.names.pop(profile), -1.0, True))
    new = sorted(profiles.keys() - state.seen)
    state.seen |= profiles.keys()
    for profile in new:
        free = [(max(cosine(v.short, profiles[profile]), cosine(v.long, profiles[profile])), v.name) for v in state.voices if v.name not in state.names.values()]
        if not free or max(free)[0] < limits.merge:
            continue
        similarity, name = max(free)
        state.names[profile] = name
        state.generation += 1
        out.append((state.generation, profile, name, similarity, False))
    return out


def _confirmed(state: State, probe: Probe, short, long, limits: Limits) -> tuple[str | None, str, bool]:
    """(name, reason, created) where a novel voice was heard often enough: a known temporary voice, or a new one."""
    waiting, state.pending = state.pending, None
    voice, s, _ = _best(state.voices, waiting.short, waiting.long, probe.at, limits)
    created = voice is None or s < limits.reuse_s
    if created:
        if len(state.voices) >= limits.most:
            return None, "open_set_tracklet_capacity", False
        state.created += 1
        voice = Voice(f"{limits.prefix}{state.created}", waiting.short, waiting.long, probe.at)
        state.voices.append(voice)
    _heard(voice, probe.at, short, long, limits)
    return voice.name, "open_set_tracklet_confirmed", created


def _heard(voice: Voice, at: int, short, long, limits: Limits) -> None:
    voice.short, voice.long, voice.last = _mixed(voice.short, short, limits.alpha), _mixed(voice.long, long, limits.alpha), at


def _chosen(state: State, probe: Probe, limits: Limits) -> tuple[str | None, str, bool, str]:
    """(name to show, reason, created, action of the base tracker where its choice is kept)."""
    doubtful, state.contradicted = state.contradicted, False
    base = state.names.get(probe.base, probe.base) or None
    short, long = unit(probe.short), unit(probe.long)
    if probe.release or not probe.speech or not probe.due or short is None:
        state.pending = None
        return base, probe.reason or "open_set_base", False, probe.action
    known_s, known_l = (max((cosine(v, p) for p in probe.profiles.values()), default=-1.0) for v in (short, long))
    contradiction = bool(limits.contradiction_profiles) and len(probe.profiles) >= limits.contradiction_profiles and known_s < limits.contradiction_s and (long is None or known_l < limits.contradiction_l) and (bool(probe.base) or doubtful)
    ceiling_s, ceiling_l = (limits.contradiction_s, limits.contradiction_l) if contradiction else (limits.novel_s, limits.novel_l)
    voice, s, l = _best(state.voices, short, long, probe.at, limits)
    floor, weak_floor = (known_s + limits.known_margin, known_s + limits.weak_known_margin) if probe.profiles else (-np.inf, -np.inf)
    if voice is not None and ((s >= limits.reuse_s and s >= floor) or (s >= limits.weak_s and l >= limits.weak_l and s >= weak_floor)):
        _heard(voice, probe.at, short, long, limits)
        state.pending = None
        return voice.name, "open_set_tracklet_reuse", False, ""
    if probe.profiles and not (known_s < ceiling_s and (long is None or known_l < ceiling_l)):
        state.pending = None
        return base, probe.reason or "open_set_base", False, probe.action  # a contradiction is always novel
    waiting = state.pending
    if waiting is not None and probe.at - waiting.last <= limits.pending_gap_ms and cosine(waiting.short, short) >= limits.pending_s:
        mixed = unit(0.5 * waiting.short + 0.5 * short)
        state.pending = Voice("", short if mixed is None else mixed, _mixed(waiting.long, long, 0.5), probe.at)
        state.pending_count += 1
    else:
        state.pending, state.pending_count = Voice("", short, long, probe.at), 1
    if state.pending_count < limits.confirmations:
        state.contradicted = contradiction
        return None, "open_set_pending_unknown", False, ""
    return *_confirmed(state, probe, short, long, limits), ""


def step(state: State, probe: Probe, limits: Limits) -> tuple:
    """(visible, action, reason, temporary, created, voices, aliases) of a probe, and the state moved by it."""
    aliases = _published(state, probe.profiles, limits)
    name, reason, created, base_action = _chosen(state, probe, limits)
    before, state.visible = state.visible, name
    if name:
        action = "acquire" if before is None else "hold" if before == name else "switch"
    else:
        action = "clear" if before is not None else base_action or "none"
    return name, action, reason, bool(name and name.startswith(limits.prefix)), created, len(state.voices), aliases


COLUMNS = "visible string, action string, reason string, temporary boolean, created boolean, voices int, aliases array<struct<generation:int,profile:string,name:string,similarity:double,retired:boolean>>"
INPUTS = ("due", "release", "speech", "short", "long", "profiles", "base", "base_action", "base_reason")


def moved(state: State, at, due, release, speech, short, long, profiles, base, action, reason, limits: Limits) -> tuple:
    """``step`` on the values of a row; a null flag is false, a profile without a name or a direction doesn't count."""
    known = {k: v for k, v in ((k, unit(v)) for k, v in dict(profiles or {}).items() if k) if v is not None}
    *plain, aliases = step(state, Probe(int(at), bool(due), bool(release), bool(speech), short, long, known, base, action or "", reason or ""), limits)
    return *plain, [dict(zip(("generation", "profile", "name", "similarity", "retired"), a)) for a in aliases]


def shown(probes: DataFrame, session: str, at: str, limits: Limits = Limits()) -> DataFrame:
    """(session, at, COLUMNS) for each probe; ``probes`` has the columns INPUTS, ``at`` is in milliseconds and orders a session's.

    ``aliases`` are the profiles that were bound to a temporary name by this probe, or whose name was retired. Probes
    without ``at`` don't count; of several at one moment, each moves the state; rows of a null session are one session.
    Vectors of another length than a voice's are unlike it. A session is read as a stream by one task.
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
                found.append((key, values[0], *moved(state, *values, limits)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    rows = probes.filter(F.col(at).isNotNull()).select(F.col(session).alias("_session"), F.col(at).cast("long").alias("_at"), *(F.col(c).alias(f"_{c}") for c in INPUTS))
    return rows.repartition("_session").sortWithinPartitions("_session", "_at", "_due", "_release", "_speech", "_base", "_short", "_long").mapInArrow(run, out)
