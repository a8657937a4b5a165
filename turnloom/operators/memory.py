"""Speaker memory: vectors of a session, in order, go to stable groups that are made and moved as they come.

The state of a session is small: at most ``Limits.most`` speakers and ``Limits.pending`` groups that wait for
confirmation, each a unit centroid, a count and seconds of speech. ``step`` moves the state by one vector; the batch
operator runs it over sorted rows as a stream, so a long session costs time, not memory, and
``turnloom.streaming.memory`` keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Limits:
    """Thresholds of similarity, probability and seconds."""

    same: float = 0.45
    temperature: float = 0.07
    margin: float = 0.05
    margin_temperature: float = 0.035
    new_unknown: float = 0.58
    duplicate: float = 0.40
    short_unknown: float = 0.86
    first_s: float = 1.2
    first_now_s: float = 1.2
    new_s: float = 2.0
    late_s: float = 3.5
    most: int = 10
    update_unknown: float = 0.55
    confirmations: int = 1
    confirm_similarity: float = 0.52
    pending: int = 6
    known_similarity: float = -1.0

    def distinct(self) -> np.ndarray:
        """When a vector is a new speaker's: seconds and unknown at least, similarity and margin below; any row will do."""
        slim, wide = max(self.margin, 0.08), max(self.margin, 0.10)
        return np.array([
            (self.new_s, self.new_unknown, self.duplicate, np.inf),
            (self.new_s, max(self.new_unknown, 0.8), self.duplicate + 0.04, slim),
            (self.late_s, self.new_unknown, self.duplicate + 0.04, slim),
            (self.late_s, 0.30, self.duplicate + 0.05, wide),
        ])


@dataclass
class Groups:
    """Centroids (rows of unit length), counts and seconds."""

    centroids: np.ndarray
    counts: list[int] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)

    def similarities(self, v: np.ndarray) -> np.ndarray:
        return self.centroids @ v

    def add(self, v: np.ndarray, count: int, seconds: float) -> None:
        self.centroids = np.vstack([self.centroids, v])
        self.counts.append(count)
        self.seconds.append(seconds)

    def move(self, k: int, v: np.ndarray, weight: float, seconds: float) -> None:
        c = (1 - weight) * self.centroids[k] + weight * v
        size = np.linalg.norm(c)
        if size > 0:
            self.centroids[k] = c / size
        self.counts[k] += 1
        self.seconds[k] += seconds

    def drop(self, k: int) -> tuple[np.ndarray, int, float]:
        out = self.centroids[k], self.counts.pop(k), self.seconds.pop(k)
        self.centroids = np.delete(self.centroids, k, 0)
        return out


@dataclass
class State:
    speakers: Groups
    waiting: Groups

    @classmethod
    def empty(cls, size: int) -> State:
        return cls(Groups(np.zeros((0, size))), Groups(np.zeros((0, size))))


@dataclass
class Decision:
    speaker: int | None = None
    created: bool = False
    source: str = "embedding"
    unknown: float = 1.0
    similarity: float | None = None
    margin: float | None = None


def quality(seconds: float) -> float:
    return min(1.0, max(0.25, (seconds - 0.45) / 2.15))


def _logistic(x: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(x, -60, 60))))


def scored(state: State, v: np.ndarray, seconds: float, limits: Limits) -> tuple[int, float, float, float]:
    """(best speaker, its similarity, margin over the next, probability of none of them)."""
    s = state.speakers.similarities(v)
    best = int(s.argmax())
    others = np.delete(s, best)
    margin = float(s[best] - others.max()) if len(others) else 1.0
    known = _logistic((s[best] - limits.same) / limits.temperature)
    if len(others):
        known *= _logistic((margin - limits.margin) / limits.margin_temperature)
    known *= min(1.0, 0.45 + 0.55 * state.speakers.seconds[best] / 8) * (0.55 + 0.45 * quality(seconds))
    return best, float(s[best]), margin, 1 - min(1.0, max(0.0, known))


def is_new(speakers: int, unknown: float, similarity: float, margin: float, seconds: float, limits: Limits) -> bool:
    if speakers >= limits.most or (speakers >= 4 and seconds < limits.late_s and similarity >= max(0.25, limits.duplicate - 0.15)):
        return False
    least_s, least_u, below, slim = limits.distinct().T
    return bool(((seconds >= least_s) & (unknown >= least_u) & (similarity < below) & (margin < slim)).any())


def _confirm(state: State, v: np.ndarray, seconds: float, needed: int, limits: Limits) -> bool:
    """Put the vector to the waiting group it is like, or to a new one; True if that group became a speaker."""
    s = state.waiting.similarities(v)
    if not len(s) or s.max() < limits.confirm_similarity:
        state.waiting.add(v, 1, seconds)
        if len(state.waiting.counts) > limits.pending:  # the weakest goes
            state.waiting.drop(min(range(len(state.waiting.counts)), key=lambda k: (state.waiting.counts[k], state.waiting.seconds[k], k)))
        return False
    k = int(s.argmax())
    state.waiting.move(k, v, 1 / (state.waiting.counts[k] + 1), seconds)
    if state.waiting.counts[k] < needed or state.waiting.seconds[k] < limits.new_s:
        return False
    state.speakers.add(*state.waiting.drop(k))
    return True


def step(state: State, vector: np.ndarray, seconds: float, limits: Limits) -> Decision:
    """Decide whose vector it is and move the state."""
    size = np.linalg.norm(vector)
    v, seconds = vector / size if size > 0 else vector, max(0.0, seconds)
    if not state.speakers.counts:
        if seconds < limits.first_s:
            return Decision()
        if seconds >= limits.first_now_s:
            state.speakers.add(v, 1, seconds)
        elif not _confirm(state, v, seconds, max(2, limits.confirmations), limits):
            return Decision(source="first_speaker_pending")
        state.waiting = State.empty(len(v)).waiting  # leftovers from before the first speaker don't become later ones
        return Decision(0, True, unknown=0.0, similarity=1.0, margin=1.0)
    best, similarity, margin, unknown = scored(state, v, seconds, limits)
    out = Decision(None, False, "embedding", unknown, similarity, margin)
    waits = limits.confirmations > 1 and len(state.waiting.counts) and state.waiting.similarities(v).max() >= limits.confirm_similarity
    if is_new(len(state.speakers.counts), unknown, similarity, margin, max(seconds, limits.new_s) if waits else seconds, limits):
        made = True
        if limits.confirmations > 1:
            made = _confirm(state, v, seconds, limits.confirmations, limits)
        else:
            state.speakers.add(v, 1, seconds)
        if not made:
            out.source = "new_speaker_pending"
            return out
        out.speaker, out.created, out.unknown = len(state.speakers.counts) - 1, True, 0.0
        return out
    if similarity < limits.known_similarity:
        out.source = "gray_zone_unknown"
        if seconds >= limits.new_s and len(state.speakers.counts) < limits.most and _confirm(state, v, seconds, max(2, limits.confirmations), limits):
            out.speaker, out.created, out.unknown, out.source = len(state.speakers.counts) - 1, True, 0.0, "embedding"
        return out
    alone = len(state.speakers.counts) == 1 and similarity < max(limits.same + 0.12, limits.duplicate + 0.08)
    if seconds < limits.new_s and (alone or unknown >= limits.short_unknown):
        return out
    out.speaker = best
    q = quality(seconds)
    if unknown <= limits.update_unknown and q >= 0.35:
        state.speakers.move(best, v, min(0.28, 0.08 + 0.18 * q) / max(1.0, state.speakers.counts[best] ** 0.35), seconds)
    return out


COLUMNS = "assigned string, created boolean, source string, unknown double, similarity double, margin double"


def row_of(d: Decision) -> tuple:
    """Values of COLUMNS."""
    return (None if d.speaker is None else f"S{d.speaker + 1}", d.created, d.source, d.unknown, d.similarity, d.margin)


def assigned(rows: DataFrame, session: str, order_by: list[str], vector: str, seconds: str, limits: Limits = Limits()) -> DataFrame:
    """(session, order_by, COLUMNS) for each row, sessions apart and rows in order.

    A row without a vector is nobody's and moves nothing; vectors of a session have one length. Rows of a null session
    are one session.
    """
    keys = [session, *order_by]
    out = StructType([*rows.select(*keys).schema, *StructType.fromDDL(COLUMNS)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), None
        for batch in batches:
            found = []
            for key, v, s in zip(*(batch.column(c).to_pylist() for c in (session, "_vector", "_seconds"))):
                if now != (key,):
                    now, state = (key,), None
                if v is None:
                    found.append(row_of(Decision()))
                    continue
                state = state or State.empty(len(v))
                found.append(row_of(step(state, np.array(v, float), s or 0.0, limits)))
            new = [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 6, schema.types[len(keys) :])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(schema.field(k).type) for k in keys), *new], schema=schema)

    body = rows.selectExpr(*(f"`{k}`" for k in keys), f"`{vector}` AS _vector", f"CAST(`{seconds}` AS DOUBLE) AS _seconds")
    return body.repartition(session).sortWithinPartitions(*keys).mapInArrow(run, out)
