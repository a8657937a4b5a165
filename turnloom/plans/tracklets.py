"""Queries of temporary identities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import tracklets as T
from turnloom.plans.views import run_sql, with_views

_DIMENSIONS = 6
_NUMBERS = ", ".join(f"CASE WHEN voice = {d} THEN 64 ELSE 0 END + CASE WHEN voice = 6 AND {d} < 2 THEN 50 ELSE 0 END + (hold_ms * {7 + 4 * d} + event_id * {3 + d}) % 37 - 18 AS {{p}}{d}" for d in range(_DIMENSIONS))

#: Probes with a voice that changes every few places. Three voices get profiles after a while, one of which goes again; one
#: voice lies between two others; for some seconds nobody is heard.
PROBES = f"""
SELECT session_id, at_ms, place, event_id % 9 <> 4 AS due, hold_ms % 23 = 0 AS release, hold_ms % 19 <> 1 AS speech, event_id % 13 <> 6 AS has_short, event_id % 3 <> 1 AS has_long,
 place >= 20 AS f0, place >= 32 AND place < 60 AS f1, place >= 44 AS f2,
 CASE WHEN voice = 0 AND place >= 20 THEN 'F0' WHEN voice = 1 AND place >= 32 AND place < 60 THEN 'F1' WHEN voice = 3 AND place % 2 = 1 THEN 'F2' END AS base,
 {_NUMBERS.format(p="s")}, {_NUMBERS.replace("37 - 18", "29 - 14").format(p="l")}
FROM (SELECT session_id, event_id, hold_ms, place, CAST(400 * place + CASE WHEN place > 50 THEN 9000 ELSE 0 END AS BIGINT) AS at_ms, CAST(CASE WHEN place < 60 THEN (FLOOR(place / 5) * 3 + session_id) % 5 ELSE (FLOOR(place / 4) * 3) % 7 END AS BIGINT) AS voice
 FROM (SELECT session_id, event_id, hold_ms, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) AS BIGINT) AS place FROM probes) p) v"""

#: Profiles by name: the voice they are of, and how strong.
_PROFILES = {"F0": 0, "F1": 1, "F2": 2}


def _direction(voice: int) -> list[float]:
    return [1.0 if d == voice else 0.1 for d in range(_DIMENSIONS)]


def _shown(spark, sf_dir, limits):
    p = run_sql(spark, sf_dir, PROBES)
    vector = lambda k: F.array(*(F.col(f"{k}{d}").cast("double") for d in range(_DIMENSIONS)))
    profiles = F.map_from_entries(F.filter(F.array(*(F.when(F.col(f"f{k}"), F.struct(F.lit(name), F.array(*map(F.lit, _direction(v))))) for k, (name, v) in enumerate(_PROFILES.items()))), lambda e: e.isNotNull()))
    probes = p.select("session_id", "at_ms", "due", "release", "speech", F.when(F.col("has_short"), vector("s")).alias("short"), F.when(F.col("has_long"), vector("l")).alias("long"), profiles.alias("profiles"), "base", F.lit("hold").alias("base_action"), F.lit("base").alias("base_reason"))
    return T.shown(probes, "session_id", "at_ms", limits)


CONTRADICTING = T.Limits(contradiction_profiles=2, contradiction_s=0.5, contradiction_l=0.5, most=3)


def open_set_tracklets(spark, sf_dir):
    """Who is shown at each probe, with temporary names for voices that no profile explains."""
    return _shown(spark, sf_dir, T.Limits()).drop("aliases")


def contradicted_profiles(spark, sf_dir):
    """The same with at most three temporary voices, where a voice that is unlike all profiles is not shown as one."""
    return _shown(spark, sf_dir, CONTRADICTING).drop("aliases")


def tracklet_aliases(spark, sf_dir):
    """Profiles that took over a temporary name, and those that went."""
    out = _shown(spark, sf_dir, T.Limits()).select("session_id", "at_ms", F.inline("aliases"))
    return out.withColumn("similarity", quantized(F.col("similarity"), 4))


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt({_dot(v, v)}))"


def _mix(a: str, b: str, alpha: float) -> str:
    """The direction of (1 - alpha) a + alpha b, as one list of numbers after the other."""
    return _unit(f"list_transform(list_zip({a}, {b}), lambda z: {1.0 - alpha!r}::DOUBLE * z[1] + {alpha!r}::DOUBLE * z[2])")


def _heard(t: str, limits: T.Limits) -> str:
    """A voice after it was heard in this probe."""
    return (
        f"{{'id': {t}.id, 's': {_mix(f'{t}.s', 'short', limits.alpha)}, 'l': CASE WHEN long IS NULL THEN {t}.l WHEN {t}.l IS NULL THEN long ELSE {_mix(f'{t}.l', 'long', limits.alpha)} END, 'last': at_ms}}"
    )


def _best(short: str, long: str, limits: T.Limits) -> str:
    """Voices heard lately with their similarities, the best one first."""
    s, l = _dot("t.s", short), f"CASE WHEN t.l IS NULL OR {long} IS NULL THEN -1 ELSE {_dot('t.l', long)} END"
    return f"""list_sort(list_transform(list_filter(voices, lambda t: at_ms - t.last <= {limits.idle_ms}), lambda t:
 {{'r': -(0.7::DOUBLE * {s} + 0.3::DOUBLE * CASE WHEN {long} IS NULL THEN {s} ELSE {l} END), 'id': t.id, 's': {s}, 'l': {l}}}))"""


def _recursion(limits: T.Limits) -> str:
    """Probes as a recursion over the place in the session: each row holds the state after its probe."""
    profile = lambda name: f"'{name}'"
    vectors = ", ".join(f"CASE WHEN f{k} THEN {{'name': {profile(n)}, 'v': {_unit(f'{_direction(v)!r}::DOUBLE[]')}}} END" for k, (n, v) in enumerate(_PROFILES.items()))
    list_of = lambda k: "[" + ", ".join(f"{k}{d}::DOUBLE" for d in range(_DIMENSIONS)) + "]"
    most_like = lambda v: f"COALESCE(list_max(list_transform(profiles, lambda p: CASE WHEN {v} IS NULL THEN -1 ELSE {_dot(v, 'p.v')} END)), -1)"
    contradiction = f"LEN(profiles) >= {limits.contradiction_profiles} AND known_s < {limits.contradiction_s} AND (long IS NULL OR known_l < {limits.contradiction_l}) AND (base IS NOT NULL OR contradicted)" if limits.contradiction_profiles else "FALSE"
    return f"""
WITH RECURSIVE seen AS (SELECT session_id, at_ms, place, NOT (release OR NOT speech OR NOT due OR NOT has_short) AS open, CASE WHEN has_short THEN {_unit(list_of("s"))} END AS short, CASE WHEN has_long THEN {_unit(list_of("l"))} END AS long,
 list_filter([{vectors}], lambda p: p IS NOT NULL) AS profiles, base FROM ({PROBES}) t),
walk AS (
 SELECT session_id, 0::BIGINT AS place, 0::BIGINT AS at_ms, []::STRUCT(id INT, s DOUBLE[], l DOUBLE[], last BIGINT)[] AS voices, NULL::STRUCT(s DOUBLE[], l DOUBLE[], n INT, last BIGINT) AS pending, []::VARCHAR[] AS known,
  []::STRUCT(profile VARCHAR, id INT)[] AS names, NULL::VARCHAR AS visible, FALSE AS contradicted, 0 AS made, 0 AS generation, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, FALSE AS created,
  []::STRUCT(generation INT, profile VARCHAR, id INT, similarity DOUBLE, retired BOOLEAN)[] AS aliases FROM (SELECT DISTINCT session_id FROM seen) s
 UNION ALL
 SELECT session_id, place, at_ms, after_voices, after_pending, after_known, after_names, shown,
  kind = 'waiting' AND contradiction, made + CASE WHEN kind = 'new' THEN 1 ELSE 0 END, generation + LEN(aliases),
  CASE WHEN shown IS NOT NULL THEN CASE WHEN visible IS NULL THEN 'acquire' WHEN visible = shown THEN 'hold' ELSE 'switch' END WHEN visible IS NOT NULL THEN 'clear' WHEN kind IN ('closed', 'old') THEN 'hold' ELSE 'none' END,
  CASE kind WHEN 'closed' THEN 'base' WHEN 'old' THEN 'base' WHEN 'reuse' THEN 'open_set_tracklet_reuse' WHEN 'waiting' THEN 'open_set_pending_unknown' WHEN 'full' THEN 'open_set_tracklet_capacity' ELSE 'open_set_tracklet_confirmed' END,
  kind = 'new', aliases
 FROM (SELECT *, CASE WHEN kind = 'waiting' THEN waiting END AS after_pending,
   CASE WHEN kind = 'new' THEN '{limits.prefix}' || (made + 1) WHEN chosen IS NOT NULL THEN '{limits.prefix}' || chosen WHEN kind IN ('closed', 'old') THEN base_name END AS shown,
   CASE WHEN kind = 'new' THEN list_append(voices, {_heard("fresh", limits)}) WHEN chosen IS NOT NULL THEN list_transform(voices, lambda t: CASE WHEN t.id = chosen THEN {_heard("t", limits)} ELSE t END) ELSE voices END AS after_voices
  FROM (SELECT *, CASE WHEN kind = 'reuse' THEN best.id WHEN kind = 'again' THEN candidate.id END AS chosen, {{'id': made + 1, 's': waiting.s, 'l': waiting.l, 'last': at_ms}} AS fresh
   FROM (SELECT *, CASE WHEN NOT open THEN 'closed' WHEN reusable THEN 'reuse' WHEN NOT novel THEN 'old' WHEN waiting.n < {limits.confirmations} THEN 'waiting'
     WHEN COALESCE(candidate.s >= {limits.reuse_s}, FALSE) THEN 'again' WHEN LEN(voices) < {limits.most} THEN 'new' ELSE 'full' END AS kind
    FROM (SELECT *, {_best("waiting.s", "waiting.l", limits)}[1] AS candidate
     FROM (SELECT *, CASE WHEN COALESCE(at_ms - pending.last <= {limits.pending_gap_ms} AND {_dot("pending.s", "short")} >= {limits.pending_s}, FALSE)
        THEN {{'s': {_mix("pending.s", "short", 0.5)}, 'l': CASE WHEN long IS NULL THEN pending.l WHEN pending.l IS NULL THEN long ELSE {_mix("pending.l", "long", 0.5)} END, 'n': pending.n + 1, 'last': at_ms}}
        ELSE {{'s': short, 'l': long, 'n': 1, 'last': at_ms}} END AS waiting,
       COALESCE((best.s >= {limits.reuse_s} AND (LEN(profiles) = 0 OR best.s >= known_s + {limits.known_margin}::DOUBLE)) OR (best.s >= {limits.weak_s} AND best.l >= {limits.weak_l} AND (LEN(profiles) = 0 OR best.s >= known_s + {limits.weak_known_margin}::DOUBLE)), FALSE) AS reusable,
       LEN(profiles) = 0 OR (known_s < CASE WHEN contradiction THEN {limits.contradiction_s} ELSE {limits.novel_s} END AND (long IS NULL OR known_l < CASE WHEN contradiction THEN {limits.contradiction_l} ELSE {limits.novel_l} END)) AS novel
      FROM (SELECT *, {contradiction} AS contradiction
       FROM (SELECT *, {most_like("short")} AS known_s, {most_like("long")} AS known_l, {_best("short", "long", limits)}[1] AS best,
         CASE WHEN list_contains(list_transform(after_names, lambda b: b.profile), base) THEN '{limits.prefix}' || list_filter(after_names, lambda b: b.profile = base)[1].id ELSE base END AS base_name
        FROM (SELECT *, list_concat(gone, CASE WHEN bound.s >= {limits.merge} THEN [{{'generation': (generation + LEN(gone) + 1)::INT, 'profile': fresh_profile.name, 'id': bound.id, 'similarity': bound.s, 'retired': FALSE}}] ELSE [] END) AS aliases,
          CASE WHEN bound.s >= {limits.merge} THEN list_append(kept_names, {{'profile': fresh_profile.name, 'id': bound.id}}) ELSE kept_names END AS after_names, list_distinct(list_concat(known, labels)) AS after_known
         FROM (SELECT *, list_sort(list_transform(list_filter(voices, lambda t: fresh_profile IS NOT NULL AND NOT list_contains(list_transform(kept_names, lambda b: b.id), t.id)), lambda t:
            {{'s': GREATEST({_dot("t.s", "fresh_profile.v")}, CASE WHEN t.l IS NULL THEN -1 ELSE {_dot("t.l", "fresh_profile.v")} END), 'id': t.id}}))[-1] AS bound
          FROM (SELECT *, list_filter(profiles, lambda p: NOT list_contains(known, p.name))[1] AS fresh_profile, list_filter(names, lambda b: list_contains(labels, b.profile)) AS kept_names,
            list_transform(list_sort(list_filter(names, lambda b: NOT list_contains(labels, b.profile))), lambda b, i: {{'generation': (generation + i)::INT, 'profile': b.profile, 'id': b.id, 'similarity': -1::DOUBLE, 'retired': TRUE}}) AS gone
           FROM (SELECT w.session_id, n.place, n.at_ms, n.open, n.short, n.long, n.profiles, n.base, list_transform(n.profiles, lambda p: p.name) AS labels, w.voices, w.pending, w.known, w.names, w.visible, w.contradicted, w.made, w.generation
            FROM walk w JOIN seen n ON n.session_id = w.session_id AND n.place = w.place + 1) a) b) c) d) e) f) g) h) i) j) k
)
"""


_SHOWN = "SELECT session_id, at_ms, visible, action, reason, COALESCE(starts_with(visible, '{p}'), FALSE) AS temporary, created, LEN(voices)::INT AS voices FROM walk WHERE place > 0"
_ALIASES = """SELECT session_id, at_ms, a.generation, a.profile, '{p}' || a.id AS name, FLOOR(a.similarity * 10000 + 0.5) / 10000 AS similarity, a.retired FROM (SELECT session_id, at_ms, UNNEST(aliases) AS a FROM walk WHERE place > 0) w"""


def queries() -> dict:
    return {q.__name__: q for q in (open_set_tracklets, contradicted_profiles, tracklet_aliases)}


def oracle_sql() -> dict[str, str]:
    prefix = T.Limits().prefix
    found = {"open_set_tracklets": _recursion(T.Limits()) + _SHOWN, "contradicted_profiles": _recursion(CONTRADICTING) + _SHOWN, "tracklet_aliases": _recursion(T.Limits()) + _ALIASES}
    return {name: with_views(sql.replace("{p}", prefix)).replace("WITH probes", "WITH RECURSIVE probes", 1).replace("RECURSIVE seen AS", "seen AS", 1) for name, sql in found.items()}
