"""Queries of the Bayesian filter, and their SQL. Provisional profiles have no SQL; tests compare them with a second version."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import bayes as B
from turnloom.operators.tracklets import unit
from turnloom.plans.tracklets import _DIMENSIONS, PROBES
from turnloom.plans.views import run_sql, with_views


def _direction(*parts: float) -> list[float]:
    return [*parts, *[0.1] * (_DIMENSIONS - len(parts))]


#: (place, name, generation, centroid, seconds) of the profiles that are published; the last one is out of date by then.
EVENTS = (
    (20, "F0", 1, _direction(1.0), 3.0), (32, "F1", 1, _direction(0.1, 1.0), 8.0), (44, "F2", 1, _direction(0.1, 0.1, 1.0), 1.5),
    (50, "F0", 2, _direction(1.0, 0.4), 6.0), (55, "F0", 1, _direction(0.0, 0.0, 0.0, 1.0), 9.0),
)

TUNED = B.Limits(short_weight=0.4, long_weight=0.6, confidence_power=0.5, few_profiles=2, few_bias=0.2, many_bias=-0.1, bias_slope=0.3, history=2, history_weight=0.3, maturity=0.2, cohort_mean=0.1, cohort_max=0.05, min_margin=0.02, switch_margin=0.05, stay=0.9, prior=0.7)


def inputs(spark, sf_dir):
    """(probes, published profiles)."""
    p = run_sql(spark, sf_dir, PROBES)
    vector = lambda k: F.array(*(F.col(f"{k}{d}").cast("double") for d in range(_DIMENSIONS)))
    probes = p.select("session_id", "at_ms", "due", "release", "speech", F.when(F.col("has_short"), vector("s")).alias("short"), F.when(F.col("has_long"), vector("l")).alias("long"))
    told = F.array(*(F.struct(F.lit(place).alias("place"), F.lit(name).alias("speaker"), F.lit(g).alias("generation"), F.array(*map(F.lit, v)).alias("centroid"), F.lit(s).alias("seconds")) for place, name, g, v, s in EVENTS))
    events = p.select("session_id", "at_ms", "place", F.explode(F.filter(told, lambda e: e["place"] == F.col("place"))).alias("e")).select("session_id", "at_ms", "e.speaker", "e.generation", "e.centroid", "e.seconds")
    return probes, events


def _tracked(spark, sf_dir, limits):
    out = B.tracked(*inputs(spark, sf_dir), "session_id", "at_ms", limits)
    p = F.col("probabilities")
    return out.select("session_id", "at_ms", "visible", "candidate", "action", "reason", "profiles", quantized(F.element_at(p, F.lit(B.UNKNOWN)), 4).alias("p_unknown"), quantized(F.array_max(F.map_values(p)), 4).alias("p_most"), quantized(F.array_max(F.map_values("similarities")), 4).alias("similarity"))


def tracker_default(spark, sf_dir):
    """Who speaks at each probe, with the fixed values as they are."""
    return _tracked(spark, sf_dir, B.Limits())


def tracker_tuned(spark, sf_dir):
    """The same with windows weighed by how well they tell profiles apart, kept centroids, cohorts and maturity."""
    return _tracked(spark, sf_dir, TUNED)


def provisional_tracker(spark, sf_dir):
    """Voices without a profile become provisional ones, which expire after five seconds of silence."""
    limits = B.Limits(provisional=True, ceiling=0.5, min_similarity=0.45, merge=0.6, update_alpha=0.1, reactivation=0.7, expiry_ms=5000, continuity=0.8)
    out = B.tracked(*inputs(spark, sf_dir), "session_id", "at_ms", limits)
    return out.select("session_id", "at_ms", "visible", "action", "reason", "profiles", "expired")


def _profiles(limits: B.Limits) -> tuple[str, str]:
    """(profiles known at a place, does one come at this place) as SQL, from what publishing them one by one gives."""
    state, cases, fresh = B.State(), [], []

    def literal() -> str:
        found = []
        for k, p in sorted(state.profiles.items()):
            others = [float(p.centroid @ q.centroid) for j, q in state.profiles.items() if j != k]
            shared = limits.cohort_mean * sum(others) / len(others) + limits.cohort_max * max(others) if others else 0.0
            found.append(f"{{'name': '{k}', 'v': {p.centroid.tolist()!r}::DOUBLE[], 'h': {[h.tolist() for h in p.history]!r}::DOUBLE[][], 'sec': {p.seconds!r}::DOUBLE, 'shared': {shared!r}::DOUBLE}}")
        return "[" + ", ".join(found) + "]" if found else "[]::STRUCT(name VARCHAR, v DOUBLE[], h DOUBLE[][], sec DOUBLE, shared DOUBLE)[]"

    for place, name, generation, centroid, seconds in EVENTS:
        cases.append(f"WHEN place < {place} THEN {literal()}")
        if B.publish(state, name, generation, unit(centroid), seconds, limits) is not None:
            fresh.append(str(place))
    return f"CASE {' '.join(cases)} ELSE {literal()} END", f"place IN ({', '.join(fresh)})"


def _recursion(limits: B.Limits) -> str:
    """Probes as a recursion over the place in the session: each row holds the state after its probe."""
    known, fresh = _profiles(limits)
    vector = lambda k: "[" + ", ".join(f"{k}{d}::DOUBLE" for d in range(_DIMENSIONS)) + "]"
    direction = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
    like = lambda v: f"list_transform(ps, lambda p: {1.0 - limits.history_weight!r}::DOUBLE * list_inner_product({v}, p.v) + {limits.history_weight!r}::DOUBLE * list_max(list_transform(p.h, lambda h: list_inner_product({v}, h))))"
    lead = lambda s: f"CASE WHEN LEN({s}) > 1 THEN list_reverse_sort({s})[1] - list_reverse_sort({s})[2] ELSE GREATEST(0, {s}[1] - {limits.min_similarity}) END"
    weight = lambda w, s: f"{w!r}::DOUBLE" + (f" * ({limits.confidence_floor}::DOUBLE + GREATEST(0, {lead(s)})) ** {limits.confidence_power}::DOUBLE" if limits.confidence_power else "")
    soft = lambda x: f"list_transform({x}, lambda v: exp(GREATEST(-60, v - list_max({x}))) / list_sum(list_transform({x}, lambda u: exp(GREATEST(-60, u - list_max({x}))))))"
    bias = f"CASE WHEN LEN(ps) <= {limits.few_profiles} THEN {limits.few_bias} ELSE {limits.many_bias} END" if limits.few_profiles else f"{limits.unknown_bias}"
    mature = lambda p: f"{limits.maturity} * (ln({limits.maturity_seconds} + {p}.sec) - list_max(list_transform(ps, lambda o: ln({limits.maturity_seconds} + o.sec))))"
    return f"""
WITH RECURSIVE seen AS (SELECT session_id, at_ms, place, {fresh} AS fresh, CASE WHEN has_short THEN {direction(vector("s"))} END AS short, CASE WHEN has_long THEN {direction(vector("l"))} END AS long, {known} AS ps,
 CASE WHEN release THEN 'release' WHEN NOT due THEN 'off' WHEN NOT speech THEN 'quiet' WHEN NOT has_short OR place < {EVENTS[0][0]} THEN 'blank' ELSE 'seen' END AS kind FROM ({PROBES}) t),
walk AS (
 SELECT session_id, 0::BIGINT AS place, 0::BIGINT AS at_ms, NULL::VARCHAR AS visible, 0 AS unknowns, 0 AS silences, [{{'name': '{B.UNKNOWN}', 'p': 1::DOUBLE}}] AS post, NULL::VARCHAR AS candidate, NULL::VARCHAR AS action, NULL::VARCHAR AS reason,
  0 AS profiles, NULL::DOUBLE AS similarity FROM (SELECT DISTINCT session_id FROM seen) s
 UNION ALL
 SELECT session_id, place, at_ms, CASE WHEN act = 'clear' THEN NULL ELSE COALESCE(cand, visible) END, unknowns, silences,
  CASE WHEN act = 'clear' AND kind <> 'seen' THEN [{{'name': '{B.UNKNOWN}', 'p': 1::DOUBLE}}] WHEN kind = 'seen' THEN found WHEN fresh THEN list_transform(before, lambda e: {{'name': e.name, 'p': e.p / list_sum(list_transform(before, lambda o: o.p))}}) ELSE post END,
  cand, act, CASE kind WHEN 'release' THEN CASE WHEN act = 'hold' THEN 'release_debounce' ELSE 'release_gate' END WHEN 'off' THEN 'non_probe_tick' WHEN 'quiet' THEN 'probe_gate_silence' WHEN 'blank' THEN CASE WHEN act = 'hold' THEN 'unknown_debounce' ELSE 'unknown' END
   ELSE CASE WHEN cand IS NOT NULL THEN 'bayes_posterior' WHEN act = 'hold' THEN 'bayes_unknown_debounce' ELSE 'bayes_unknown' END END, LEN(ps)::INT, list_max(sims)
 FROM (SELECT *, CASE WHEN cand IS NOT NULL THEN CASE WHEN visible IS NULL THEN 'acquire' WHEN visible = cand THEN 'hold' ELSE 'switch' END WHEN visible IS NULL THEN 'none'
    WHEN (kind = 'release' AND silences >= {limits.silence_release}) OR (kind IN ('blank', 'seen') AND unknowns >= {limits.unknown_release}) THEN 'clear' ELSE 'hold' END AS act
  FROM (SELECT * REPLACE (CASE kind WHEN 'off' THEN unknowns WHEN 'blank' THEN unknowns + 1 WHEN 'seen' THEN CASE WHEN cand IS NULL THEN unknowns + 1 ELSE 0 END ELSE 0 END AS unknowns, CASE kind WHEN 'release' THEN silences + 1 WHEN 'off' THEN silences ELSE 0 END AS silences)
   FROM (SELECT *, CASE WHEN kind = 'seen' AND best.p >= {limits.min_known} AND best.p >= found[1].p AND best.p - COALESCE(-ranked[2].p, 0) >= {limits.switch_margin} AND sims[best.i] >= {limits.min_similarity}
      AND CASE WHEN LEN(sims) > 1 THEN list_reverse_sort(sims)[1] - list_reverse_sort(sims)[2] ELSE 1 END >= {limits.min_margin} THEN ps[best.i].name END AS cand
    FROM (SELECT *, {{'p': -ranked[1].p, 'i': ranked[1].i}} AS best
     FROM (SELECT *, list_sort(list_transform(found[2:], lambda e, i: {{'p': -e.p, 'i': i}})) AS ranked
      FROM (SELECT *, list_transform(before, lambda e, i: {{'name': e.name, 'p': mass[i]}}) AS found
       FROM (SELECT *, {soft("logits")} AS mass
        FROM (SELECT *, list_transform(raw, lambda r, i: {limits.evidence!r}::DOUBLE * ln(GREATEST(1e-12, r)) + {limits.prior!r}::DOUBLE * ln(GREATEST(1e-12,
           {limits.stay!r}::DOUBLE * (before[i].p / total) + {1.0 - limits.stay!r}::DOUBLE * (1 - before[i].p / total) / LEN(ps)))) AS logits
         FROM (SELECT *, {soft("signs")} AS raw, list_sum(list_transform(before, lambda e: e.p)) AS total
          FROM (SELECT *, list_prepend(({limits.min_similarity} - list_max(sims)) / {limits.temperature}::DOUBLE + {bias} + {limits.bias_slope} * ln(LEN(ps)),
             list_transform(sims, lambda s, i: (s - {limits.min_similarity}) / {limits.temperature}::DOUBLE + {mature("ps[i]")})) AS signs
           FROM (SELECT *, list_transform(ss, lambda s, i: CASE WHEN ls IS NULL THEN s ELSE (ws * s + wl * ls[i]) / (ws + wl) END - ps[i].shared) AS sims
            FROM (SELECT *, {weight(limits.short_weight, "ss")} AS ws, {weight(limits.long_weight, "ls")} AS wl
             FROM (SELECT *, CASE WHEN kind = 'seen' THEN {like("short")} END AS ss, CASE WHEN kind = 'seen' AND long IS NOT NULL THEN {like("long")} END AS ls,
               list_transform(list_prepend('{B.UNKNOWN}', list_transform(ps, lambda p: p.name)), lambda k: {{'name': k, 'p': GREATEST(CASE WHEN fresh THEN 1e-9 ELSE 0 END::DOUBLE, COALESCE(list_filter(post, lambda e: e.name = k)[1].p, 0))}}) AS before
              FROM (SELECT w.session_id, n.place, n.at_ms, n.fresh, n.short, n.long, n.ps, n.kind, w.visible, w.unknowns, w.silences, w.post FROM walk w JOIN seen n ON n.session_id = w.session_id AND n.place = w.place + 1) a) b) c) d) e) f) g) h) i) j) k) l) m) n
)
SELECT session_id, at_ms, visible, candidate, action, reason, profiles, FLOOR(post[1].p * 10000 + 0.5) / 10000 AS p_unknown, FLOOR(list_max(list_transform(post, lambda e: e.p)) * 10000 + 0.5) / 10000 AS p_most, FLOOR(similarity * 10000 + 0.5) / 10000 AS similarity
FROM walk WHERE place > 0"""


def queries() -> dict:
    return {q.__name__: q for q in (tracker_default, tracker_tuned, provisional_tracker)}


def oracle_sql() -> dict[str, str]:
    found = {"tracker_default": _recursion(B.Limits()), "tracker_tuned": _recursion(TUNED)}
    return {name: with_views(sql).replace("WITH probes", "WITH RECURSIVE probes", 1).replace("RECURSIVE seen AS", "seen AS", 1) for name, sql in found.items()}
