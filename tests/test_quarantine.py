"""The guarded filter and its folds: hand-made sessions and plain loops. The folds' queries are held against recursive SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_bayes import EVENTS, PROBES, made
from turnloom.operators import bayes as B
from turnloom.operators import quarantine as Q
from turnloom.plans import quarantine as plans

A, C, D = np.eye(3)
SURE = B.Limits(unknown_bias=-9.0)  # the filter behind the guard always names someone


def guarded(**profiles):
    state = Q.State()
    for name, v in profiles.items():
        B.publish(state.base, name, 1, v, 2.0, SURE)
    return state


def walked(state, probes, gate=Q.Gate(), limits=SURE):
    return [(*Q.step(state, p, limits, gate), state.visible) for p in probes]


def sees(at, v):
    return B.Probe(at, vectors=(v, v))


def test_moments():
    m = Q.Moments()
    values = [0.4, 0.9, -0.2, 0.5]
    for v in values:
        m.update(v, 0.25)
    weights = [0.75**3, 0.25 * 0.75**2, 0.25 * 0.75, 0.25]
    mean = sum(w * v for w, v in zip(weights, values))
    assert m.count == 4 and abs(m.mean - mean) < 1e-12 and abs(m.variance - sum(w * (v - mean) ** 2 for w, v in zip(weights, values))) < 1e-12


def test_decaying_sums():
    assert Q.decayed(0.0, 0.1, 0.5, 0.2) == 0.0 and Q.decayed(1.0, 0.7, 0.5, 0.2) == 1.0


def test_evidence_is_normalised_by_what_profiles_share():
    near = (A + C) / np.sqrt(2)
    out = Q.evidence(Q.State(), {"P": A, "Q": near}, A, C, Q.Gate())
    anchor = A @ near
    assert abs(out["P"].fused - 0.8) < 1e-12 and abs(out["P"].normalized - (0.8 - anchor) / (1 - anchor)) < 1e-12
    assert abs(out["P"].margin + out["Q"].margin) < 1e-12 and abs(out["P"].llr - (out["P"].normalized + 0.1) / 0.075) < 1e-12
    alone = Q.evidence(Q.State(moments={"P": Q.Moments(4, 0.9, 0.01)}), {"P": A}, A, A, Q.Gate())["P"]
    assert abs(alone.llr - (1.1 / 0.075 + 0.2 * (1.0 - (0.9 - 2.25 * 0.1)) / 0.1)) < 1e-9 and alone.margin == 2.0 and alone.ok
    assert not Q.evidence(Q.State(), {"P": A}, C, C, Q.Gate())["P"].ok


def test_a_change_with_an_alert_is_hidden_until_it_is_confirmed():
    state, slow = guarded(P=A, Q=C), Q.Gate(exit_count=2, strong_exit=99.0, least_probes=2)
    assert walked(state, [sees(0, A), sees(400, A)], slow) == [("acquire", "normalized", "P"), ("hold", "normalized", "P")]
    assert walked(state, [sees(800, C), sees(1200, C)], slow) == [("clear", "quarantine", None), ("acquire", "normalized", "Q")]
    assert state.unknown_sum == 0.0 and state.challenger is None and not state.quarantine
    # strong evidence ends it at once; with too few profiles there is none
    strong = guarded(P=A, Q=C)
    assert walked(strong, [sees(0, A), sees(400, C)])[-1] == ("switch", "normalized", "Q")
    few = walked(guarded(P=A, Q=C), [sees(0, A), sees(400, C)], Q.Gate(least_profiles=3, exit_count=9, strong_exit=99.0))
    assert few[-1] == ("switch", "normalized", "Q")
    # a release ends it too
    state = guarded(P=A, Q=C)
    walked(state, [sees(0, A), sees(400, C)], slow)
    assert state.quarantine
    walked(state, [B.Probe(800, release=True), B.Probe(1200, release=True)], slow)
    assert state.visible is None and state.quarantine  # nobody was shown, so nothing is cleared
    assert walked(state, [sees(1600, C), sees(2000, C)], slow)[-1][2] == "Q"


def test_sums_and_learning():
    state = guarded(P=A, Q=C)
    walked(state, [sees(0, A)])
    assert state.moments["P"].count == 1 and state.stable is not None
    found = {"P": Q.Evidence(0.1, -0.5, -2.0, -0.1, False), "Q": Q.Evidence(0.2, 0.1, 1.0, 0.1, True)}
    gate = Q.Gate()
    assert abs(Q._sums(state, found, C, gate) - (0.8 * 3.0 - 0.12)) < 1e-12 and state.challenger[0] == "Q"
    assert abs(state.unknown_sum - (0.75 * 2.0 + 0.35 / 0.65 - 0.12)) < 1e-12
    before = state.challenger[1]
    assert Q._sums(state, {"P": Q.Evidence(0.9, 0.9, 9.0, 0.5, True)}, A, gate) == 0.0 and abs(state.challenger[1] - (0.86 * before - 0.12)) < 1e-12
    B.publish(state.base, "P", 2, D, 1.0, SURE)
    Q._profiles(state, 900)
    assert "P" not in state.moments  # the profile is another one now


def test_rows_nulls_and_empty_tables(spark):
    probes, events = made([None, 1], n=60)
    p, e = spark.createDataFrame([*probes, (1, None, *probes[0][2:])], PROBES), spark.createDataFrame(events, EVENTS)
    limits, gate = B.Limits(unknown_bias=-3.0), Q.Gate(exit_count=2, strong_exit=99.0, least_probes=2)
    got = Q.quarantined(p.withColumn("visible", F.lit("y")), e, "session_id", "at", limits, gate)
    assert got.count() == 120
    for s in (None, 1):
        state, want = Q.State(), []
        rows = sorted([(r[1], 1, r) for r in probes if r[0] == s] + [(r[1], 0, r) for r in events if r[0] == s], key=lambda r: r[:2])
        for _, kind, r in rows:
            values = (True, *[None] * 5, *r[2:6]) if kind == 0 else (False, *r[2:7], *[None] * 4)
            row = Q.moved(state, r[1], *values, limits=limits, gate=gate)
            want += [] if row is None else [row]
        found = got.filter(F.col("session_id").eqNullSafe(F.lit(s))).orderBy("at").collect()
        assert [tuple(r)[2:] for r in found] == want
    assert any(r.quarantine for r in found) and {r.action for r in found} >= {"acquire", "clear", "hold"} and {r.reason for r in found} == {"normalized", "quarantine", "non_probe"}
    assert Q.quarantined(p.limit(0), e, "session_id", "at").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_over_sessions(spark, seed):
    rng = random.Random(seed)
    rows = [(s, k, rng.choice([None, rng.uniform(-1, 2)]), 7) for s in (1, None) for k in range(50)]
    df = spark.createDataFrame(rows, "session_id long, k long, x double, count long").drop("count").repartition(3)
    moments, sums = Q.running_moments(df, "session_id", ["k"], "x"), Q.running_sums(df, "session_id", ["k"], "x", alert=0.5)
    for s in (1, None):
        m, total, want = Q.Moments(), 0.0, []
        for _, k, x, _ in (r for r in rows if r[0] == s):
            if x is not None:
                m.update(x, 0.16)
            total = max(0.0, 0.86 * total + (x or 0.0) - 0.12)
            want.append((k, m.count, m.mean, m.variance, total, total >= 0.5))
        mine = F.col("session_id").eqNullSafe(F.lit(s))
        got = [(*a[1:], *b[2:]) for a, b in zip(moments.filter(mine).orderBy("k").collect(), sums.filter(mine).orderBy("k").collect())]
        assert got == want
    assert Q.running_sums(df.limit(0), "session_id", ["k"], "x").collect() == []


def test_the_query_quarantines(spark, sf_dir):
    rows = plans.quarantine_filter(spark, sf_dir).collect()
    assert {r.action for r in rows} == {"acquire", "hold", "switch", "clear", "none"} and any(r.quarantine for r in rows) and any(r.visible != r.proposed for r in rows)
