"""The Bayesian filter: a plain forward pass, hand-made sessions, and the stream against the batch. Two queries are held against SQL."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators import bayes as B
from turnloom.plans import bayes as plans
from turnloom.streaming import bayes as stream

A, C, D = np.eye(3)
PROBES = "session_id long, at long, due boolean, release boolean, speech boolean, short array<double>, long array<double>, speaker string"
EVENTS = "session_id long, at long, speaker string, generation int, centroid array<double>, seconds double, due boolean"


def known(**profiles):
    state = B.State()
    for name, v in profiles.items():
        B.publish(state, name, 1, v, 2.0, B.Limits())
    return state


def walked(state, probes, limits=B.Limits()):
    return [(state.visible, *out[1:3]) for p in probes if (out := B.step(state, p, limits))]


def sees(at, v, long=None, **more):
    return B.Probe(at, vectors=(v, v if long is None else long), **more)


def test_probabilities_equal_a_plain_forward_pass():
    """Log-linear filtering over a set of states that grows, written with arrays over all names."""
    rng, limits = np.random.default_rng(5), B.Limits(unknown_bias=0.3, bias_slope=0.2, stay=0.85, prior=0.6, evidence=0.9, unknown_release=99)
    names, centroids = ["a", "b", "c"], [v / np.linalg.norm(v) for v in rng.normal(size=(3, 8))]
    state, log_post = B.State(), {B.UNKNOWN: 0.0}
    for k in range(60):
        if k % 15 == 0 and k // 15 < 3:
            B.publish(state, names[k // 15], 1, centroids[k // 15], 1.0, limits)
            log_post = {**log_post, names[k // 15]: math.log(1e-9)}
        present = [B.UNKNOWN, *names[: min(3, k // 15 + 1)]]
        v, w = (x / np.linalg.norm(x) for x in (centroids[k // 7 % 3] + 0.4 * rng.normal(size=(2, 8))))
        B.step(state, B.Probe(k * 400, vectors=(v, w)), limits)
        sims = np.array([0.5 * (v + w) @ centroids[names.index(n)] for n in present[1:]])
        logits = np.append((0.25 - sims.max()) / 0.075 + 0.3 + 0.2 * math.log(len(sims)), (sims - 0.25) / 0.075)
        evidence = logits - np.logaddexp.reduce(logits)
        prior = np.exp([log_post[n] for n in present])
        prior = np.maximum(prior, 1e-9 if k in (0, 15, 30) else 0)
        prior /= prior.sum()
        moved = 0.85 * prior + 0.15 * (1 - prior) / (len(present) - 1)
        joint = 0.9 * np.maximum(evidence, math.log(1e-12)) + 0.6 * np.log(moved)
        log_post = dict(zip(present, joint - np.logaddexp.reduce(joint)))
        assert all(abs(state.posterior[n] - math.exp(p)) < 1e-9 for n, p in log_post.items())


def test_gates_and_debounces():
    state = known(P=A, Q=C)
    assert walked(state, [sees(0, A), sees(400, A), sees(800, C), B.Probe(1200, due=False), B.Probe(1600, speech=False)]) == [
        ("P", "acquire", "bayes_posterior"), ("P", "hold", "bayes_posterior"), ("Q", "switch", "bayes_posterior"), ("Q", "hold", "non_probe_tick"), ("Q", "hold", "probe_gate_silence"),
    ]
    assert walked(state, [sees(2000, D), sees(2400, D)]) == [("Q", "hold", "bayes_unknown_debounce"), (None, "clear", "bayes_unknown")]
    walked(state, [sees(2800, A)])
    assert walked(state, [B.Probe(3200), B.Probe(3600)]) == [("P", "hold", "unknown_debounce"), (None, "clear", "unknown")] and state.posterior == {B.UNKNOWN: 1.0}
    walked(state, [sees(4000, A)])
    assert walked(state, [B.Probe(4400, release=True), B.Probe(4800, release=True, due=False), B.Probe(5200, release=True)]) == [("P", "hold", "release_debounce"), (None, "clear", "release_gate"), (None, "none", "release_gate")]
    # both windows have to agree for who is shown to be seen again
    state = known(P=A, Q=C)
    assert walked(state, [sees(0, A, np.array([0.8, 0.0, 0.6])), sees(400, A, np.array([0.8, 0.0, 0.6]))], B.Limits(hold_agreement=0.9))[1][2] == "bayes_unknown_debounce"


def test_profiles_are_renewed_by_generation():
    state, limits = known(P=A), B.Limits(history=2, history_weight=0.5)
    assert B.publish(state, "P", 0, C, 9.0, limits) is None and B.publish(state, "P", 1, C, 9.0, limits) == "P"
    p = state.profiles["P"]
    assert p.generation == 1 and len(p.history) == 2 and B.similarity(A, p, limits) == 0.5 and B.similarity(C, p, limits) == 1.0
    B.publish(state, "P", 5, D, 1.0, limits)
    assert [h.tolist() for h in p.history] == [A.tolist(), C.tolist()] and len(state.profiles["P"].history) == 2


def test_fused_similarities():
    near = (A + C) / np.sqrt(2)
    state = known(P=A, Q=C)
    assert B.fused(state, (A, C), B.Limits(short_weight=3.0)) == {"P": 0.75, "Q": 0.25}
    assert B.fused(state, (A, C), B.Limits(short_weight=0.0, long_weight=0.0)) == {"P": 0.5, "Q": 0.5}
    sharp = B.fused(state, (A, near), B.Limits(confidence_power=1.0, confidence_floor=0.0))
    assert abs(sharp["P"] - 1) < 1e-12 and abs(sharp["Q"]) < 1e-12  # the long window does not tell them apart
    cohort = B.fused(known(P=A, Q=near, R=D), (A,), B.Limits(cohort_mean=1.0, cohort_max=0.5))
    assert abs(cohort["P"] - (1 - 0.5 * near[0] - 0.5 * near[0])) < 1e-12


def test_a_crossing_is_seen_in_the_short_window_first():
    limits = B.Limits(crossover_margin=0.5, crossover_count=2, evidence=0.0)
    state = known(P=A, Q=C)
    walked(state, [sees(0, A)])
    assert [w[0] for w in walked(state, [sees(400, C, A), sees(800, C, A)], limits)] == ["P", "Q"] and state.posterior["Q"] > 0.99
    state = known(P=A, Q=C)
    walked(state, [sees(0, A)])
    assert [w[0] for w in walked(state, [sees(400, C, A), B.Probe(600, due=False), sees(800, C, A)], limits)] == ["P", "P", "P"]


def test_continuity_holds_who_is_shown():
    tilted = np.array([0.2, 0.0, math.sqrt(0.96)])
    for threshold, reason in ((0.1, "incumbent_continuity"), (0.5, "bayes_unknown_debounce"), (None, "bayes_unknown_debounce")):
        assert walked(known(P=A), [sees(0, A), sees(400, tilted)], B.Limits(continuity=threshold))[1][2] == reason


def test_provisional_profiles():
    limits = B.Limits(provisional=True, expiry_ms=5000, update_alpha=0.5, reactivation=0.9)
    state = B.State()
    assert walked(state, [sees(0, A), sees(400, A)], limits) == [(None, "none", "unknown"), ("provisional_1", "acquire", "provisional_acquire")]
    assert state.posterior["provisional_1"] > 0.99
    tilted = np.array([0.8, 0.6, 0.0])
    walked(state, [sees(800, tilted)], limits)  # it moves half way
    assert np.allclose(state.profiles["provisional_1"].centroid, (A + tilted) / np.linalg.norm(A + tilted)) and state.profiles["provisional_1"].seen == 800
    # two unlike probes make none, silence between neither
    strict = B.Limits(provisional=True, consistency=0.5)
    assert walked(B.State(), [sees(0, A), sees(400, C)], strict)[1][0] is None and walked(B.State(), [sees(0, A), B.Probe(200, speech=False), sees(400, A)], strict)[2][0] is None
    # a published profile that sounds like it takes its place under its name; another one does not
    assert B.publish(state, "P", 3, A, 9.0, limits) == "provisional_1" and not state.profiles["provisional_1"].provisional and state.aliases == {"P": "provisional_1"}
    assert B.publish(state, "Q", 1, D, 9.0, limits) == "Q" and B.publish(state, "P", 4, D, 9.0, limits) == "provisional_1"
    state = B.State()
    walked(state, [sees(0, A), sees(400, A)], limits)
    assert B.step(state, B.Probe(5399, due=False), limits)[-1] == [] and state.visible == "provisional_1"
    assert B.step(state, B.Probe(5400, due=False), limits)[-1] == ["provisional_1"] and state.visible is None and state.posterior == {B.UNKNOWN: 1.0}
    state = B.State()
    walked(state, [sees(0, A), sees(400, A)], limits)
    B.publish(state, "Q", 1, -A, 1.0, limits)
    out = walked(state, [sees(800, A), sees(1200, A)], B.Limits(provisional=True, reactivation=0.9, ceiling=2.0, min_known=2.0))
    assert out[1][0] == "provisional_1" and state.created == 1


def made(sessions, n=80, seed=3):
    rng, probes, events = random.Random(seed), [], []
    for s in sessions:
        for k in range(n):
            voice = k // 9 % 4
            v, w = ([rng.gauss(0, 0.3) + (2 if d == voice else 0) for d in range(4)] for _ in range(2))
            probes.append((s, 400 * k + (9000 if k > 50 else 0), rng.random() > 0.1 or None, rng.random() > 0.95, rng.random() > 0.05, v if rng.random() > 0.05 else None, w if rng.random() > 0.2 else None, "x"))
        for k, (name, voice) in enumerate((("P", 0), ("Q", 1), ("P", 2), (None, 1), ("R", None))):
            events.append((s, 400 * (15 + 12 * k), name, k, [float(d == voice) + 0.1 for d in range(4)] if voice is not None else None, 3.0, True))
    return probes, events


LOOSE = B.Limits(provisional=True, ceiling=0.6, min_similarity=0.5, update_alpha=0.2, expiry_ms=6000, continuity=0.8, history=2, history_weight=0.3, reactivation=0.8)


def test_nulls_empty_tables_and_clashing_columns(spark):
    probes, events = made([None, 1])
    p, e = spark.createDataFrame([*probes, (1, None, *probes[0][2:])], PROBES), spark.createDataFrame(events, EVENTS)
    for limits in (B.Limits(), LOOSE):
        got = B.tracked(p.withColumn("visible", F.lit("y")).withColumn("_event", F.lit(1)), e, "session_id", "at", limits)
        assert got.columns[:3] == ["session_id", "at", "visible"] and got.count() == 160
        for s in (None, 1):
            state, want = B.State(), []
            rows = sorted([(r[1], 1, r) for r in probes if r[0] == s] + [(r[1], 0, r) for r in events if r[0] == s], key=lambda r: r[:2])
            for _, kind, r in rows:
                row = B.moved(state, r[1], True, *[None] * 5, *r[2:6], limits) if kind == 0 else B.moved(state, r[1], False, *r[2:7], *[None] * 4, limits)
                want += [] if row is None else [row]
            found = got.filter(F.col("session_id").eqNullSafe(F.lit(s))).orderBy("at").collect()
            assert [tuple(r)[2:] for r in found] == want
    assert {r.reason for r in found} >= {"bayes_posterior", "provisional_acquire", "incumbent_continuity"} and any(r.expired for r in found)
    assert B.tracked(p.limit(0), e, "session_id", "at").collect() == [] and B.tracked(p, e.limit(0), "session_id", "at").filter("visible IS NOT NULL").count() == 0


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    probes, events = made(range(3), seed=6)
    p, e = (spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("at") / 1000 + 1_000_000)) for rows, schema in ((probes, PROBES), (events, EVENTS)))
    for low, high in ((0, 8000), (8000, 20_000), (20_000, 10**9)):  # each time the query starts again from its checkpoint
        for df, name in ((p, "p"), (e, "e")):
            df.filter(f"at >= {low} AND at < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        live = [spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for df, name in ((p, "p"), (e, "e"))]
        out = stream.tracked(*live, "session_id", "at", "ts", limits=LOOSE)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.session_id, r.at): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = B.tracked(p, e, "session_id", "at", LOOSE).collect()
    assert len(got) == len(want) == 240
    for w in want:
        g = got[w.session_id, w.at]
        assert (g.visible, g.candidate, g.action, g.reason, g.profiles, g.expired) == (w.visible, w.candidate, w.action, w.reason, w.profiles, w.expired)
        assert dict(zip(g.names, g.probabilities)) == w.probabilities


def test_the_queries_reach_every_branch(spark, sf_dir):
    rows = plans.tracker_default(spark, sf_dir).collect()
    assert {r.reason for r in rows} == {"bayes_posterior", "bayes_unknown", "bayes_unknown_debounce", "non_probe_tick", "probe_gate_silence", "release_gate", "release_debounce", "unknown", "unknown_debounce"}
    assert {r.action for r in rows} == {"acquire", "hold", "switch", "clear", "none"}
    loose = plans.provisional_tracker(spark, sf_dir).collect()
    assert Counter(r.reason for r in loose)["provisional_acquire"] > 5 and any(r.expired for r in loose)


def test_profiles_meet_the_probes_of_their_session(spark, tmp_path):
    """Both tables are dealt by session before; of each, adaptive execution merges small partitions by its own sizes."""
    probes = [(s, 400 * k, True, False, True, [1.0, 0.1], [1.0, 0.1]) for s in range(60) for k in range(40)]
    spark.createDataFrame(probes, "session_id long, at long, due boolean, release boolean, speech boolean, short array<double>, long array<double>").write.parquet(f"{tmp_path}/probes")
    dealt = lambda: spark.read.parquet(f"{tmp_path}/probes").withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("at")))
    events = dealt().filter("place = 1").select("session_id", "at", F.lit("A").alias("speaker"), F.lit(1).alias("generation"), F.array(F.lit(1.0), F.lit(0.0)).alias("centroid"), F.lit(2.0).alias("seconds"))
    out = B.tracked(dealt(), events, "session_id", "at")
    assert "xxhash64(_session" in out._jdf.queryExecution().executedPlan().toString()
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        assert {r.visible for r in out.collect()} == {"A"}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
