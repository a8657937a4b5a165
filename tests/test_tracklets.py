"""Temporary identities: hand-made sessions, and the stream against the batch. The queries are held against recursive SQL."""

import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.operators import tracklets as T
from turnloom.plans import tracklets as plans
from turnloom.streaming import tracklets as stream

SCHEMA = "session_id long, at long, due boolean, release boolean, speech boolean, short array<double>, long array<double>, profiles map<string,array<double>>, base string, base_action string, base_reason string"
A, B, C = np.eye(3)


def walked(probes, limits=T.Limits(), state=None):
    state = state or T.State()
    return [T.step(state, p, limits) for p in probes]


def voice(at, v, long=None, **more):
    return T.Probe(at, short=v, long=v if long is None else long, **more)


def test_two_probes_in_a_row_make_a_name():
    got = walked([voice(0, A), voice(400, A), voice(800, A), voice(1200, B), voice(1600, B), voice(2000, A)])
    assert [g[:5] for g in got] == [
        (None, "none", "open_set_pending_unknown", False, False), ("LIVE_TRACKLET_1", "acquire", "open_set_tracklet_confirmed", True, True), ("LIVE_TRACKLET_1", "hold", "open_set_tracklet_reuse", True, False),
        (None, "clear", "open_set_pending_unknown", False, False), ("LIVE_TRACKLET_2", "acquire", "open_set_tracklet_confirmed", True, True), ("LIVE_TRACKLET_1", "switch", "open_set_tracklet_reuse", True, False),
    ]
    # too late, too unlike, or with silence between, the second probe is a first one again
    assert walked([voice(0, A), voice(1201, A)])[-1][2] == walked([voice(0, A), voice(400, B)])[-1][2] == "open_set_pending_unknown"
    assert walked([voice(0, A), T.Probe(200, speech=False), voice(400, A)])[-1][2] == "open_set_pending_unknown"
    assert walked([voice(0, A), voice(1200, A)])[-1][4]


def test_a_voice_expires_but_keeps_its_name():
    state = T.State()
    walked([voice(0, A), voice(400, A)], state=state)
    assert walked([voice(8400, A)], state=state)[0][2] == "open_set_tracklet_reuse"
    late = walked([voice(16_401, A), voice(16_801, A)], state=state)
    assert late[0][2] == "open_set_pending_unknown" and late[1][0] == "LIVE_TRACKLET_2" and late[1][5] == 2
    full = walked([voice(0, A), voice(400, A), voice(800, B), voice(1200, B)], T.Limits(most=1))
    assert full[-1][:3] == (None, "none", "open_set_tracklet_capacity") and full[-1][5] == 1


def test_a_profile_takes_over_the_name_until_it_goes():
    state = T.State()
    walked([voice(0, A), voice(400, A), voice(800, B), voice(1200, B)], state=state)
    known = {"P": A}
    (shown, _, _, temporary, _, _, aliases), *_ = walked([voice(1600, C, release=True, profiles=known, base="P", reason="r")], state=state)
    assert (shown, temporary) == ("LIVE_TRACKLET_1", True) and [(a[0], a[1], a[2], a[4]) for a in aliases] == [(1, "P", "LIVE_TRACKLET_1", False)]
    # long after the voice fell silent the profile is still shown under its name
    assert walked([T.Probe(60_000, due=False, profiles=known, base="P")], state=state)[0][0] == "LIVE_TRACKLET_1"
    gone = walked([T.Probe(60_400, due=False, profiles={}, base="P", action="hold")], state=state)[0]
    assert gone[0] == "P" and gone[6] == [(2, "P", "LIVE_TRACKLET_1", -1.0, True)]
    # a profile is bound when it is published first, not when it comes back
    assert walked([T.Probe(60_800, profiles=known, base="P")], state=state)[0][6] == []
    # of several new ones the first by name has the choice; what is left is too far from the others
    more = {**known, "Q": 0.6 * A + 0.8 * B, "R": B, "S": -A}
    assert [(a[1], a[2]) for a in walked([T.Probe(61_200, profiles=more)], state=state)[0][6]] == [("Q", "LIVE_TRACKLET_2")]


def test_known_voices_and_contradictions():
    known = {"P": A, "Q": B}
    base = dict(profiles=known, base="P", action="hold", reason="posterior")
    assert walked([voice(0, A, **base)])[0][:3] == ("P", "acquire", "posterior")
    mixed = np.array([0.3, 0.0, 0.95])
    assert walked([voice(0, mixed, **base)])[0][2] == "posterior"  # above the ceiling for novelty
    doubting = T.Limits(contradiction_profiles=2)
    first, second = walked([voice(0, mixed, **base), voice(400, mixed, **base | {"base": None})], doubting)
    assert first[:3] == (None, "none", "open_set_pending_unknown") and second[0] == "LIVE_TRACKLET_1"
    assert walked([voice(0, mixed, **base)], T.Limits(contradiction_profiles=3))[0][0] == "P"
    # a temporary voice is not used again where a profile is closer
    state = T.State()
    walked([voice(0, mixed), voice(400, mixed)], state=state)
    assert walked([voice(800, T.unit(A + mixed), **base)], state=state)[0][2] == "posterior"


def test_vectors_without_a_direction():
    assert T.unit([0.0, 0.0]) is T.unit(None) is T.unit([1.0, None]) is T.unit([float("nan")]) is None
    assert T.cosine(A, np.ones(2)) == T.cosine(None, A) == -1.0
    assert walked([voice(0, np.zeros(3)), voice(400, [1.0, 2.0]), voice(800, A)])[-1][2] == "open_set_pending_unknown"


def made(sessions, n, seed=3):
    rng, rows = random.Random(seed), []
    for s in sessions:
        at = 0
        for k in range(n):
            at += rng.choice([400, 400, 400, 900, 9000]) if k % 6 == 0 else 400
            v = [rng.gauss(0, 0.25) + (2 if d == k // 6 % 4 else 0) for d in range(4)]
            w = [rng.gauss(0, 0.25) + (2 if d == k // 6 % 4 else 0) for d in range(4)]
            profiles = {p: [float(d == i) + 0.1 for d in range(4)] for i, p in enumerate("PQ") if n // 3 * (i + 1) < k < n - 4 * i}
            rows.append((s, at, rng.random() > 0.1 or None, rng.random() > 0.95, rng.random() > 0.05, v if rng.random() > 0.05 else None, w if rng.random() > 0.2 else None, {**profiles, "none": None} if k % 5 else None if not profiles else profiles, rng.choice(["P", "Q", None]) if profiles else None, "hold", rng.choice(["x", None])))
    return rows


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = made([None, 1], 60)
    df = spark.createDataFrame([*rows, (1, None, *rows[0][2:])], SCHEMA)
    got = T.shown(df.withColumn("visible", F.lit("x")).withColumn("_due", F.lit(1)), "session_id", "at")
    assert got.columns[:4] == ["session_id", "at", "visible", "action"] and got.count() == 120
    for s in (None, 1):
        state = T.State()
        want = [T.moved(state, *r[1:], T.Limits()) for r in rows if r[0] == s]
        found = got.filter(F.col("session_id").eqNullSafe(F.lit(s))).orderBy("at").collect()
        assert [tuple(r)[2:8] for r in found] == [w[:6] for w in want] and [[a.asDict() for a in r.aliases] for r in found] == [w[6] for w in want]
        assert {r.reason for r in found} >= {"open_set_pending_unknown", "open_set_tracklet_confirmed", "open_set_tracklet_reuse"}
    assert T.shown(df.limit(0), "session_id", "at").collect() == []


def test_stream_keeps_its_voices_between_batches(spark, tmp_path):
    df = spark.createDataFrame(made(range(3), 90, seed=7), SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("at") / 1000 + 1_000_000))
    source, limits = str(tmp_path / "in"), T.Limits(contradiction_profiles=2)

    def more(low, high):
        df.filter(f"at >= {low} AND at < {high}").coalesce(1).write.mode("append").parquet(source)
        out = stream.shown(spark.readStream.schema(df.schema).parquet(source), "session_id", "at", "ts", limits=limits)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    for low, high in ((0, 12_000), (12_000, 30_000), (30_000, 10**9)):  # each time the query starts again from its checkpoint
        more(low, high)
    alias = F.transform("aliases", lambda a: F.concat_ws(" ", a["generation"].cast("string"), a["profile"], a["name"], F.initcap(a["retired"].cast("string"))))
    want = T.shown(df, "session_id", "at", limits).withColumn("aliases", alias)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert got.filter("size(aliases) > 0").count() > 0


def test_the_queries_reach_every_reason(spark, sf_dir):
    reasons = {r.reason for r in plans.open_set_tracklets(spark, sf_dir).select("reason").distinct().collect()}
    assert reasons == {"base", "open_set_pending_unknown", "open_set_tracklet_confirmed", "open_set_tracklet_reuse"}
    assert "open_set_tracklet_capacity" in {r.reason for r in plans.contradicted_profiles(spark, sf_dir).select("reason").distinct().collect()}
    assert {r.retired for r in plans.tracklet_aliases(spark, sf_dir).select("retired").distinct().collect()} == {True, False}
