"""Live ticks: hand-made sessions, and the stream against the batch. The queries are held against recursive SQL."""

import random

from pyspark.sql import functions as F

from turnloom.operators import ticks as T
from turnloom.streaming import ticks as stream

SCHEMA = "session_id long, place long, due boolean, release boolean, speech boolean, probabilities map<string,double>, fallback string"


def walked(ticks, limits=T.Limits()):
    state, out = T.State(), []
    for t in ticks:
        _, _, action, reason = T.step(state, t, limits)
        out.append((state.visible, action, reason))
    return out


def sees(name, p=0.9, **more):
    return T.Tick(probabilities={name: p, "unknown": 1 - p}, **more)


def test_acquire_hold_switch_clear():
    blank = T.Tick()
    got = walked([blank, sees("S1"), sees("S1"), sees("S2", 0.95), blank, blank, blank])
    assert got[0] == (None, "none", "unknown") and got[1] == ("S1", "acquire", "known_candidate") and got[2] == ("S1", "hold", "confirmed")
    # S1 is in the mean once since the acquisition: 0.55 of 0.95 is enough, of 0.9 it is not
    assert got[3] == ("S2", "switch", "known_candidate")
    assert got[4:] == [("S2", "hold", "unknown_debounce"), (None, "clear", "unknown"), (None, "none", "unknown")]


def test_totals_are_added_up_as_other_engines_do():
    """22 / 160 and so on: 83 / 160 is 0.51875, and its fifth digit is rounded by the last bit of the total."""
    parts = [22 / 160, 49 / 160, 83 / 160, 6 / 160]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    got = T.smoothed([dict(zip(("S1", "S2", "S3", "unknown"), parts))], 0.55)
    assert [got[k] for k in ("S1", "S2", "S3", "unknown")] == [p / total for p in parts]
    assert int(got["S3"] * 10000 + 0.5) == 5187


def test_gates():
    quiet, gate, off = T.Tick(speech=False), T.Tick(release=True), T.Tick(due=False)
    assert walked([sees("S1"), off, quiet, gate, gate, off, quiet]) == [
        ("S1", "acquire", "known_candidate"), ("S1", "hold", "non_probe_tick"), ("S1", "hold", "probe_gate_silence"), (None, "clear", "release_gate"),
        (None, "none", "release_gate"), (None, "none", "non_probe_tick"), (None, "none", "probe_gate_silence"),
    ]
    assert [a for _, a, _ in walked([sees("S1"), T.Tick(due=False, release=True)])] == ["acquire", "clear"]
    # silence between two ticks of the gate starts the count again, a tick without a probe does not
    two = T.Limits(silence_release=2)
    assert [a for _, a, _ in walked([sees("S1"), gate, quiet, gate, off, gate], two)] == ["acquire", "hold", "hold", "hold", "hold", "clear"]


def test_debounce_counts_one_candidate_in_a_row():
    two = T.Limits(acquire=2, switch=2)
    assert [r for _, _, r in walked([sees("S1"), sees("S1")], two)] == ["candidate_debounce", "known_candidate"]
    # a tick without a vector keeps the candidate, a silent one forgets it
    assert walked([sees("S1"), T.Tick(), sees("S1")], two)[-1][1] == "acquire"
    assert walked([sees("S1"), T.Tick(speech=False), sees("S1")], two)[-1][1] == "none"


def test_candidates_ties_and_fallback():
    assert T.best_known({"S2": 0.5, "S1": 0.5, "unknown": 0.0}, 0.5) == ("S1", 0.5)
    assert T.best_known({"S1": 0.5, "unknown": 0.5}, 0.5) == (None, 0.5)
    assert T.best_known({"S1": 0.4, "unknown": 0.1}, 0.5) == (None, 0.4)
    assert T.best_known({"unknown": 1.0}, 0.5) == (None, None)
    assert walked([sees("S1", 0.2, fallback="S9")]) == [("S9", "acquire", "known_candidate")]
    mean = T.smoothed([{"a": 1.0}, {"b": 1.0}, {"b": 0.5, "a": -1.0}], 0.5)
    assert mean == {"a": 0.25 / 0.75, "b": 0.5 / 0.75}


def made(sessions, n, seed=3):
    rng, rows = random.Random(seed), []
    for s in sessions:
        for k in range(n):
            w = {name: rng.random() + (2 if name == f"S{k // 7 % 3 + 1}" else 0) for name in ("S1", "S2", "S3", "unknown")}
            shares = {name: x / sum(w.values()) for name, x in w.items()} if rng.random() > 0.15 else None
            rows.append((s, k, rng.random() > 0.1, rng.random() > 0.9, rng.random() > 0.1 or None, shares, "S2" if rng.random() > 0.9 else None))
    return rows


def test_nulls_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame(made([None, 1], 30), SCHEMA)
    got = T.shown(df.withColumn("visible", F.lit("x")).withColumn("_due", F.lit(1)), "session_id", ["place"])
    assert got.columns == ["session_id", "place", "visible", "candidate", "known", "action", "reason"] and got.count() == 60
    for s in (None, 1):
        state = T.State()
        want = [T.moved(state, *r[2:], T.Limits()) for r in made([None, 1], 30) if r[0] == s]
        assert [tuple(r)[2:] for r in got.filter(F.col("session_id").eqNullSafe(F.lit(s))).orderBy("place").collect()] == want
    assert T.shown(df.limit(0), "session_id", ["place"]).collect() == []


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    df = spark.createDataFrame(made(range(3), 45), SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("place") + 1_000_000))
    source, limits = str(tmp_path / "in"), T.Limits(acquire=2, switch=3, unknown_release=3)
    for low in (0, 15, 30):
        df.filter(f"place >= {low} AND place < {low + 15}").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = stream.shown(live, "session_id", "place", "ts", limits=limits)
    query = out.writeStream.format("memory").queryName("ticks_out").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("ticks_out").fillna(-1.0, ["known"]).collect())
    want = sorted(tuple(r) for r in T.shown(df, "session_id", ["place"], limits).fillna(-1.0, ["known"]).collect())
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert max(abs(g[4] - w[4]) for g, w in zip(got, want)) < 1e-9
