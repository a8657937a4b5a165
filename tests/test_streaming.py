"""Streams give the rows of their batch counterparts; trace files are read in all their shapes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from turnloom.operators import live
from turnloom.plans.live import revisions
from turnloom.sources import traces
from turnloom.streaming import live as stream


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """Revisions in six files, in order of their ids, and the batch DataFrame of the same rows."""
    rows = revisions(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") / 10))
    path = str(tmp_path_factory.mktemp("revisions"))
    most = rows.agg(F.max("event_id")).first()[0]
    for k in range(6):
        rows.filter((F.col("event_id") * 6 / (most + 1)).cast("int") == k).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive
    return df.sparkSession.table(name)


def source(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def spelled(df):
    return sorted(map(str, df.collect()))


def test_sentence_events(spark, files):
    path, batch = files
    keys = ["session_id", "sentence"]
    want = live.with_previous(batch, keys, ["event_id"], ["pending", "speaker"]).withColumn("events", live.sentence_events())
    got = run(stream.sentence_events(source(spark, path), keys, "event_id", "ts"), "sentence_events")
    names = ["session_id", "sentence", "event_id", "previous_pending", "previous_speaker", "seen", "events"]
    assert spelled(got.select(names)) == spelled(want.select(names)) and got.count() == batch.count()


def test_stale_and_repeated_rows_are_dropped(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "k long, place long, speaker string, pending boolean, revision long, ts timestamp"
    for part in ([(1, 2, "A", False, 0), (1, 2, "B", False, 0)], [(1, 1, "C", False, 0), (1, 3, None, False, 0)]):
        spark.createDataFrame([(*r, at) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = run(stream.sentence_events(source(spark, str(tmp_path)), ["k"], "place", "ts"), "stale")
    assert [(r.place, r.events) for r in got.orderBy("place").collect()] == [(2, ["final", "speaker_assigned"]), (3, ["speaker_revised", "speaker_cleared"])]


def test_windows_and_sessions(spark, files):
    path, batch = files
    keys = ["session_id"]
    want = live.speech_sessions(batch, keys, "ts", "3 seconds")
    got = run(stream.speech_sessions(source(spark, path), keys, "ts", "3 seconds", late="1 second"), "sessions", "append")
    closed = batch.agg(F.max("ts")).first()[0] - dt.timedelta(seconds=1)
    assert spelled(got) == spelled(want.filter(F.col("end") <= F.lit(closed))) != []
    ticks = run(stream.tick_windows(source(spark, path), keys, "ts"), "ticks", "complete")
    edges = {(r.end.timestamp() * 1000) % 400 for r in ticks.collect()}
    assert edges == {0} and ticks.agg(F.sum("rows")).first()[0] >= batch.count()


def test_lease_reasons(spark):
    rows = [(0, 0, None, None, 46), (0, 100, 5, 90, 101), (0, 120, None, None, 121), (0, 900, 0, None, 901), (0, 10, 0, 10, 20)]
    df = spark.createDataFrame(rows, "created_s long, last_seen_s long, run_started_s long, completed_s long, now long")
    assert [r.x for r in df.select(live.lease_end(F.col("now")).alias("x")).collect()] == ["heartbeat timeout", "completed", "idle timeout", "time limit", None]


def test_traces(spark, tmp_path):
    lines = [{"time": 1.5, "event": "live", "payload": {"speaker_id": "S1", "start": 0.5, "extra": 1}}, {"time": 2, "event": "tick", "payload": None}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    rows = traces.read_trace(spark, str(tmp_path / "a.jsonl")).orderBy("time").collect()
    assert [(r.time, r.event) for r in rows] == [(1.5, "live"), (2.0, "tick")] and rows[0].payload.speaker_id == "S1" and rows[1].payload is None
    (tmp_path / "bad.jsonl").write_text('{"time": 1}\n{"time": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        traces.read_trace(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "list.json").write_text(json.dumps([{"speaker": "A", "start": 0, "end": 2, "text": "x"}]))
    (tmp_path / "object.json").write_text(json.dumps({"segments": [{"speaker_id": "B", "start_sec": 3, "end_sec": 5}]}))
    assert [tuple(r) for r in traces.read_segments(spark, str(tmp_path / "list.json")).collect()] == [("A", 0.0, 2.0, "x")]
    assert [tuple(r) for r in traces.read_segments(spark, str(tmp_path / "object.json")).collect()] == [("B", 3.0, 5.0, None)]
