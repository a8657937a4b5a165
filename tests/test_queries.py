"""Every query outside the optional subpackage against its SQL in DuckDB, and hand-made cases."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from turnloom.functions import speech
from turnloom.functions import text as T
from turnloom.operators import reports, retrieval, sequence
from turnloom.plans import registry
from turnloom.plans.views import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*names).collect())
    result = duck.execute(registry.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in result.fetchall())


def test_every_query_runs(spark, sf_dir):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf_dir).count() > 0


def test_chunks_hold_every_row_within_bounds(spark):
    rows = [(1, k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate([50, 60, 90, 10, 400, 1, 0, 170])] + [(2, 0, "only one"), (3, 0, None)]
    chunks = retrieval.chunks(spark.createDataFrame(rows, "session_id long, idx long, text string"), "session_id").collect()
    one = [c for c in chunks if c.session_id == 1]
    assert {i for c in one for i in range(c.first_idx, c.last_idx + 1)} == set(range(8))
    assert all(c.words <= retrieval.MOST_WORDS for c in chunks)
    assert {w for c in one for w in c.text.split()} == {w for s, _, t in rows if s == 1 for w in (t or "").split()}
    assert [c.text for c in chunks if c.session_id == 2] == ["only one"]


def test_hash_embedding_of_rows_without_tokens(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k long, tokens array<string>")
    out = {r.k: r.embedding for r in retrieval.hash_embedding(rows, "k", "tokens").collect()}
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-12
    assert out[2] == out[3] == [0.0] * retrieval.DIMENSIONS


def test_text_expressions(spark):
    df = spark.createDataFrame([("A b. A b.", "https://youtu.be/abc-1?x", "Done by Friday, then")], "t string, u string, d string")
    r = df.select(T.is_repeated_phrase(F.col("t")).alias("r"), T.video_id(F.col("u")).alias("v"), T.due_hint(F.col("d")).alias("d"), T.slug(F.lit(" Ab--c! ")).alias("s")).first()
    assert (r.r, r.v, r.d, r.s) == (True, "abc-1", "by Friday", "ab-c")


def test_cues(spark):
    rows = [(1, 0, "We decided. I will follow up, ok?"), (1, 1, "There are 20% of them"), (1, 2, None), (2, 0, "nothing here, undecided"), (2, 1, "A blocker"), (3, 0, "Das ist offen, BITTE"), (3, 1, "final 7 were")]
    out = reports.cue_objects(spark.createDataFrame(rows, "session_id long, idx long, text string"), "session_id").collect()
    assert {(r.session_id, r.idx, r.type) for r in out} == {(1, 0, "decision"), (1, 0, "action_item"), (1, 0, "open_question"), (1, 1, "claim"), (2, 1, "risk"), (3, 0, "open_question"), (3, 0, "action_item"), (3, 1, "decision")}
    many = spark.createDataFrame([(None, k, "a risk") for k in range(20)], "session_id long, idx long, text string")
    assert sorted(r.number for r in reports.cue_objects(many, "session_id").collect()) == [1, 2, 3, 4, 5, 6]


def test_promotional_outro(spark):
    schema = "session_id long, idx long, speaker string, text string, duration_ms long, outro string"
    ad, talk = "please subscribe", "hello"

    def fixed(*rows, **options):
        df = spark.createDataFrame([(1, k, speaker, text, ms, "x") for k, (speaker, text, ms) in enumerate(rows)], schema)
        out = sequence.promotional_outro(df.drop("outro"), "session_id", speech.promotional(F.col("text")), **options).orderBy("idx").collect()
        return [r.fixed for r in out]

    assert fixed(("A", talk, 5000), ("B", talk, 1), ("C", ad, 12_000)) == ["A", "B", "A"]
    assert fixed((None, talk, 9000), ("A", talk, 5000), ("C", ad, None)) == [None, "A", "A"]  # the first row with a label counts
    assert fixed(("A", talk, 4999), ("C", ad, 1)) == ["A", "C"]  # said too little
    assert fixed(("A", talk, 9000), ("C", ad, 12_001)) == ["A", "C"]  # lasts too long
    assert fixed(("A", talk, 9000), ("C", ad, 1), ("C", talk, 1)) == ["A", "C", "C"]  # heard elsewhere
    assert fixed(("A", talk, 9000), ("C", ad, 1), ("B", talk, 1), ("B", talk, 1)) == ["A", "C", "B", "B"]  # not at the end
    assert fixed(("A", talk, 9000), ("C", ad, 1), ("D", ad, 1)) == ["A", "A", "A"]
    assert fixed(("A", ad, 9000)) == ["A"] and fixed(("A", talk, 9000), (None, ad, 1)) == ["A", None]
    nulls = spark.createDataFrame([(None, 0, "A", talk, 6000, "x"), (None, 1, "B", ad, 5, "x"), (2, 0, "B", ad, 5, "x")], schema).drop("outro")
    assert [tuple(r)[-2:] for r in sequence.promotional_outro(nulls, "session_id", speech.promotional(F.col("text"))).orderBy("session_id", "idx").collect()] == [(False, "A"), (True, "A"), (False, "B")]
    assert sequence.promotional_outro(nulls.limit(0), "session_id", speech.promotional(F.col("text"))).count() == 0


def test_ticks_that_are_not_shown(spark, tmp_path):
    """Holds of nothing, of null and below 0 give no slice, so no profile is known by them; a turn without a name wins no tie."""
    turns = [(1, 0, "user", 25), (2, 0, "user", 15), (3, 0, None, 25), (3, 1, "user", 25), (4, 0, "user", 25)]
    values = {1: [0.0, 4.0], 2: [None, 4.0], 3: [4.0, 0.0, None, 0.0, 0.0, 0.0, 4.0], 4: [-3.0, 4.0]}
    events = [(10 * s + k, dt.datetime(2024, 1, 1, 0, 0, k), s, "view", v) for s, row in values.items() for k, v in enumerate(row)]
    spark.createDataFrame([(s, k, role, "x" * n) for s, k, role, n in turns], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    known = registry.queries()["profile_availability"](spark, str(tmp_path)).collect()
    assert {(r.session_id, r.idx): r.availability for r in known} == {(1, 0): "becomes_known_during_turn", (2, 0): "never", (3, 0): "never", (3, 1): "known_at_turn_start", (4, 0): "becomes_known_during_turn"}
    con = duckdb.connect()
    for t in ("conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("profile_availability", "profile_map", "merged_speech", "missed_speech", "session_scorecard", "atomic_speakers"):
        want = con.execute(registry.oracle_sql()[name])
        got = registry.queries()[name](spark, str(tmp_path)).select(*(d[0] for d in want.description))
        assert sorted("|".join(map(plain, r)) for r in got.collect()) == sorted("|".join(map(plain, r)) for r in want.fetchall()), name
