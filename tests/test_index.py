"""The session index: upserts, deletions and snapshots against an index built anew. Two queries are held against SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom.functions.numbers import quantized
from turnloom.operators import retrieval, vectors
from turnloom.plans import index as plans
from turnloom.sources.index import SessionIndex, listed_sessions, scratch_index

SCHEMA = "session_id long, ordinal long, title string, speaker string, text string, version string"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).drop("version")


def contents(index):
    return sorted((r.chunk_id, r.title, r.speaker, r.text, r.revision_id, [round(x, 9) for x in r.embedding]) for r in index.chunks().collect())


ONE = [(1, 0, "Plan", "Ann", "we plan the release"), (1, 1, "Plan", "Bob", "the release is late"), (2, 0, "Budget", "Ann", "money for the release"), (3, 0, "Lunch", None, None), (None, 0, "x", "y", "lost"), (4, None, "x", "y", "lost")]
TWO = [(1, 0, "Plan", "Ann", "we plan the release"), (1, 1, "Plan", "Bob", "the release is on time"), (1, 2, "Plan", "Ann", "good"), (2, 0, "Budget", "Ann", "money for the release"), (5, 0, "New", "Cy", "")]


def test_search_after_upserts_equals_search_over_a_rebuild(spark):
    index = SessionIndex(spark, scratch_index(spark, "t"), buckets=3)
    index.upsert(chunks(spark, ONE))
    assert index.version == 1 and [c[0] for c in contents(index)] == ["1#0", "1#1", "2#0", "3#0"]
    index.upsert(chunks(spark, TWO))
    gone = spark.createDataFrame([(3,), (99,), (None,)], "session_id long")
    index.delete(gone)
    anew = SessionIndex(spark, scratch_index(spark, "t"), buckets=5)
    anew.upsert(chunks(spark, TWO))
    assert contents(index) == contents(anew) and index.version == 3
    rows = {r.chunk_id: (r.version, r.reused) for r in index.chunks().collect()}
    assert rows == {"1#0": (2, True), "1#1": (2, False), "1#2": (2, False), "2#0": (1, False), "5#0": (2, False)}
    everyone = spark.createDataFrame([(k,) for k in range(6)], "session_id long")
    questions = spark.createDataFrame([(1, "is the release late"), (2, "Bob and the budget"), (3, None)], "query long, text string")
    found = [sorted(map(tuple, i.search(everyone, questions, 3).collect())) for i in (index, anew)]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 2
    assert max((r for r in found[0] if r[0] == 2), key=lambda r: r[2])[1] in ("1#1", "2#0")  # the name and the title count
    assert {r[1].split("#")[0] for r in map(tuple, index.search(everyone.filter("session_id = 2"), questions).collect())} == {"2"}


def test_what_has_not_changed_is_not_written(spark):
    index = SessionIndex(spark, scratch_index(spark, "t"))
    index.upsert(chunks(spark, ONE).limit(0))
    assert index.version == 0 and index.chunks().count() == 0
    index.upsert(chunks(spark, ONE))
    index.upsert(chunks(spark, ONE[:3]).repartition(5))
    index.delete(spark.createDataFrame([(77,)], "session_id long"))
    assert index.version == 1
    # vectors made in another way are not searched until their session is written again
    other = SessionIndex(spark, index.path, identity="other")
    asked = spark.createDataFrame([(1,), (2,), (8,), (None,)], "session_id long")
    assert {tuple(r)[::4] for r in other.state(asked).collect()} == {(1, False), (2, False), (8, False)}
    other.upsert(chunks(spark, ONE[:2]))
    assert {(r.session_id, r.indexed, r.chunks, r.current, r.dimensions) for r in other.state(asked).collect()} == {(1, True, 2, True, 64), (2, True, 1, False, 64), (8, False, 0, False, 0)}
    assert not any(r.reused for r in other.chunks().filter("session_id = 1").collect())


def test_readers_keep_their_snapshot_and_see_no_half_change(spark, monkeypatch):
    index = SessionIndex(spark, scratch_index(spark, "t"), buckets=2)
    index.upsert(chunks(spark, ONE))
    reader, before = index.snapshot(), contents(index)
    real = SessionIndex._publish

    def fails(self, rows, touched):
        monkeypatch.setattr("turnloom.sources.index.json.dumps", lambda *_: (_ for _ in ()).throw(OSError("injected")))
        real(self, rows, touched)

    with monkeypatch.context() as m:
        m.setattr(SessionIndex, "_publish", fails)
        with pytest.raises(OSError):
            index.upsert(chunks(spark, TWO))
    monkeypatch.undo()
    assert contents(index.snapshot()) == before  # written aside, never published
    index.upsert(chunks(spark, TWO))
    assert contents(reader) == before != contents(index) == contents(index.snapshot())


def test_session_list(spark):
    rows = [("Plan A", "2025-01-02", "2026-01-01", ["Ann"], False), ("Plan B", "2025-05-05", None, ["Bob", None], None), ("Old plan", "2024-01-01", "2024-01-02", None, True), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, created_at string, updated_at string, speaker_names array<string>, archived boolean")
    titles = lambda *a: [r.title for r in listed_sessions(df, *a).collect()]
    assert titles() == ["Plan A", "Plan B", None] and titles("archived") == ["Old plan"] and titles("all", "PLAN 01-") == ["Plan A", "Old plan"]
    assert titles("active", "ann") == ["Plan A"] and titles("active", "plan zed") == [] and titles("other") == titles("all")
    assert listed_sessions(df.limit(0)).count() == 0


def search_by_hand(rows, questions, k):
    """The k best of rows {chunk_id: (title, speaker, text)} for each question (query, text), pair by pair."""
    words = {c: re.findall(r"[\w'-]+", (r[2] or "").lower()) for c, r in rows.items()}
    held = Counter(t for ts in words.values() for t in set(ts))
    mean = sum(map(len, words.values())) / len(rows)

    def vector(tokens):
        v = [0.0] * 64
        for t in tokens:
            d = hashlib.sha256(t.encode()).digest()
            v[d[0] % 64] += -1.0 if d[2] % 2 else 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    def bm25(asked, tokens):
        s, tf = 0.0, Counter(tokens)
        for t in sorted(asked & tf.keys()):
            s += math.log(1 + (len(rows) - held[t] + 0.5) / (held[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens) / max(1.0, mean)))
        return s

    rounded = lambda x, digits: math.floor(x * 10**digits + 0.5) / 10**digits
    vectors, out = {c: vector(ts) for c, ts in words.items()}, []
    for query, text in questions:
        tokens, points = re.findall(r"[\w'-]+", (text or "").lower()), Counter()
        lexical = {c: s for c, ts in words.items() if (s := bm25(set(tokens), ts)) > 0}
        near = {c: sum(x * y for x, y in zip(vector(tokens), v)) for c, v in vectors.items()} if tokens else {}
        for scores in (lexical, near):
            for place, c in enumerate(sorted(scores, key=lambda c: (-rounded(scores[c], 6), c))[:30], 1):
                points[c] += 1 / (60 + place)
        for c, names in rows.items():
            points[c] += sum(0.04 for name, n in zip(names, (4, 3)) if name and len(name) >= n and name.lower() in (text or "").lower())
        best = sorted(((-rounded(s, 9), c) for c, s in points.items() if s), key=lambda x: x)[:k]
        out += [(query, c, -s) for s, c in best]
    return sorted(out)


def test_search_query_asks_every_row(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    rows = {f"{r.conv_id}#{r.turn}": (f"Meeting {r.conv_id}", r.role, r.text) for r in turns}
    questions = [(f"{r.conv_id}#{r.turn}", r.text + (" meeting 4, assistant" if r.conv_id % 3 == 0 else "")) for r in turns if (r.conv_id * 100 + r.turn) % 50 == 0]
    got = sorted(map(tuple, plans.index_search(spark, sf_dir).collect()))
    assert got == search_by_hand(rows, questions, 10)
    assert {c for _, c, _ in got} & {c for c in rows if int(c.split("#")[0]) % 2}


def test_search_by_hand_with_long_sessions_and_equal_rows(spark, monkeypatch):
    """Of a long session the rows of a named speaker lead, however late they come; rows and questions come in several blocks."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 11)
    rng = random.Random(3)
    said = [" ".join(rng.choice("plan release late money lunch of the a ü it's".split()) for _ in range(rng.randrange(9))) for _ in range(9)] + [None, "?!"]
    rows = [(s, n, None if s == 3 else f"Talk {s}", rng.choice(["Ann", None, "Al"]) if (s, n) < (0, 80) else "Bob", rng.choice(said)) for s in range(4) for n in range(90 if s == 0 else 20)]
    index = SessionIndex(spark, scratch_index(spark, "t"))
    index.upsert(chunks(spark, rows))
    questions = [(k, t) for k, t in enumerate(["the late plan", "talk 0 by bob", "Talk 0: al and ann", "lunch, bob?", None, "", "zzz", "ü of talk 1 and TALK 2", *said])]
    got = index.search(spark.range(5).withColumnRenamed("id", "session_id"), spark.createDataFrame(questions, "query long, text string"), 4)
    held = {f"{s}#{n}": (title, who, text) for s, n, title, who, text in rows}
    assert sorted(map(tuple, got.collect())) == search_by_hand(held, questions, 4)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_best_words_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    rng = random.Random(4)
    made = [(f"r{k}", [f"w{int(rng.random() ** 3 * 60)}" for _ in range(rng.randrange(12))]) for k in range(500)] + [("n", [None, "w1"]), (None, ["w1"])]
    asked = [(k, [f"w{int(rng.random() ** 2 * 80)}" for _ in range(rng.randrange(8))]) for k in range(30)] + [(40, ["w0", "w0"]), (41, []), (42, ["none"])]
    rows, questions = spark.createDataFrame(made, "id string, tokens array<string>").filter("id IS NOT NULL"), spark.createDataFrame(asked, "q long, tokens array<string>")
    scored = retrieval.bm25(rows, "id", "tokens", questions, "q", "tokens").withColumn("score", quantized(F.col("score")))
    want = sorted(map(tuple, retrieval.top(scored, 7, "id").select("query", "id", "score", "place").collect()))
    for q in (questions, questions.union(questions)):  # a question that comes twice counts once
        assert sorted(map(tuple, retrieval.bm25_top(rows, "id", "tokens", q, "q", "tokens", 7).select("query", "id", "score", "place").collect())) == want
