"""Cases at the edges where operators once did less than the whole job."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import reports, retrieval, vectors
from turnloom.plans import registry
from turnloom.plans import retrieval as plans
from turnloom.plans import sequence


def test_repeated_phrases_of_any_length_and_script(spark):
    cases = [("thank you " * 40, True), ("thank you " * 40 + "all", False), ("été là été là", True), ("über ber", False), ("спасибо вам спасибо вам", True), ("\uff21 b a B", True), ("e\u0301 a \u00e9 a", True), ("it's so it's so", True), ("one", False), ("", False), (None, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.r for r in df.select("k", T.is_repeated_phrase(F.col("t")).alias("r")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_phrase_periods_by_brute_force():
    for n in range(13):
        for code in range(2**n):
            words = [str(code >> i & 1) for i in range(n)]
            for least in (1, 2, 3):
                assert T.repeats_phrase(words, least) == any(words == words[:k] * (n // k) for k in range(least, n // 2 + 1) if n % k == 0)


def test_exact_repeats_keeps_long_lines(spark, tmp_path):
    rows = [(1, "so it goes " * 30), (2, "short one"), (3, "да нет да нет\nплюс")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.lines) for r in sequence.exact_repeats(spark, str(tmp_path)).collect()} == {(1, 1), (3, 1)}


def test_ordered_hash_is_that_of_the_joined_string(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([n, n, n // 300]) - 400, None if rng.random() < 0.05 else f"v{rng.randrange(9)}é") for k in ("a", "b", None) for n in range({"a": 2000, "b": 256, None: 3}[k])] + [("c", 7, None)]
    got = {r.k: (r.digest, r.rows) for r in reports.ordered_sha256(spark.createDataFrame(rows, "k string, at long, v string").repartition(5), "k", "at", "v").collect()}
    for k in ("a", "b", "c", None):
        mine = sorted((at, v or "") for x, at, v in rows if x == k)
        assert got[k] == (hashlib.sha256(",".join(v for _, v in mine if v).encode()).hexdigest(), len(mine))


def test_scope_gathers_no_list_of_sessions(spark, sf_dir):
    df = plans.scope_members(spark, sf_dir)
    assert "collect_" not in df._jdf.queryExecution().toString()
    assert df.count() > 0


def test_sessions_are_read_as_streams(spark, sf_dir):
    for query in (plans.row_revisions, plans.chunk_transcript):
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert "collect_" not in plan and "FlatMapGroupsInPandas" not in plan


def test_a_long_session_is_packed_from_batches(spark):
    rows = [(None if s == 2 else s, k, f"s{s} " + " ".join(f"r{k}w{j}" for j in range(k % 97))) for s in range(3) for k in range(1000)]
    df = spark.createDataFrame(rows, "session_id long, idx long, text string").repartition(7)

    def packed():
        return sorted(map(repr, retrieval.chunks(df, "session_id").collect()))

    whole = packed()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert packed() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chunks = retrieval.chunks(df, "session_id").collect()
    for s in (0, 1, None):
        mine = sorted((c for c in chunks if c.session_id == s), key=lambda c: c.ordinal)
        assert [c.ordinal for c in mine] == list(range(len(mine)))
        assert {w for c in mine for w in c.text.split()} == {w for x, _, t in rows if x == s for w in t.split()}
        assert all(c.words <= retrieval.MOST_WORDS for c in mine)


def test_greedy_map_is_registered_and_one_to_one(spark, sf_dir):
    rows = registry.queries()["greedy_map"](spark, sf_dir).collect()
    assert rows and len(rows) == len({(r.session_id, r.profile) for r in rows}) == len({(r.session_id, r.truth) for r in rows})


def test_nearest_by_brute_force(spark):
    """Ties, copies, nulls, NaN, zero vectors and other lengths; rows are streamed, no task gets a table of pairs."""
    rng = random.Random(8)
    made = [(k, [float(rng.randrange(-2, 3)) for _ in range(4)]) for k in range(300)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [0.0] * 4), (903, [1.0, 2.0]), (904, [float("nan")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(made + odd, "id long, v array<double>").repartition(3)

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        if None in a or None in b:
            return 0.0
        total, aa, bb = 0.0, 0.0, 0.0
        for x, y in zip(a, b):
            total, aa, bb = total + x * y, aa + x * x, bb + y * y
        n = math.sqrt(aa) * math.sqrt(bb)
        return 0.0 if n <= 0 else total / n

    def order(c):
        return (0, 0.0) if c[1] is None else (2, 0.0) if math.isnan(c[1]) else (1, c[1])

    queries = df.filter("id % 50 = 0 OR id IN (902, 904)")
    got = {}
    for r in vectors.nearest(queries, df, 7, "id", "id", "v").collect():
        got.setdefault(r.query, []).append((r.place, r.match, r.similarity))
    rows = [r for r in made + odd if r[0] is not None]
    for q, v in rows:
        if q % 50 and q not in (902, 904):
            continue
        ranked = sorted(((m, cosine(v, w)) for m, w in rows if m != q), key=lambda c: (-order(c)[0], -order(c)[1], c[0]))[:7]
        assert [(m, repr(s)) for _, m, s in sorted(got.pop(q))] == [(m, repr(s)) for m, s in ranked]
    assert not got
    assert "NestedLoop" not in vectors.nearest(queries, df, 7, "id", "id", "v")._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_brute_force_with_ties(spark, monkeypatch):
    """Vectors of one length are first compared by a matrix product; places are those of exact sums."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = random.Random(9)
    made = [(k, [rng.choice([0.0, 0.1, 0.2, -0.3]) * rng.choice([1, 3]) for _ in range(5)]) for k in range(900)]
    df = spark.createDataFrame(made, "id long, v array<double>").repartition(3)

    def cosine(a, b, digits):
        total, aa, bb = 0.0, 0.0, 0.0
        for x, y in zip(a, b):
            total, aa, bb = total + x * y, aa + x * x, bb + y * y
        n = math.sqrt(aa) * math.sqrt(bb)
        s = 0.0 if n <= 0 else total / n
        return s if digits is None else math.floor(s * 10.0**digits + 0.5) / 10.0**digits

    for digits in (None, 2, 6):
        got = sorted((r.query, r.place, r.match, r.similarity) for r in vectors.nearest(df.filter("id % 20 = 0"), df, 9, "id", "id", "v", digits).collect())
        want = []
        for q, v in made[::20]:
            ranked = sorted((-cosine(v, w, digits), m) for m, w in made if m != q)[:9]
            want += [(q, n, m, -s) for n, (s, m) in enumerate(ranked, 1)]
        assert got == want


def test_hashed_vectors_shuffle_no_tokens(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["c"]), (2, []), (3, None), (4, ["\u00e9", "b"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    want = {}
    for k, tokens in rows:
        for t in tokens or ():
            d = hashlib.sha256(t.encode()).digest()
            want.setdefault(k, [0.0] * 64)[d[0] % 64] += -1.0 if d[2] % 2 else 1.0
    out = retrieval.hashed_vectors(df, "k", "tokens")
    for r in out.collect():
        norm = math.sqrt(sum(x * x for x in want[r.k]))
        assert r.embedding == [x / norm for x in want.pop(r.k)]
    assert not want and "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
