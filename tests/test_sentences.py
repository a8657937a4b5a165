"""Sentences of growing windows and of whole transcripts. The queries are held against recursive SQL."""

import random

from pyspark.sql import functions as F

from turnloom.operators import sentences as S
from turnloom.plans import sentences as plans
from turnloom.streaming import sentences as stream

WORDS = "array<struct<text:string,start_ms:long,end_ms:long>>"
SCHEMA = f"session_id long, right_ms long, flush boolean, words {WORDS}, text string"


def said(text, start=0, every=400, last=300):
    return [(w, start + every * i, start + every * i + last) for i, w in enumerate(text.split())]


def heard(words, right):
    return [(t, s, min(e, right)) for t, s, e in words if s < right]


def run(words, windows, limits=S.Limits()):
    state, out = S.State(), []
    for right, flush in windows:
        out += S.step(state, right, flush, heard(words, right), limits)
    return out, state


def test_a_sentence_waits_for_a_word_and_the_tail():
    words = said("so it is. then more came. and")
    assert not run(words, [(1100, False)])[0]  # no word follows
    assert not run(words, [(1100 + S.Limits().tail - 1, False)])[0]  # the tail is unstable
    (row,), state = run(words, [(1100 + S.Limits().tail, False)])
    assert row == (0, "So it is.", 0, 1160, 0, 1100, 1200, 3, 900, "gap_ratio", 0, 2450)
    assert (state.left, state.ended, state.count) == (1160, True, 1)
    # later windows give the rest once; a flush takes what has no end too
    out, state = run(words, [(2450, False), (2450, False), (3000, False), (3100, True)])
    assert [r[1] for r in out] == ["So it is.", "Then more came.", "And"] and [r[9] for r in out] == ["gap_ratio", "gap_ratio", "final_post_padding"]
    assert not state.ended and out[-1][3] == 2790


def test_windows_that_are_too_short_or_do_not_advance():
    words = said("a. b c d e f g h")
    assert run(words, [(900, False)], S.Limits(tail=0))[0] == [] and len(run(words, [(1000, False)], S.Limits(tail=0))[0]) == 1
    out, state = run(words, [(1000, False), (1300, False), (1500, False)], S.Limits(tail=0, least_advance=500, least_window=0))
    assert len(out) == 1 and state.last_right == 1000
    assert run(words, [(1000, False), (900, True)])[1].last_right == 1000


def test_boundaries_between_words():
    cut = lambda *a: S.boundary(*a, S.Limits())
    assert cut(0, 9000, 1000, None) == (1090, "final_post_padding") and cut(0, 1050, 1000, None) == (1050, "final_post_padding")
    assert cut(0, 9000, 1000, 900) == cut(0, 9000, 1000, 1000) == (1000, "overlap_last_word_end")
    assert cut(0, 9000, 1000, 1149) == (1089, "gap_ratio") and cut(0, 9000, 1000, 1150) == (1090, "post_padding")
    assert cut(5000, 9000, 1000, 1150) == (5000, "post_padding")


def test_text_of_sentences():
    assert S.joined(["Hello", ",", "you", "(", "there", ")", "%"]) == "Hello, you ( there)%"
    assert [S.capitalised(t) for t in ("hi", "iPhone", "«été", "42", "", "Hi", "ßa")] == ["Hi", "iPhone", "«Été", "42", "", "Hi", "SSa"]
    assert [S.ends_sentence(t) for t in ("a.", 'a."', "a…)", "a,", "", "...", "a.b")] == [True, True, True, False, False, True, False]
    # the mark that stands alone belongs to the word before it
    out, _ = run([("Really", 0, 300), ("?", 310, 320), ("Yes", 400, 700)], [(3000, False)])
    assert [(r[1], r[7]) for r in out] == [("Really?", 2)]


def made(sessions, seed=4):
    rng, rows = random.Random(seed), []
    for s in sessions:
        words, at = [], 0
        for _ in range(60):
            words.append((rng.choice(["so", "and", "yes.", "what?", "well,", "no…", '"ok."', "%"]), at, at + rng.randrange(50, 500)))
            at += rng.randrange(100, 900)
        rights = sorted(rng.sample(range(500, at + 2000), 25))
        for right in rights:
            rows.append((s, right, rng.random() < 0.15 or None, [("x", None, 5), (None, 1, 2), ("  ", 1, 2), *heard(words, right)] if rng.random() < 0.95 else None, "x"))
        rows.append((s, rights[-1], True, heard(words, rights[-1]), "x"))
    return rows


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = made([None, 1])
    df = spark.createDataFrame([*rows, (1, None, True, [("lost.", 0, 5)], "x")], SCHEMA)
    got = S.stable(df.withColumn("sentence", F.lit("x")).withColumn("_words", F.lit(1)), "session_id")
    assert got.columns[:3] == ["session_id", "sentence", "text"] and got.count() > 20
    for s in (None, 1):
        state, want = S.State(), []
        for _, right, flush, words, _ in (r for r in rows if r[0] == s):
            want += S.step(state, right, bool(flush), [w for w in words or [] if None not in w], S.Limits())
        assert [tuple(r)[1:] for r in got.filter(F.col("session_id").eqNullSafe(F.lit(s))).orderBy("sentence").collect()] == want
    assert S.stable(df.limit(0), "session_id").collect() == []


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    df = spark.createDataFrame(made(range(4)), SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("right_ms") / 1000 + 1_000_000))
    source, at = str(tmp_path / "in"), str(tmp_path / "at")

    def more(low, high):
        """The windows of a while, read by a query that starts again where the last one stopped."""
        df.filter(f"right_ms >= {low} AND right_ms < {high}").coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(df.schema).parquet(source)
        query = stream.stable(live, "session_id", "ts").writeStream.format("parquet").option("checkpointLocation", at).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    for low, high in ((0, 9000), (9000, 14000), (14000, 10**9)):
        more(low, high)
    df.filter("right_ms < 9000").withColumn("right_ms", F.col("right_ms") - 1).coalesce(1).write.mode("append").parquet(source)  # stale by now
    more(-1, -1)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, S.stable(df, "session_id").collect()), key=str) and len(got) > 40


def plain_groups(words, soft, gap, most, least):
    import re

    groups, first = [], 0
    for i, (t, s, e) in enumerate(words):
        if gap and first < i and s - words[i - 1][2] >= gap:
            groups.append((first, i - 1, "gap"))
            first = i
        if i - first + 1 < least:
            continue
        reason = "sentence" if re.search(S.SENTENCE_END, t.strip()) else "punctuation" if soft and re.search(S.SOFT_END, t.strip()) else "max_duration" if most and e - words[first][1] >= most else None
        if reason:
            groups.append((first, i, reason))
            first = i + 1
    return groups + ([(first, len(words) - 1, "final")] if first < len(words) else [])


def test_groups_of_words(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        at, words = 0, []
        for _ in range(rng.randrange(0, 25)):
            words.append((rng.choice(["a", "b.", "c,", 'd?"', "e;", " f"]), at, at + rng.randrange(1, 300)))
            at += rng.randrange(1, 600)
        rows.append((k, 4000, [("", 0, 10), ("x", 50, 50), ("late", 4100, 4200), *rng.sample(words, len(words))] if k % 10 else None))
    df = spark.createDataFrame(rows, f"k long, duration_ms long, words {WORDS}")
    for cap, *options in ((None, False, 0, 0, 1), (250, True, 200, 2000, 3), (None, True, 0, 1500, 2), (100, False, 300, 0, 1)):
        kept = df.select("k", S.timed_words(F.col("words"), F.col("duration_ms"), cap).alias("w"))
        for r in kept.select("k", "w", S.word_groups(F.col("w"), *options).alias("g")).collect():
            usable = sorted((min(s, 4000), min(e, 4000), t) for t, s, e in rows[r.k][2] or [] if t.strip() and min(e, 4000) > min(s, 4000))
            if cap:
                following = [u[0] for u in usable[1:]] + [None]
                usable = [(s, min(e, s + cap, n if n is not None and n > s else e), t) for (s, e, t), n in zip(usable, following)]
            assert [tuple(w) for w in r.w or []] == usable
            expected = [(a + 1, b + 1, reason) for a, b, reason in plain_groups([(t, s, e) for s, e, t in usable], *options)]
            assert [tuple(g) for g in r.g or []] == expected
    parts = S.transcript_parts(df, ["k"]).collect()
    assert all(0 <= p.start_ms < p.end_ms <= 4000 and p.words > 0 for p in parts) and {p.k for p in parts} == {r[0] for r in rows if any(t.strip() and s < 4000 and e > s for t, s, e in r[2] or [])}
    assert S.transcript_parts(df.limit(0), ["k"]).count() == 0


def test_no_table_of_words_is_broadcast(spark, sf_dir):
    assert "Broadcast" not in plans.windows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
