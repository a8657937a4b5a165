"""Whole-session alignment and trace reports against the quadratic table and plain loops."""

import random
import re
import tracemalloc
from collections import Counter
from difflib import SequenceMatcher

import pytest

from turnloom.functions import alignment as F
from turnloom.functions.matching import alignment as quadratic
from turnloom.operators import alignment as A
from turnloom.plans import alignment as plans


def test_same_pairs_as_the_quadratic_table():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5, 20])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(30))] for _ in range(2))
        expected = quadratic(a, b)
        assert all(F.common_places(a, b, stride) == expected for stride in (None, 1, 4, 100))
        assert F.common_length(a, b) == len(expected)


def test_words_without_kept_masks(monkeypatch):
    rng = random.Random(2)
    a, b = ([rng.randrange(9) for _ in range(200)] for _ in range(2))
    few = F.Masks(b, keep_bytes=0)
    assert [few[w] for w in range(10)] == [F.Masks(b)[w] for w in range(10)] and not few.kept
    monkeypatch.setattr(F.Masks.__init__, "__defaults__", (0,))
    assert F.common_places(a, b) == quadratic(a, b)


def test_sessions_of_50_000_words():
    rng = random.Random(3)
    b = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(50_000)]
    a = [w if rng.random() < 0.9 else "other" for w in b if rng.random() < 0.9]
    tracemalloc.start()
    pairs = F.common_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == F.common_length(a, b) > 38_000 and peak < 64_000_000  # the whole table has 2.5 * 10**9 cells
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def _words(text):
    return re.findall("[a-z0-9']+", (text or "").lower())


LIVE = "session_id long, idx long, text string, assigned string, start_ms long, end_ms long, duration_ms long, label string"
TRUTH = "session_id long, idx long, text string, speaker string, start_ms long, end_ms long, flag string"


def _tables(rng):
    live, truth = [], []
    for s in (1, 2, None):
        vocabulary = [f"w{k}" for k in range(12)] + ["It's", "x9"]
        for i in range(9):
            text = rng.choice([None, "", "…", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))]) if i % 3 == 0 else " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))
            truth.append((s, i, text, rng.choice("ABC"), i * 1000, i * 1000 + rng.choice([0, 700, 1500]), "x"))
            words = [w for w in (text or "").split() if rng.random() < 0.7]
            timed = rng.random() < 0.4
            live.append((s, i, " ".join(words) if i % 4 else rng.choice([None, "w1w w2", "w3 zzz"]), rng.choice([None, "", "P", "Q"]), i * 1000 - 300 if timed else None, i * 1000 + 900 if timed and rng.random() < 0.9 else None, rng.choice([None, 500, 5000]), "y"))
    live.append((4, 0, "alone here", "P", 0, 1000, None, "y"))
    return live, truth


def _score(a, b):
    return 0.65 * SequenceMatcher(None, " ".join(a), " ".join(b)).ratio() + 0.35 * len(set(a) & set(b)) / len(set(a) | set(b))


def _plain_rows(live, truth, mode, fuzzy):
    """(speaker, score, found_by, duration) by session and place, row after row."""
    out = {}
    for s in {r[0] for r in live}:
        rows, said = sorted((r for r in live if r[0] == s), key=lambda r: r[1]), sorted((r for r in truth if r[0] == s), key=lambda r: r[1])
        a, b = [(r[1], w) for r in rows for w in _words(r[2])], [(r[3], w) for r in said for w in _words(r[2])]
        votes = {}
        for i, j in quadratic([w for _, w in a], [w for _, w in b]):
            votes.setdefault(a[i][0], Counter())[b[j][0]] += 1
        for _, i, text, _, start, end, duration, _ in rows:
            speaker, score, by, duration = None, None, "unmatched", duration or 0
            if mode != "text" and start is not None and end is not None and end > start:
                by, duration = "timestamp", max(duration, end - start)
                ms = Counter()
                for _, _, _, who, from_, to, _ in said:
                    if s is not None and min(end, to) > max(start, from_):  # rows of a null session are not matched by time
                        ms[who] += min(end, to) - max(start, from_)
                speaker = ms.most_common(1)[0][0] if ms else None
            if speaker is None and mode != "timestamp":
                who, n = votes[i].most_common(1)[0] if i in votes else (None, 0)
                score = n / max(1, len(_words(text)))
                if n and score >= 0.34:
                    speaker, by = who, "text_lcs"
                else:
                    score = None
                    if fuzzy:
                        score, k = max(((_score(_words(text), _words(t[2])), -k) for k, t in enumerate(said) if _words(t[2]) and _words(text)), default=(0.0, 0))
                        if score >= 0.45:
                            speaker, by = said[-k][3], "text"
            out[s, i] = (speaker, score and round(score, 9), by, duration)
    return out


@pytest.mark.parametrize(("mode", "fuzzy"), [("auto", True), ("auto", False), ("text", True), ("timestamp", True)])
def test_rows_of_a_trace(spark, mode, fuzzy):
    seen = Counter()
    for seed in (5, 6):
        live, truth = _tables(random.Random(seed))
        l, t = spark.createDataFrame(live, LIVE), spark.createDataFrame(truth, TRUTH)
        out = A.trace_rows(l, t, "session_id", "idx", mode, fuzzy).collect()
        got = {(r.session_id, r.idx): (r.speaker, r.score and round(r.score, 9), r.found_by, r.duration_ms) for r in out}
        assert len(out) == len(live) and got == _plain_rows(live, truth, mode, fuzzy)
        seen.update(r.found_by for r in out)
    assert len(seen) > 1
    with pytest.raises(ValueError):
        A.trace_rows(l, t, "session_id", "idx", "all")


def test_report_of_a_trace(spark):
    live, truth = _tables(random.Random(7))
    l, t = spark.createDataFrame(live, LIVE), spark.createDataFrame(truth, TRUTH)
    rows, out = _plain_rows(live, truth, "auto", True), {r.session_id: r for r in A.trace_report(l, t, "session_id", "idx").collect()}
    assert set(out) == {1, 2, None, 4}
    for s in out:
        weight, first = Counter(), {}
        for r in sorted((r for r in live if r[0] == s), key=lambda r: r[1]):
            speaker, _, _, ms = rows[s, r[1]]
            if r[3] and speaker:
                weight[r[3], speaker] += max(1, ms)
                first.setdefault((r[3], speaker), r[1])
        mapped = {p: max((q for q in weight if q[0] == p), key=lambda q: (weight[q], -first[q]))[1] for p, _ in weight}
        scored = [(rows[s, r[1]], r[3]) for r in live if r[0] == s and rows[s, r[1]][0]]
        good = [x for x, p in scored if mapped.get(p) == x[0]]
        a, b = ([w for r in sorted((r for r in side if r[0] == s), key=lambda r: r[1]) for w in _words(r[2])] for side in (live, truth))
        common = len(quadratic(a, b))
        r = out[s]
        assert (r.segments, r.live_words, r.truth_words, r.lcs_words) == (sum(x[0] == s for x in live), len(a), len(b), common)
        assert abs(r.text_recall - common / max(1, len(b))) < 1e-4 and abs(r.text_precision - common / max(1, len(a))) < 1e-4
        assert abs(r.segment_accuracy - len(good) / max(1, len(scored))) < 1e-4
        assert abs(r.duration_accuracy - sum(x[3] for x in good) / max(1, sum(x[0][3] for x in scored))) < 1e-4


def test_empty_tables(spark):
    l, t = spark.createDataFrame([], LIVE), spark.createDataFrame([], TRUTH)
    live, truth = (spark.createDataFrame(rows, schema) for rows, schema in zip(_tables(random.Random(8)), (LIVE, TRUTH)))
    assert A.session_alignment(l, truth, "session_id", "idx").count() == A.session_alignment(live, t, "session_id", "idx").count() == 0
    assert A.trace_rows(l, truth, "session_id", "idx").count() == A.trace_report(l, t, "session_id", "idx").count() == 0
    assert {r.found_by for r in A.trace_rows(live, t, "session_id", "idx").collect()} == {"timestamp", "unmatched"}


def test_most_similar_text(spark, sf_dir):
    live, turns = plans._sides(spark, sf_dir)
    rows, said = live.select("session_id", "idx", "text").collect(), turns.select("session_id", "idx", "text").collect()
    want = {}
    for r in rows:
        found = [(_score(_words(r.text), _words(t.text)), -t.idx) for t in said if t.session_id == r.session_id and _words(t.text) and _words(r.text)]
        if found and max(found)[0] > 0:
            want[r.session_id, r.idx] = max(found)
    got = {(r.session_id, r.idx): (r.score, -r.other) for r in A.best_texts(live, turns, "session_id", "idx").collect()}
    assert got == want and len(got) > 50
