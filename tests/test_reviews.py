"""Hand-off gates, timings and review states on hand-made rows; the queries are held against SQL."""

from turnloom.operators import reviews as R


def test_gates_in_their_order(spark):
    def case(k, left, right):
        return [(k, "A", "B", side, s, v) for side, scores in (("left", left), ("right", right)) for s, v in scores.items()]

    good = {"A": 0.9, "B": 0.2, "C": 0.1}, {"A": 0.2, "B": 0.9, "C": None}
    cases = [
        (good, "accepted"),
        ((good[0], {"B": 0.9}), "missing_context_profile_score"),
        ((good[0], {"A": float("nan"), "B": 0.9}), "missing_context_profile_score"),
        (({"A": 0.3, "B": 0.0}, good[1]), "weak_context_similarity"),
        (({"A": 0.5, "B": 0.4}, good[1]), "weak_context_pair_margin"),
        (({"A": 0.9, "B": 0.2, "C": 0.85}, good[1]), "context_matches_third_speaker"),
        (({"A": 0.6, "B": 0.4}, {"A": 0.4, "B": 0.6}), "weak_context_separation"),
    ]
    rows = [r for k, (sides, _) in enumerate(cases) for r in case(k, *sides)]
    df = spark.createDataFrame(rows, "k int, speaker_a string, speaker_b string, side string, speaker string, similarity double")
    got = R.context_handoffs(df, ["k"]).orderBy("k").collect()
    assert [r.reason for r in got] == [want for _, want in cases]
    assert [r.accepted for r in got] == [True] + [False] * 6
    assert abs(got[0].left_lead - 0.7) < 1e-12 and abs(got[0].separation - 1.4) < 1e-12 and got[1].right_pair == 0
    assert R.context_handoffs(df.limit(0), ["k"]).collect() == []


def test_times_that_no_speech_has(spark):
    rows = [
        (1, 0, "One.", 0, 0), (1, 1, "Two", 0, 30), (1, 2, "three.", 30, 60), (1, 3, "Four", 100, 100), (1, 4, "five", 300, 300), (1, 5, "six.", 340, 340),
        (1, 6, "Seven", 400, 440), (1, 7, "eight.", 440, 480), (1, 8, "...", 500, 500), (1, 9, None, 600, 600), (None, 0, "ten", 5, 5),
    ]
    df = spark.createDataFrame([(*r[:3], 0, *r[3:]) for r in rows], "s long, i long, word string, seg long, a long, b long")
    got = {(r.s, r.i): r.impossible for r in R.timing_faults(df, "s", ["i"], "word", "seg", "a", "b").collect()}
    assert {k for k, bad in got.items() if bad} == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (None, 0)}


def test_states_of_reports(spark):
    reports = spark.createDataFrame([(1, "draft"), (2, "draft"), (3, "draft"), (4, "draft"), (5, "stale"), (6, None)], "k long, status string")
    objects = spark.createDataFrame([(1, "accepted"), (1, "edited"), (2, "rejected"), (2, None), (3, None), (4, "stale"), (4, "accepted"), (5, "accepted")], "k long, status string")
    got = {r.k: (r.status, r.needs_review, r.stale_objects) for r in R.review_states(reports, objects, "k").collect()}
    assert got == {1: ("reviewed", False, 0), 2: ("partially_reviewed", True, 0), 3: ("draft", True, 0), 4: ("stale", True, 1), 5: ("stale", True, 0), 6: ("draft", True, 0)}
