"""Hand-made cases of rows regrouped by session."""

import random

from turnloom.operators import segments as S
from turnloom.sources import traces


def labelled(spark, labels, ms=1000, key="s"):
    rows = [(key, k, label, ms) for k, label in enumerate(labels)]
    return spark.createDataFrame(rows, "session_id string, idx long, speaker string, duration_ms long")


def fixed(df):
    return [r.fixed for r in df.orderBy("idx").collect()]


def test_fragments_go_to_the_label_around_them(spark):
    assert fixed(S.merge_fragments(labelled(spark, ["A", "A", "x", None, "x", "A", "B", "B", "x", "A", "A", "A", "A", "A"]), "session_id")) == ["A", "A", "A", None, "A", "A", "B", "B", "A", "A", "A", "A", "A", "A"]


def test_fragments_without_a_single_winner_stay(spark):
    tied = ["A"] * 7 + ["x"] + ["B"] * 7 + ["x"] + ["C"] * 7
    assert fixed(S.merge_fragments(labelled(spark, ["A"] + ["B"] + ["A"] * 7, ms=4000), "session_id")) == ["A", "B"] + ["A"] * 7
    assert fixed(S.merge_fragments(labelled(spark, tied), "session_id", least_share=0.6)) == tied
    alone = [None, "x", None, "x"]
    assert fixed(S.merge_fragments(labelled(spark, alone), "session_id")) == alone
    assert S.merge_fragments(labelled(spark, []), "session_id").count() == 0


def test_fragments_never_go_to_a_fragment(spark):
    both = ["x", "y", "x", "y"]
    assert fixed(S.merge_fragments(labelled(spark, both), "session_id")) == both


def test_doubtful_rows_get_new_labels(spark):
    rows = [(1, 0, "S2", "retro", 5000, 0.05, 0.01), (1, 1, "S9", "retro", 5000, 0.06, 0.04), (1, 2, "S1", "retro", 5000, None, 0.0), (1, 3, None, "retro", 5000, 0.0, 0.0), (1, 4, "Ann", None, 5000, 0.0, 0.0), (2, 0, "Ann", "retro", 4000, 0.0, 0.0), (2, 1, "Ann", "retro", 3999, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id long, idx long, speaker string, source string, duration_ms long, top_similarity double, margin double")
    one = {(r.session_id, r.idx): r.fixed for r in S.split_doubtful(df, "session_id").collect()}
    assert one == {(1, 0): "S10", (1, 1): "S9", (1, 2): "S1", (1, 3): None, (1, 4): "Ann", (2, 0): "S1", (2, 1): "Ann"}
    assert {r.fixed for r in S.split_doubtful(df, "session_id", most_splits=2).filter("session_id = 1").collect()} == {"S10", "S11", "S1", None, "Ann"}


def test_topic_segments_against_a_plain_fold(spark):
    draw = random.Random(3)
    rows = [(s, k, draw.choice(["Risks", "a risk.", "moving on", "word", None, "x", "y", "z", "w", "v"]) if s != 2 else "no cue") for s in (1, 2, 3) for k in range(draw.randint(150, 260))] + [(4, 0, None)]
    import re

    want = []
    for s in (1, 2, 3, 4):
        part, n = [], 0
        for _, k, text in [r for r in rows if r[0] == s]:
            if part and (len(part) >= 80 or (len(part) >= 16 and re.search(rf"\b({S.TOPIC_CUES})\b", text or "", re.I))):
                want.append((s, n := n + 1, part[0], part[-1], len(part)))
                part = []
            part.append(k)
        want.append((s, n + 1, part[0], part[-1], len(part)))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id long, idx long, text string")
    assert sorted(map(tuple, S.topic_segments(df, "session_id").collect())) == want
    assert S.topic_segments(df.filter("false"), "session_id").count() == 0


def test_unknown_pairs(spark):
    rows = [
        (1, 0, None, 0, 1000, [1.0, 0.0], 0.0, 0.0, 1.0),
        (1, 1, None, 1000, 2000, [1.0, 0.0], 0.0, 0.0, 1.0),  # short: partner only
        (1, 2, None, 5000, 8000, [1.0, 0.0], 0.0, 0.0, 1.0),  # 4 s after row 0; tie with row 1, which comes later
        (1, 3, "A", 8000, 9000, [0.0, 1.0], 0.0, 0.0, 1.0),
        (1, 4, None, 9000, 12000, [0.0, 1.0], 0.0, 0.0, 1.0),  # row 2 is no likeness, row 3 is known
        (1, 5, None, 12001, 15000, [0.0, 1.0], None, 0.0, 1.0),  # no similarity: taken as 1
        (1, 6, None, 15000, 18000, [1.0, 1.0], 0.5, 0.2, 0.1),  # the limits are inside
        (2, 0, None, 15000, 18000, [1.0, 1.0], 0.0, 0.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "session_id long, idx long, speaker string, start_ms long, end_ms long, embedding array<double>, top_similarity double, margin double, unknown_probability double")
    assert sorted((r.session_id, r.idx, r.partner_idx, r.gap_ms) for r in S.unknown_pairs(df, "session_id").collect()) == [(1, 2, 0, 4000), (1, 6, 4, 3000)]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title\n[0:01 - 1:02:03.5]  Ann  Lee 07: well,  hello: you\r\n\n[0:05 - 0:06] Bob:   \n[1 - 2] No: form\n  [0:07 - 0:08] !?: ö\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    rows = traces.read_transcripts(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["index"], r.source_line, r.start, r.end, r.speaker_name, r.speaker_id, r.text) for r in rows] == [(1, 2, 1.0, 3723.5, "Ann Lee 07", "S7", "well, hello: you"), (2, 6, 7.0, 8.0, "!?", "speaker", "ö")]
