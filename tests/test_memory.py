"""Speaker memory: hand-made sessions, a second version in plain Python, and the stream against the batch."""

import math
import random

from pyspark.sql import functions as F

from turnloom.operators import memory as M
from turnloom.streaming import memory as stream


def plain(rows, confirmations):
    """(assigned, created) for each (vector, seconds): cosine, thresholds and moves, written out case by case."""
    speakers, waiting, out = [], [], []

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else list(v)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b))

    for v, seconds in rows:
        v = unit(v)
        q = max(0.25, min(1.0, (seconds - 0.45) / 2.15))
        if not speakers:
            if seconds < 1.2:
                out.append((None, False))
            else:
                speakers.append([v, 1, seconds])
                out.append(("S1", True))
            continue
        sims = [cos(v, s[0]) for s in speakers]
        top = max(range(len(sims)), key=lambda k: sims[k])
        rest = [x for k, x in enumerate(sims) if k != top]
        margin = sims[top] - max(rest) if rest else 1.0
        known = 1 / (1 + math.exp(-(sims[top] - 0.45) / 0.07))
        if rest:
            known *= 1 / (1 + math.exp(-(margin - 0.05) / 0.035))
        known *= min(1.0, 0.45 + 0.55 * speakers[top][2] / 8) * (0.55 + 0.45 * q)
        unknown = 1 - known

        def distinct(s):
            if s < 2.0 or len(speakers) >= 10:
                return False
            late = s >= 3.5
            low = late and unknown >= 0.30 and sims[top] < 0.45 and margin < 0.10
            if unknown < 0.58 and not low:
                return False
            if not (low or sims[top] < 0.40 or (sims[top] < 0.44 and margin < 0.08 and (unknown >= 0.8 or (late and unknown >= 0.58)))):
                return False
            return not (len(speakers) >= 4 and not late and sims[top] >= 0.25)

        like = max(range(len(waiting)), key=lambda k: cos(v, waiting[k][0]), default=None)
        if like is not None and cos(v, waiting[like][0]) < 0.52:
            like = None
        if distinct(max(seconds, 2.0) if confirmations > 1 and like is not None else seconds):
            if confirmations == 1:
                speakers.append([v, 1, seconds])
                out.append((f"S{len(speakers)}", True))
            elif like is None:
                waiting.append([v, 1, seconds])
                if len(waiting) > 6:
                    waiting.remove(min(waiting, key=lambda w: (w[1], w[2])))
                out.append((None, False))
            else:
                w = waiting[like]
                k = 1 / (w[1] + 1)
                w[:] = [unit([(1 - k) * a + k * b for a, b in zip(w[0], v)]), w[1] + 1, w[2] + seconds]
                if w[1] >= confirmations and w[2] >= 2.0:
                    speakers.append(waiting.pop(like))
                    out.append((f"S{len(speakers)}", True))
                else:
                    out.append((None, False))
            continue
        if seconds < 2.0 and ((len(speakers) == 1 and sims[top] < 0.57) or unknown >= 0.86):
            out.append((None, False))
            continue
        out.append((f"S{top + 1}", False))
        if unknown <= 0.55 and q >= 0.35:
            s = speakers[top]
            w = min(0.28, 0.08 + 0.18 * q) / max(1.0, s[1] ** 0.35)
            s[:] = [unit([(1 - w) * a + w * b for a, b in zip(s[0], v)]), s[1] + 1, s[2] + seconds]
    return out


def made(seed, n=60, voices=4, size=6, noise=0.35):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(voices)]
    return [([x + rng.gauss(0, noise) for x in rng.choice(centres)], rng.choice([0.6, 1.3, 2.2, 3.0, 4.1, 6.0])) for _ in range(n)]


def test_same_as_the_plain_version(spark):
    sessions = {k: made(k, noise=0.1 + 0.1 * (k % 6), voices=2 + k % 9) for k in range(12)}
    rows = [(k, i, v, s, "x") for k, r in sessions.items() for i, (v, s) in enumerate(r)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "session_id long, idx long, v array<double>, s double, source string").repartition(5)
    for confirmations in (1, 2, 3):
        out = M.assigned(df, "session_id", ["idx"], "v", "s", M.Limits(confirmations=confirmations)).collect()
        got = {(r.session_id, r.idx): (r.assigned, r.created) for r in out}
        want = {(k, i): x for k, r in sessions.items() for i, x in enumerate(plain(r, confirmations))}
        assert got == want and len({a for a, _ in want.values()}) > 3


def test_missing_vectors_first_speaker_and_doubtful_ones(spark):
    rows = [(1, 0, None, 5.0), (1, 1, [1.0, 0.0], 0.5), (1, 2, [1.0, 0.0], 1.5), (1, 3, [0.98, 0.1], 1.5), (1, 4, [0.0, 0.0], 3.0), (1, 5, [0.75, -0.66], 3.0), (1, 6, [0.75, -0.66], 3.0), (None, 0, [0.0, 1.0], 2.5)]
    df = spark.createDataFrame(rows, "session_id long, idx long, v array<double>, s double")
    out = {(r.session_id, r.idx): r for r in M.assigned(df, "session_id", ["idx"], "v", "s", M.Limits(first_now_s=2.0, known_similarity=0.8, confirmations=2)).collect()}
    assert [(out[1, i].assigned, out[1, i].source) for i in range(4)] == [(None, "embedding"), (None, "embedding"), (None, "first_speaker_pending"), ("S1", "embedding")]
    assert out[1, 4].assigned is None and out[1, 5].source == "gray_zone_unknown" and (out[1, 6].assigned, out[1, 6].created) == ("S2", True)
    assert out[None, 0].assigned == "S1"
    assert M.assigned(df.limit(0), "session_id", ["idx"], "v", "s").count() == 0


def test_stream_keeps_its_state_between_batches(spark, tmp_path):
    rows = [(k, i, v, s) for k in range(3) for i, (v, s) in enumerate(made(k, 30))]
    schema = "session_id long, idx long, v array<double>, s double"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("idx") + 1_000_000))
    source = str(tmp_path / "in")
    for low in (0, 10, 20):
        df.filter(f"idx >= {low} AND idx < {low + 10}").coalesce(1).write.mode("append").parquet(source)
    limits = M.Limits(confirmations=2)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = stream.assigned(live, "session_id", "idx", "v", "s", "ts", limits=limits)
    query = out.writeStream.format("memory").queryName("memory_out").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.session_id, r.idx): tuple(r)[2:] for r in spark.table("memory_out").collect()}
    want = {(r.session_id, r.idx): tuple(r)[2:] for r in M.assigned(df, "session_id", ["idx"], "v", "s", limits).collect()}
    assert set(got) == set(want) and all(g[:3] == want[k][:3] for k, g in got.items())
