"""Queries of sentences out of timed words, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.operators import sentences as S
from turnloom.plans.views import frame, with_views

#: A window every so many ms, and how far back it hears.
EVERY, REACH = 2500, 20_000


def timed_words(spark, sf_dir):
    """Words of the turns with times from their places; some last into the next one."""
    turns = frame(spark, sf_dir, "turns").select("session_id", "idx", "start_ms", "end_ms", F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("k", "w"))
    before = F.coalesce(F.sum(F.length("w") + 1).over(W.partitionBy("session_id", "idx").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.col("start_ms") + 40 * before
    placed = turns.select("session_id", "idx", "k", F.col("start_ms").alias("turn_ms"), F.col("end_ms").alias("turn_end_ms"), F.col("w").alias("text"), start.alias("s"))
    return placed.filter("text <> ''").select("session_id", "idx", "k", "turn_ms", "turn_end_ms", "text", F.col("s").alias("start_ms"), (F.col("s") + 34 * F.length("text") + F.when(F.col("k") % 13 == 5, 150).otherwise(0)).alias("end_ms"))


def windows(spark, sf_dir):
    """What a recogniser hears at each moment: the words of the last seconds, the one at the edge cut short."""
    words = timed_words(spark, sf_dir)
    ends = words.groupBy("session_id").agg(F.max("end_ms").alias("end"))
    last = F.floor((F.col("end") - 1) / EVERY) + 1
    grid = ends.select("session_id", F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long"))).alias("place"), "end", last.alias("last"))
    grid = grid.select("session_id", "place", F.when(F.col("place") == F.col("last"), F.col("end")).otherwise(EVERY * F.col("place")).alias("right_ms"), ((F.col("place") == F.col("last")) | ((F.col("session_id") + F.col("place")) % 7 == 3)).alias("flush"))
    low, high = F.floor(F.col("start_ms") / EVERY) + 1, F.floor((F.col("start_ms") + REACH) / EVERY)
    heard = words.select("session_id", "text", "start_ms", "end_ms", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("place"))
    met = grid.join(heard.hint("merge"), ["session_id", "place"], "left")  # words in all their windows are far more than the file's size tells
    cut = F.col("end_ms") > F.col("right_ms")
    word = F.struct(F.col("start_ms"), F.least("end_ms", "right_ms").alias("end_ms"), F.when(cut, F.substring("text", F.lit(1), F.floor((F.length("text") + 1) / 2).cast("int"))).otherwise(F.col("text")).alias("text"))
    return met.groupBy("session_id", "place", "right_ms", "flush").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull() & (F.col("start_ms") < F.col("right_ms")), word))).alias("words"))


def stable_sentences(spark, sf_dir):
    """Sentences committed window by window, all but an unstable tail."""
    return S.stable(windows(spark, sf_dir), "session_id")


def _finals(spark, sf_dir):
    """Each turn as a final transcript with words at times from its start."""
    word = F.struct(F.col("text"), (F.col("start_ms") - F.col("turn_ms")).alias("start_ms"), (F.col("end_ms") - F.col("turn_ms")).alias("end_ms"))
    return timed_words(spark, sf_dir).groupBy("session_id", "idx", (F.col("turn_end_ms") - F.col("turn_ms")).alias("duration_ms")).agg(F.collect_list(word).alias("words"))


def transcript_parts(spark, sf_dir):
    """Turns cut after each sentence."""
    return S.transcript_parts(_finals(spark, sf_dir), ["session_id", "idx"])


def loose_parts(spark, sf_dir):
    """Turns cut after sentences, soft marks, long pauses and ten seconds, from three words on; words of at most 300 ms."""
    return S.transcript_parts(_finals(spark, sf_dir), ["session_id", "idx"], most_word_ms=300, soft=True, gap_ms=90, most_ms=10_000, least_words=3)


_WORDS = """
tokens AS (SELECT session_id, idx, start_ms AS turn_ms, end_ms AS turn_end_ms, UNNEST(ws) AS text, UNNEST(RANGE(LEN(ws))) AS k FROM (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM turns) t),
timed AS (SELECT *, turn_ms + 40 * CAST(COALESCE(SUM(LENGTH(text) + 1) OVER (PARTITION BY session_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM tokens),
spoken AS (SELECT *, start_ms + 34 * LENGTH(text) + CASE WHEN k % 13 = 5 THEN 150 ELSE 0 END AS end_ms FROM timed WHERE text <> '')"""

_CAPITAL = r"""CASE WHEN regexp_matches(t, '^[^\p{L}]*\p{Ll}') AND NOT regexp_matches(t, '^[^\p{L}]*\p{L}\p{Lu}')
 THEN regexp_extract(t, '^[^\p{L}]*') || upper(regexp_extract(t, '^[^\p{L}]*(\p{L})', 1)) || substr(t, length(regexp_extract(t, '^[^\p{L}]*\p{L}')) + 1) ELSE t END"""


def _cut(end: str, following: str, limits: S.Limits) -> str:
    return f"""CASE WHEN {following} IS NULL THEN {end} + {limits.after} WHEN {following} <= {end} THEN {end}
 WHEN {end} + {limits.after} > {following} - {limits.before} THEN CAST(FLOOR({end} + ({following} - {end}) * {limits.gap_share}::DOUBLE) AS BIGINT) ELSE LEAST({end} + {limits.after}, {following} - {limits.before}) END"""


_LIMITS = S.Limits()

_STABLE = rf"""{_WORDS},
last AS (SELECT session_id, MAX(end_ms) AS final, CAST(FLOOR((MAX(end_ms) - 1) / {EVERY}) + 1 AS BIGINT) AS n FROM spoken GROUP BY session_id),
grid AS (SELECT session_id, place, CASE WHEN place = n THEN final ELSE {EVERY} * place END AS right_ms, place = n OR (session_id + place) % 7 = 3 AS flush FROM (SELECT *, UNNEST(RANGE(1, n + 1)) AS place FROM last) l),
heard AS (SELECT g.session_id, g.place, g.right_ms, g.flush, LIST({{'text': CASE WHEN s.end_ms > g.right_ms THEN s.text[:(LENGTH(s.text) + 1) // 2] ELSE s.text END, 'start_ms': s.start_ms, 'end_ms': LEAST(s.end_ms, g.right_ms)}} ORDER BY s.start_ms) AS words
 FROM grid g JOIN spoken s ON s.session_id = g.session_id AND s.start_ms < g.right_ms AND g.place BETWEEN s.start_ms // {EVERY} + 1 AND (s.start_ms + {REACH}) // {EVERY} GROUP BY ALL),
windows AS (SELECT g.*, COALESCE(h.words, []) AS words FROM grid g LEFT JOIN heard h ON h.session_id = g.session_id AND h.place = g.place),
walk AS (
 SELECT session_id, 0::BIGINT AS place, 0::BIGINT AS left_ms, -1::BIGINT AS last_right, TRUE AS ended, 0 AS count, 0::BIGINT AS right_ms, 0::BIGINT AS was_left, TRUE AS was_ended, 0 AS was_count,
  []::STRUCT(text VARCHAR, start_ms BIGINT, end_ms BIGINT)[] AS kept, []::BIGINT[] AS ends, []::BIGINT[] AS cuts FROM last
 UNION ALL
 SELECT session_id, place, CASE WHEN LEN(ends) > 0 THEN cuts[-1] ELSE left_ms END, CASE WHEN skip THEN last_right ELSE GREATEST(last_right, right_ms) END,
  CASE WHEN LEN(ends) > 0 THEN regexp_matches(kept[ends[-1]].text, '[.?!…]["'')\]}}]*$') ELSE ended END, count + LEN(ends)::INT, right_ms, left_ms, ended, count, kept, ends, cuts
 FROM (SELECT *, list_transform(ends, lambda k: GREATEST(left_ms, LEAST(right_ms, {_cut("kept[k].end_ms", "kept[k + 1].start_ms", _LIMITS)}))) AS cuts
  FROM (SELECT *, CASE WHEN skip THEN []::BIGINT[] WHEN flush THEN list_distinct_sorted ELSE list_filter(marks, lambda k: k < LEN(kept) AND right_ms - kept[k].end_ms >= {_LIMITS.tail}) END AS ends
   FROM (SELECT *, CASE WHEN LEN(kept) = 0 OR list_contains(marks, LEN(kept)) THEN marks ELSE list_append(marks, LEN(kept)) END AS list_distinct_sorted
    FROM (SELECT *, list_filter(RANGE(1, LEN(kept) + 1), lambda k: regexp_matches(kept[k].text, '[.?!…]["'')\]}}]*$') AND (k = LEN(kept) OR NOT regexp_matches(kept[k + 1].text, '^[.,?!;:%)\]}}…]'))) AS marks
     FROM (SELECT w.session_id, v.place, v.right_ms, v.flush, w.left_ms, w.last_right, w.ended, w.count, NOT v.flush AND (v.right_ms - w.left_ms < {_LIMITS.least_window} OR v.right_ms <= w.last_right + {_LIMITS.least_advance}) AS skip,
       list_filter(v.words, lambda x: x.start_ms + x.end_ms >= 2 * w.left_ms) AS kept
      FROM walk w JOIN windows v ON v.session_id = w.session_id AND v.place = w.place + 1) a) b) c) d) e
),
found AS (SELECT *, UNNEST(RANGE(1, LEN(ends) + 1)) AS i FROM walk WHERE LEN(ends) > 0),
parts AS (SELECT *, kept[CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] + 1 END:ends[i]] AS p, CASE WHEN i = 1 THEN was_left ELSE cuts[i - 1] END AS l, i > 1 OR was_ended AS after_end FROM found),
told AS (SELECT *, regexp_replace(array_to_string(list_transform(p, lambda x: x.text), ' '), ' ([.,?!;:%)\]}}…])', '\1', 'g') AS t FROM parts)
SELECT session_id, CAST(was_count + i - 1 AS INT) AS sentence, CASE WHEN after_end THEN {_CAPITAL} ELSE t END AS text, GREATEST(l, LEAST(right_ms, p[1].start_ms - {_LIMITS.before})) AS start_ms, cuts[i] AS end_ms,
 p[1].start_ms AS first_word_ms, p[-1].end_ms AS last_word_ms, kept[ends[i] + 1].start_ms AS next_word_ms, LEN(p)::INT AS words, CAST(list_sum(list_transform(p, lambda x: GREATEST(0, x.end_ms - x.start_ms))) AS BIGINT) AS spoken_ms,
 CASE WHEN kept[ends[i] + 1].start_ms IS NULL THEN 'final_post_padding' WHEN kept[ends[i] + 1].start_ms <= p[-1].end_ms THEN 'overlap_last_word_end'
  WHEN p[-1].end_ms + {_LIMITS.after} > kept[ends[i] + 1].start_ms - {_LIMITS.before} THEN 'gap_ratio' ELSE 'post_padding' END AS rule, was_left AS left_ms, right_ms
FROM told"""


def _parts(most_word_ms: int = 0, soft: bool = False, gap_ms: int = 0, most_ms: int = 0, least_words: int = 1) -> str:
    """Words numbered in their turn, walked one by one with the first word of the current group."""
    cap = f"LEAST(e, s + {most_word_ms}, CASE WHEN next_s > s THEN next_s ELSE e END)" if most_word_ms else "e"
    rules = r"WHEN regexp_matches(trim(w.text), '[.!?]+[\"'')\]]*$') THEN 'sentence'"
    rules += r" WHEN regexp_matches(trim(w.text), '[,;:]+[\"'')\]]*$') THEN 'punctuation'" if soft else ""
    rules += f" WHEN w.e - CASE WHEN late THEN w.s ELSE g.s0 END >= {most_ms} THEN 'max_duration'" if most_ms else ""
    late = f"g.first <= g.i AND w.s - g.e >= {gap_ms}" if gap_ms else "FALSE"
    return rf"""{_WORDS},
inside AS (SELECT session_id, idx, text, turn_end_ms - turn_ms AS d, LEAST(GREATEST(start_ms - turn_ms, 0), turn_end_ms - turn_ms) AS s, LEAST(GREATEST(end_ms - turn_ms, 0), turn_end_ms - turn_ms) AS e FROM spoken),
kept AS (SELECT *, ROW_NUMBER() OVER o AS i, LEAD(s) OVER o AS next_s, COUNT(*) OVER (PARTITION BY session_id, idx) AS n FROM inside WHERE e > s WINDOW o AS (PARTITION BY session_id, idx ORDER BY s, e)),
ordered AS (SELECT session_id, idx, text, d, s, {cap} AS e, i, n FROM kept),
walk AS (
 SELECT session_id, idx, 0::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS s0, 0::BIGINT AS e, NULL::VARCHAR AS reason, FALSE AS late, 1::BIGINT AS was_first FROM ordered WHERE i = 1
 UNION ALL
 SELECT session_id, idx, i, CASE WHEN reason IS NULL THEN f ELSE i + 1 END, CASE WHEN f = i THEN s ELSE s0 END, e, reason, late, first
 FROM (SELECT g.session_id, g.idx, w.i, w.s, w.e, g.first, CASE WHEN late THEN w.i ELSE g.first END AS f, CASE WHEN g.first = w.i THEN w.s ELSE g.s0 END AS s0, late,
   CASE WHEN w.i - CASE WHEN late THEN w.i ELSE g.first END + 1 >= {least_words} THEN CASE {rules} END END AS reason
  FROM (SELECT g.*, {late} AS late FROM (SELECT g.session_id, g.idx, g.i, g.first, CASE WHEN g.first = g.i + 1 THEN w.s ELSE g.s0 END AS s0, g.e FROM walk g JOIN ordered w ON w.session_id = g.session_id AND w.idx = g.idx AND w.i = g.i + 1) g JOIN ordered w ON w.session_id = g.session_id AND w.idx = g.idx AND w.i = g.i + 1) g
  JOIN ordered w ON w.session_id = g.session_id AND w.idx = g.idx AND w.i = g.i + 1) x
),
closed AS (
 SELECT session_id, idx, was_first AS a, i - 1 AS b, 'gap' AS reason FROM walk WHERE late
 UNION ALL SELECT session_id, idx, CASE WHEN late THEN i ELSE was_first END, i, reason FROM walk WHERE reason IS NOT NULL
 UNION ALL SELECT w.session_id, w.idx, w.first, w.i, 'final' FROM walk w JOIN (SELECT session_id, idx, MAX(n) AS n FROM ordered GROUP BY ALL) m ON m.session_id = w.session_id AND m.idx = w.idx AND m.n = w.i WHERE w.first <= w.i
),
edges AS (SELECT c.*, x.s AS first_word_ms, y.e AS last_word_ms, p.e AS before, f.s AS following, x.d,
  (SELECT string_agg(trim(o.text), ' ' ORDER BY o.i) FROM ordered o WHERE o.session_id = c.session_id AND o.idx = c.idx AND o.i BETWEEN c.a AND c.b) AS t
 FROM closed c JOIN ordered x ON x.session_id = c.session_id AND x.idx = c.idx AND x.i = c.a JOIN ordered y ON y.session_id = c.session_id AND y.idx = c.idx AND y.i = c.b
 LEFT JOIN ordered p ON p.session_id = c.session_id AND p.idx = c.idx AND p.i = c.a - 1 LEFT JOIN ordered f ON f.session_id = c.session_id AND f.idx = c.idx AND f.i = c.b + 1),
bounds AS (SELECT *, LEAST(GREATEST(GREATEST(CASE WHEN before IS NULL THEN 0 ELSE {_cut("before", "first_word_ms", _LIMITS)} END, first_word_ms - {_LIMITS.before}), 0), d) AS start_ms,
  LEAST(GREATEST({_cut("last_word_ms", "following", _LIMITS)}, 0), d) AS end_ms, ROW_NUMBER() OVER (PARTITION BY session_id, idx ORDER BY a) - 1 AS part FROM edges)
SELECT session_id, idx, CAST(part AS INT) AS part, regexp_replace(t, '\s+([,.;:!?])', '\1', 'g') AS text, start_ms, end_ms, first_word_ms, last_word_ms, CAST(b - a + 1 AS INT) AS words, reason FROM bounds WHERE end_ms > start_ms"""


SQL = {"stable_sentences": _STABLE, "transcript_parts": _parts(), "loose_parts": _parts(300, True, 90, 10_000, 3)}


def queries() -> dict:
    return {q.__name__: q for q in (stable_sentences, transcript_parts, loose_parts)}


def oracle_sql() -> dict[str, str]:
    return {name: with_views("WITH " + sql.strip()).replace("WITH ", "WITH RECURSIVE ", 1) for name, sql in SQL.items()}
