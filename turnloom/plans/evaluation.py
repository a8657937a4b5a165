"""Queries of the evaluation operators, and their SQL. Inputs are SQL texts that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import vectors as V
from turnloom.functions.numbers import quantized
from turnloom.operators import evaluation as E
from turnloom.plans import intervals as PI
from turnloom.plans.views import frame, run_sql, with_views

INPUTS = {
    "scores": """SELECT s.session_id, v.variant, CAST((s.session_id*37)%90 AS DOUBLE)/100.0 + CASE v.k WHEN 1 THEN ((s.session_id%3)-1)*0.002 WHEN 2 THEN ((s.session_id%5)-2)*0.02 WHEN 3 THEN 0.01 ELSE 0.0 END AS score,
 CAST((s.session_id*13)%20 AS DOUBLE)/100.0 + CASE WHEN v.k=3 THEN 0.004 WHEN v.k=2 AND s.session_id%4=0 THEN 0.02 ELSE 0.0 END AS wrong
 FROM (SELECT DISTINCT session_id FROM turns) s CROSS JOIN (SELECT 'baseline' AS variant, 0 AS k UNION ALL SELECT 'near', 1 UNION ALL SELECT 'far', 2 UNION ALL SELECT 'better', 3) v""",
    "ticks": """SELECT session_id, event_id, tick_ms, hold_ms%41-20 AS margin, hold_ms%5+1 AS support, hold_ms%3=0 AS truth, CASE WHEN hold_ms%7=2 THEN 'held' ELSE 'shown' END AS action, speaker, hold_ms%70 AS slot FROM probes""",
    "replay": """SELECT session_id, event_id, tick_ms, CASE WHEN hold_ms%11=5 THEN 'P_other' ELSE speaker END AS speaker, CASE WHEN hold_ms%7=2 THEN 'held' ELSE 'shown' END AS action FROM probes WHERE NOT (session_id%4=1 AND hold_ms%13=1)""",
    "rates": """SELECT s_nationkey AS team, s_suppkey AS provider, CAST(5+s_suppkey%40 AS DOUBLE) AS load_s, CAST(1+s_suppkey%23 AS DOUBLE)/200.0 AS per_s FROM supplier""",
    "spoken": """SELECT session_id, event_id, tick_ms, CASE hold_ms%6 WHEN 0 THEN 'yes.' WHEN 1 THEN 'really?"' ELSE 'word' END AS word, CASE WHEN hold_ms%10<8 THEN CAST(FLOOR(tick_ms/2000) AS BIGINT) END AS segment,
 CASE WHEN hold_ms%9<>3 THEN CAST(hold_ms%50 AS DOUBLE)/100.0 END AS no_speech, -CAST(hold_ms%70 AS DOUBLE)/50.0 AS logprob, CASE WHEN hold_ms%4<>1 THEN CAST(hold_ms%101 AS DOUBLE)/100.0 END AS probability FROM probes""",
}


def _in(spark, sf_dir, name):
    return run_sql(spark, sf_dir, re.sub(r'AS "(\w+)"', r"AS `\1`", INPUTS[name]))


def _variants(spark, sf_dir):
    s = _in(spark, sf_dir, "scores")
    return s.filter("variant = 'baseline'"), s.filter("variant <> 'baseline'")


GRID = {"least_margin": [-5, 0, 5, 10], "least_support": [1, 3, 5]}


def cohort_gates(spark, sf_dir):
    base, others = _variants(spark, sf_dir)
    others = others.filter("NOT (variant = 'far' AND session_id = 1)")
    out = E.cohort_gates(base, others, "session_id", "variant")
    return out.select("variant", *(quantized(F.col(c)).alias(c) for c in ("score_delta", "worst_delta", "wrong_delta")), "same_cohort", "mean_gate", "score_gate", "wrong_gate", "passed")


def paired_variants(spark, sf_dir):
    base, others = _variants(spark, sf_dir)
    out = E.paired(others.filter("variant = 'far'"), base, "session_id")
    return out.select("wins", "losses", "ties", quantized(F.col("mean_difference")).alias("mean_difference"))


def parameter_grid(spark, sf_dir):
    return E.grid(spark, GRID)


def grid_neighbours(spark, sf_dir):
    return E.neighbours(E.grid(spark, GRID), {"least_margin": 5, "least_support": 1})


def grid_scores(spark, sf_dir):
    c = F.col
    shown = (c("margin") >= c("least_margin")) & (c("support") >= c("least_support"))
    out = E.tried(_in(spark, sf_dir, "ticks"), E.grid(spark, GRID), ["session_id"], list(GRID), shown, c("truth"))
    return out.select("session_id", *GRID, "net", quantized(c("score")).alias("score"))


def best_configs(spark, sf_dir):
    """The best configuration of each session: highest net, then the smallest parameters."""
    best = grid_scores(spark, sf_dir).groupBy("session_id").agg(F.max(F.struct("net", (-F.col("least_margin")).alias("m"), (-F.col("least_support")).alias("s"))).alias("b"))
    return best.select("session_id", (-F.col("b.m")).alias("least_margin"), (-F.col("b.s")).alias("least_support"), F.col("b.net").alias("net"))


def trace_parity(spark, sf_dir):
    out = E.trace_parity(_in(spark, sf_dir, "ticks"), _in(spark, sf_dir, "replay"), "session_id", ["tick_ms", "event_id"], ["speaker", "action"])
    return out.withColumn("match_ratio", quantized(F.col("match_ratio")))


def tape_checks(spark, sf_dir):
    t = _in(spark, sf_dir, "ticks")
    t = t.withColumns({"seq": F.row_number().over(W.partitionBy("session_id").orderBy("tick_ms", "event_id")) + F.when((F.col("session_id") % 3 == 0) & (F.col("tick_ms") >= 4000), 1).otherwise(0), "clock": F.when((F.col("session_id") % 5 == 2) & (F.col("slot") == 9), 0).otherwise(F.col("tick_ms"))})
    return E.tape_checks(t, "session_id", "seq", "clock", "slot", 69)


def job_violations(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    return E.violations(li, {"positive_quantity": c("l_quantity") > 0, "small_quantity": c("l_quantity") < 45, "discount_in_range": (c("l_discount") >= 0) & (c("l_discount") <= 0.05), "known_flag": c("l_returnflag").isin("A", "N", "R")})


def run_groups(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("artifact", F.when(F.col("user_id") % 3 == 0, F.lit("one")).otherwise(F.col("event_type")))
    return E.run_groups(e, "user_id", "artifact", 20)


def changed_inputs(spark, sf_dir):
    t = frame(spark, sf_dir, "turns").withColumn("digest", F.sha2("text", 256))
    now = t.filter("NOT (session_id % 4 = 1 AND idx = 2)").withColumn("digest", F.when((F.col("session_id") % 5 == 0) & (F.col("idx") == 1), F.lit("x")).otherwise(F.col("digest")))
    return E.changed_inputs(t.filter("NOT (session_id % 7 = 3 AND idx = 0)"), now, ["session_id", "idx"], "session_id", "digest")


def runtime_forecast(spark, sf_dir):
    out = E.forecast(_in(spark, sf_dir, "rates"), ["team"], 2372)
    return out.select("team", "providers", quantized(F.col("raw_s"), 3).alias("raw_s"), quantized(F.col("planned_s"), 3).alias("planned_s"), "status")


def slowest_providers(spark, sf_dir):
    return E.slowest(_in(spark, sf_dir, "rates"), ["team"], "provider", 426, 2).select("team", "provider", quantized(F.col("cost_s"), 3).alias("cost_s"))


def threshold_scan(spark, sf_dir):
    out = E.threshold_scan(_in(spark, sf_dir, "ticks"), F.col("margin"), ~F.col("truth"))
    return out.select("threshold", "selected", "wrong", "correct", "net", *(quantized(F.col(c)).alias(c) for c in ("precision_wrong", "wrong_recall")))


def error_runs(spark, sf_dir):
    return E.runs_of(_in(spark, sf_dir, "ticks"), "session_id", ["tick_ms", "event_id"], ~F.col("truth"), "tick_ms")


def nearest_percentiles(spark, sf_dir):
    return E.nearest_percentiles(frame(spark, sf_dir, "probes"), "session_id", "hold_ms", [0.5, 0.95])


def evidence_scores(spark, sf_dir):
    w = E.segment_groups(_in(spark, sf_dir, "spoken"), "session_id", ["tick_ms", "event_id"], "segment")
    return E.evidence_score(w, ["session_id", "part"]).select("session_id", "part", quantized(F.col("evidence")).alias("evidence"))


def sentence_groups(spark, sf_dir):
    out = E.sentence_groups(_in(spark, sf_dir, "spoken"), "session_id", ["tick_ms", "event_id"], "word", "segment")
    return out.groupBy("session_id", "sentence").agg(F.count(F.lit(1)).alias("words"), F.min("tick_ms").alias("first_ms"), F.max("tick_ms").alias("last_ms"))


def speech_states(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").select("session_id", F.col("tick_ms").alias("start_ms"), (F.col("tick_ms") + F.col("hold_ms") % 390).alias("end_ms"))
    return E.speech_state(p, "session_id", 3000, 9000)


def bounded_ema(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").filter("hold_ms % 4 <> 1").withColumn("v", (F.col("hold_ms") % 100) / 100.0)
    return E.bounded_ema(p, "session_id", ["tick_ms", "event_id"], "tick_ms", "v", 1000).select("session_id", "event_id", quantized(F.col("ema")).alias("ema"))


def section_gaps(spark, sf_dir):
    p = frame(spark, sf_dir, "probes").select("session_id", "event_id", "speaker", F.col("tick_ms").alias("start_ms"), (F.col("tick_ms") + F.col("hold_ms") % 300).alias("end_ms"))
    return E.section_gaps(p, "session_id", "start_ms", "speaker", 2000).select("session_id", "event_id", "silent_ms")


def first_parity(spark, sf_dir):
    out = E.first_parity(frame(spark, sf_dir, "sentences"), "session_id", "idx", "embedding", V.cosine)
    return out.select("session_id", "rows", quantized(F.col("parity")).alias("parity"))


def frame_speech(spark, sf_dir):
    s = frame(spark, sf_dir, "sentences").withColumn("samples", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, (F.lit(40) + F.col("idx") % 20).cast("int")))
    flags = E.frame_speech(F.col("samples"), 16, 0.13)
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.size("samples")) + 1e-12
    return s.select("session_id", "idx", F.size(flags).alias("frames"), F.size(F.filter(flags, lambda f: f)).alias("loud"), quantized(rms).alias("rms"), quantized(F.array_max(F.transform("samples", F.abs))).alias("peak"))


def newest_sentences(spark, sf_dir):
    return E.newest(frame(spark, sf_dir, "sentences"), "session_id", ["idx"], 5).select("session_id", "idx", "speaker")


def distinct_labels(spark, sf_dir):
    """Labels of a session in the order in which they first occur."""
    s = frame(spark, sf_dir, "sentences").groupBy("session_id", "speaker").agg(F.min("idx").alias("first_idx"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("first_idx")))


def empty_profiles(spark, sf_dir):
    """Labels S1 to S12 that no row of the session has, but for the seed S1 and the locked S7."""
    s = frame(spark, sf_dir, "sentences")
    labels = s.select("session_id").distinct().select("session_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.lit("S"), k.cast("string")))).alias("speaker"))
    return labels.filter(~F.col("speaker").isin("S1", "S7")).join(s, ["session_id", "speaker"], "left_anti")


def unclaimed_sessions(spark, sf_dir):
    """Sessions with text that an earlier scan, of even ones, had not seen."""
    t = frame(spark, sf_dir, "turns")
    saved = t.filter("trim(text) <> ''").select("session_id").distinct()
    return saved.join(saved.filter("session_id % 2 = 0"), "session_id", "left_anti")


def last_names(spark, sf_dir):
    """The last name that each label of a session was given."""
    t = frame(spark, sf_dir, "turns").withColumn("name", F.concat("speaker", F.lit(" "), (F.col("idx") % 4).cast("string")))
    return t.groupBy("session_id", "speaker").agg(F.max_by("name", "idx").alias("name"))


def scopes_left(spark, sf_dir):
    """Scopes of up to three sessions that remain once session 5 is deleted."""
    t = frame(spark, sf_dir, "turns").select("session_id").distinct()
    scopes = t.select(F.explode(F.array(*(F.struct((F.col("session_id") - k).alias("scope"), "session_id") for k in range(3)))).alias("x")).select("x.*")
    return scopes.groupBy("scope").agg(F.bool_or(F.col("session_id") == 5).alias("gone"), F.count(F.lit(1)).alias("sessions")).filter("NOT gone").drop("gone")


def probe_scores(spark, sf_dir):
    out = E.probe_score(PI.session_scorecard(spark, sf_dir), PI.turn_latency(spark, sf_dir), "session_id")
    return out.select("session_id", quantized(F.col("first_score")).alias("first_score"), quantized(F.col("change_score")).alias("change_score"), quantized(F.col("probe_score")).alias("probe_score"))


def _q(x: str, k: int = 6) -> str:
    return f"floor(({x}) * {10**k}.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / {10**k}.0::DOUBLE"


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


_GRID = "g AS (SELECT m AS least_margin, s AS least_support FROM (SELECT unnest([-5, 0, 5, 10]) AS m) a, (SELECT unnest([1, 3, 5]) AS s) b)"
_TRIED = f"{_with('ticks')}, {_GRID}, r AS (SELECT session_id, least_margin, least_support, CAST(sum(CASE WHEN margin >= least_margin AND support >= least_support THEN CASE WHEN truth THEN 1 ELSE -1 END ELSE 0 END) AS BIGINT) AS net, count(*) AS n FROM ticks, g GROUP BY ALL)"
_STEPS = "row_number() OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) AS n"
_SEGMENTS = f"{_with('spoken')}, s AS (SELECT *, lag(segment) OVER w AS ps, lag(word) OVER w AS pw, row_number() OVER w AS k FROM spoken WINDOW w AS (PARTITION BY session_id ORDER BY tick_ms, event_id))"
_SUM2 = "list_sum(list_transform({x}, lambda v: v * v))"

SQL = {
    "cohort_gates": f"""{_with("scores")}, b AS (SELECT * FROM scores WHERE variant = 'baseline'), c AS (SELECT * FROM scores WHERE variant <> 'baseline' AND NOT (variant = 'far' AND session_id = 1)), d AS (SELECT c.variant, avg(c.score) - avg(b.score) AS s, min(c.score - b.score) AS w, max(c.wrong - b.wrong) AS r, count(*) = (SELECT count(*) FROM b) AS same_cohort FROM c JOIN b ON c.session_id = b.session_id GROUP BY c.variant)
SELECT variant, {_q('s')} AS score_delta, {_q('w')} AS worst_delta, {_q('r')} AS wrong_delta, same_cohort, s >= -0.005 - 1e-12 AS mean_gate, w >= -0.005 - 1e-12 AS score_gate, r <= 0.005 + 1e-12 AS wrong_gate, same_cohort AND s >= -0.005 - 1e-12 AND w >= -0.005 - 1e-12 AND r <= 0.005 + 1e-12 AS passed FROM d""",
    "paired_variants": f"""{_with("scores")}, d AS (SELECT round(a.score - b.score, 9) AS d FROM scores a JOIN scores b ON a.session_id = b.session_id WHERE a.variant = 'far' AND b.variant = 'baseline') SELECT count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties, {_q('avg(d)')} AS mean_difference FROM d""",
    "parameter_grid": f"WITH {_GRID} SELECT * FROM g",
    "grid_neighbours": f"WITH {_GRID} SELECT DISTINCT least_margin + m AS least_margin, least_support + s AS least_support FROM g, (VALUES (-5, 0), (5, 0), (0, -1), (0, 1)) v(m, s)",
    "grid_scores": f"{_TRIED} SELECT session_id, least_margin, least_support, net, {_q('net::DOUBLE / n')} AS score FROM r",
    "best_configs": f"{_TRIED} SELECT session_id, least_margin, least_support, net FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY net DESC, least_margin, least_support) AS k FROM r) WHERE k = 1",
    "trace_parity": f"""{_with("ticks", "replay")}, a AS (SELECT session_id, {_STEPS}, speaker, action FROM ticks), b AS (SELECT session_id, {_STEPS}, speaker, action FROM replay), j AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.n, b.n) AS n, a.n IS NOT NULL AS l, b.n IS NOT NULL AS r, coalesce(a.speaker = b.speaker AND a.action = b.action, false) AS same FROM a FULL JOIN b ON a.session_id = b.session_id AND a.n = b.n)
SELECT session_id, count(*) FILTER (WHERE l) AS left_steps, count(*) FILTER (WHERE r) AS right_steps, count(*) FILTER (WHERE l AND r) AS compared, count(*) FILTER (WHERE NOT same) AS mismatches, CAST(min(n) FILTER (WHERE NOT same) AS INT) AS first_mismatch, {_q("coalesce(count(*) FILTER (WHERE same) / nullif(count(*) FILTER (WHERE l AND r), 0)::DOUBLE, 0)")} AS match_ratio, count(*) FILTER (WHERE NOT same) = 0 AS exact FROM j GROUP BY session_id""",
    "tape_checks": f"""{_with("ticks")}, m AS (SELECT session_id, tick_ms, event_id, slot, CASE WHEN session_id % 5 = 2 AND slot = 9 THEN 0 ELSE tick_ms END AS clock FROM ticks), c AS (SELECT *, lag(clock) OVER (PARTITION BY session_id ORDER BY tick_ms, event_id) AS p FROM m) SELECT session_id, NOT (session_id % 3 = 0 AND bool_or(tick_ms >= 4000)) AS sequence_ok, bool_and(p IS NULL OR clock >= p) AS clock_ok, bool_and(slot >= 0 AND slot < 69) AS index_ok FROM c GROUP BY session_id""",
    "job_violations": "SELECT unnest(['positive_quantity', 'small_quantity', 'discount_in_range', 'known_flag']) AS \"check\", unnest([a, b, c, d]) AS rows FROM (SELECT count(*) FILTER (WHERE NOT l_quantity > 0) AS a, count(*) FILTER (WHERE NOT l_quantity < 45) AS b, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS c, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS d FROM lineitem)",
    "run_groups": "SELECT user_id, count(*) AS runs, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'one' ELSE event_type END) AS artifacts FROM events GROUP BY user_id HAVING count(*) >= 20 AND count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'one' ELSE event_type END) = 1",
    "changed_inputs": """WITH a AS (SELECT session_id, idx, sha256(text) AS d FROM turns WHERE NOT (session_id % 7 = 3 AND idx = 0)), b AS (SELECT session_id, idx, CASE WHEN session_id % 5 = 0 AND idx = 1 THEN 'x' ELSE sha256(text) END AS d FROM turns WHERE NOT (session_id % 4 = 1 AND idx = 2)), j AS (SELECT coalesce(a.session_id, b.session_id) AS session_id, a.d AS x, b.d AS y FROM a FULL JOIN b ON a.session_id = b.session_id AND a.idx = b.idx)
SELECT session_id, count(*) FILTER (WHERE x <> y) AS changed, count(*) FILTER (WHERE y IS NULL) AS gone, count(*) FILTER (WHERE x IS NULL) AS new, bool_and(x IS NOT DISTINCT FROM y) AS unchanged FROM j GROUP BY session_id""",
    "runtime_forecast": f"""{_with("rates")}, f AS (SELECT team, count(*) AS providers, sum(load_s + 2372 / per_s) AS raw FROM rates GROUP BY team) SELECT team, providers, {_q('raw', 3)} AS raw_s, {_q('raw * 1.5::DOUBLE', 3)} AS planned_s, CASE WHEN raw * 1.5::DOUBLE > 86400 THEN 'hard_limit_exceeded' WHEN raw * 1.5::DOUBLE > 64800 THEN 'planning_limit_exceeded' ELSE 'within_planning_limit' END AS status FROM f""",
    "slowest_providers": f"""{_with("rates")} SELECT team, provider, {_q('load_s + 426 / per_s', 3)} AS cost_s FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY load_s + 426 / per_s DESC, provider) AS n FROM rates) WHERE n <= 2""",
    "threshold_scan": f"""{_with("ticks")}, v AS (SELECT CAST(margin AS DOUBLE) AS threshold, count(*) FILTER (WHERE NOT truth) AS w, count(*) FILTER (WHERE truth) AS r FROM ticks GROUP BY margin), s AS (SELECT threshold, CAST(sum(w) OVER (ORDER BY threshold) AS BIGINT) AS wrong, CAST(sum(r) OVER (ORDER BY threshold) AS BIGINT) AS correct, CAST(sum(w) OVER () AS BIGINT) AS whole FROM v) SELECT threshold, wrong + correct AS selected, wrong, correct, wrong - correct AS net, {_q('wrong::DOUBLE / greatest(1, wrong + correct)')} AS precision_wrong, {_q('wrong::DOUBLE / greatest(1, whole)')} AS wrong_recall FROM s WHERE wrong + correct >= 3 ORDER BY wrong - correct DESC, wrong::DOUBLE / (wrong + correct) DESC, threshold LIMIT 12""",
    "error_runs": f"""{_with("ticks")}, m AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY session_id, truth ORDER BY tick_ms, event_id) AS island FROM ticks WINDOW w AS (PARTITION BY session_id ORDER BY tick_ms, event_id)), g AS (SELECT session_id, island, count(*) AS rows, min(tick_ms) AS first_ms, max(tick_ms) AS last_ms FROM m WHERE NOT truth GROUP BY ALL) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first_ms) AS run, rows, first_ms, last_ms FROM g""",
    "nearest_percentiles": "WITH r AS (SELECT session_id, hold_ms, row_number() OVER (PARTITION BY session_id ORDER BY hold_ms) - 1 AS n, count(*) OVER (PARTITION BY session_id) AS c FROM probes) SELECT session_id, max(hold_ms) FILTER (WHERE n = round_even((c - 1) * 0.5::DOUBLE, 0)) AS p50, max(hold_ms) FILTER (WHERE n = round_even((c - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY session_id",
    "evidence_scores": f"""{_SEGMENTS}, g AS (SELECT *, CAST(sum(CASE WHEN k = 1 OR (segment IS NOT NULL AND segment = ps) THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY k) AS BIGINT) AS part FROM s), a AS (SELECT session_id, part, max(no_speech) AS n, min(logprob) AS l, avg(ln(greatest(0.0001::DOUBLE, least(1, probability)))) AS w FROM g GROUP BY ALL) SELECT session_id, part, {_q("exp(0.35::DOUBLE * ln(greatest(0.0001::DOUBLE, least(1, 1 - n))) + 0.35::DOUBLE * ln(greatest(0.0001::DOUBLE, least(1, exp(l)))) + 0.30::DOUBLE * ln(greatest(0.0001::DOUBLE, exp(w))))")} AS evidence FROM a""",
    "sentence_groups": rf"""{_SEGMENTS}, g AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(trim(pw), '[.!?]["''\])]*\s*$') OR (ps IS NOT NULL AND segment IS NOT NULL AND ps <> segment) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY k) AS BIGINT) AS sentence FROM s) SELECT session_id, sentence, count(*) AS words, min(tick_ms) AS first_ms, max(tick_ms) AS last_ms FROM g GROUP BY ALL""",
    "speech_states": """WITH c AS (SELECT session_id, greatest(tick_ms, 3000) AS s, least(tick_ms + hold_ms % 390, 9000) AS e FROM probes), k AS (SELECT session_id, min(s) AS speech_start, arg_max(e, struct_pack(a := s, b := e)) AS speech_end, CAST(sum(e - s) AS BIGINT) AS speech_ms FROM c WHERE e > s GROUP BY session_id) SELECT *, greatest(0, 9000 - speech_end) AS silence_ms, 9000 - speech_end >= 600 AS flush FROM k WHERE speech_ms >= 180""",
    "bounded_ema": f"""WITH p AS (SELECT *, (hold_ms % 100) / 100.0::DOUBLE AS v FROM probes WHERE hold_ms % 4 <> 1), l AS (SELECT session_id, event_id, v, CASE WHEN tick_ms - lag(tick_ms, 1) OVER w <= 1000 THEN lag(v, 1) OVER w END AS a, CASE WHEN tick_ms - lag(tick_ms, 2) OVER w <= 1000 THEN lag(v, 2) OVER w END AS b FROM p WINDOW w AS (PARTITION BY session_id ORDER BY tick_ms, event_id)) SELECT session_id, event_id, {_q("CASE WHEN a IS NULL THEN v WHEN b IS NULL THEN 0.55::DOUBLE * v + (1 - 0.55::DOUBLE) * a ELSE 0.55::DOUBLE * v + (1 - 0.55::DOUBLE) * (0.55::DOUBLE * a + (1 - 0.55::DOUBLE) * b) END")} AS ema FROM l""",
    "section_gaps": "WITH h AS (SELECT session_id, event_id, tick_ms - max(tick_ms + hold_ms % 300) OVER (PARTITION BY session_id, speaker ORDER BY tick_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS silent_ms FROM probes) SELECT * FROM h WHERE silent_ms >= 2000",
    "first_parity": f"WITH f AS (SELECT session_id, arg_min(embedding, idx) AS f FROM sentences GROUP BY session_id) SELECT s.session_id, count(*) AS rows, {_q('min(list_dot_product(embedding::DOUBLE[], f::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(f::DOUBLE[], f::DOUBLE[]))))')} AS parity FROM sentences s JOIN f ON s.session_id = f.session_id GROUP BY s.session_id",
    "frame_speech": f"""WITH s AS (SELECT session_id, idx, (embedding::DOUBLE[])[1 : 40 + idx % 20] AS x FROM sentences), p AS (SELECT *, list_transform(list_filter([x[1:16], x[17:32], x[33:48], x[49:64]], lambda f: len(f) >= 8), lambda f: sqrt({_SUM2.format(x='f')} / len(f)) >= 0.13) AS flags FROM s) SELECT session_id, idx, CAST(len(flags) AS INT) AS frames, CAST(len(list_filter(flags, lambda f: f)) AS INT) AS loud, {_q(f"sqrt({_SUM2.format(x='x')} / len(x)) + 1e-12")} AS rms, {_q("list_max(list_transform(x, lambda v: abs(v)))")} AS peak FROM p""",
    "newest_sentences": "SELECT session_id, idx, speaker FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS n FROM sentences) WHERE n <= 5",
    "distinct_labels": "SELECT session_id, speaker, min(idx) AS first_idx, CAST(row_number() OVER (PARTITION BY session_id ORDER BY min(idx)) AS INT) AS place FROM sentences GROUP BY session_id, speaker",
    "empty_profiles": "SELECT session_id, 'S' || k AS speaker FROM (SELECT DISTINCT session_id FROM sentences), (SELECT unnest(range(1, 13)) AS k) WHERE k NOT IN (1, 7) AND (session_id, 'S' || k) NOT IN (SELECT (session_id, speaker) FROM sentences)",
    "unclaimed_sessions": "SELECT DISTINCT session_id FROM turns WHERE trim(text) <> '' AND session_id % 2 <> 0",
    "last_names": "SELECT session_id, speaker, arg_max(speaker || ' ' || CAST(idx % 4 AS VARCHAR), idx) AS name FROM turns GROUP BY session_id, speaker",
    "scopes_left": "WITH s AS (SELECT DISTINCT session_id FROM turns) SELECT session_id - k AS scope, count(*) AS sessions FROM s, (SELECT unnest(range(3)) AS k) GROUP BY scope HAVING NOT bool_or(session_id = 5)",
    "probe_scores": f"WITH card AS ({PI.SQL['session_scorecard']}), latency AS ({PI.SQL['turn_latency']}), m AS (SELECT session_id, avg(score) AS f, coalesce(avg(score) FILTER (WHERE changed), 1) AS c FROM latency GROUP BY session_id), j AS (SELECT card.*, coalesce(f, 0) AS f, coalesce(c, 0) AS c FROM card LEFT JOIN m ON card.session_id = m.session_id) SELECT session_id, {_q('f')} AS first_score, {_q('c')} AS change_score, {_q('greatest(0, least(1, 0.35::DOUBLE * f1 + 0.25::DOUBLE * f + 0.25::DOUBLE * c + 0.15::DOUBLE * coalesce(correct_ms / nullif(correct_ms + wrong_ms, 0)::DOUBLE, 0) - least(0.15::DOUBLE, wrong_ms / truth_ms::DOUBLE)))')} AS probe_score FROM j",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
