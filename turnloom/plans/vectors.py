"""Queries over vectors: sentences of sessions with speaker labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import vectors as VF
from turnloom.functions.numbers import duration_quality, quantized
from turnloom.operators import vectors as V
from turnloom.plans.views import frame, with_views


def _s(spark, sf_dir):
    return frame(spark, sf_dir, "sentences")


def _weight():
    return F.sqrt(F.greatest(F.lit(0.2), F.least(F.lit(2.25), F.col("duration_ms") / 1000.0)))


def _profiles(spark, sf_dir):
    return V.weighted_centroids(_s(spark, sf_dir), ["session_id", "speaker"], "embedding", _weight()).withColumnRenamed("speaker", "label")


def weighted_centroids(spark, sf_dir):
    return _profiles(spark, sf_dir).select("session_id", "label", "rows", quantized(F.col("weight")).alias("weight"), VF.rounded(F.col("centroid")).alias("centroid"))


def score_existing(spark, sf_dir):
    s = _s(spark, sf_dir).select("session_id", "idx", "embedding")
    a = V.assigned(V.scores(s, _profiles(spark, sf_dir), ["session_id"]), ["session_id", "idx"])
    return a.select("session_id", "idx", "top_label", quantized(F.col("top_similarity")).alias("top_similarity"), quantized(F.col("margin")).alias("margin"), "assigned")


def softmax_probabilities(spark, sf_dir):
    s = _s(spark, sf_dir).select("session_id", "idx", "embedding")
    p = V.probabilities(V.scores(s, _profiles(spark, sf_dir), ["session_id"]), ["session_id", "idx"])
    return p.select("session_id", "idx", "label", quantized(F.col("probability")).alias("probability"))


def prototype_topn(spark, sf_dir):
    s = _s(spark, sf_dir)
    return V.prototypes(s, ["session_id", "speaker"], F.col("duration_ms"), "idx", 3).select("session_id", "speaker", "place", "idx", "duration_ms")


def prototype_score(spark, sf_dir):
    s = _s(spark, sf_dir)
    protos = V.prototypes(s, ["session_id", "speaker"], F.col("duration_ms"), "idx", 4).withColumnRenamed("speaker", "label")
    p = V.prototype_scores(s.select("session_id", "idx", "embedding"), protos, ["session_id"], ["idx"], top_k=2)
    return p.select("session_id", "idx", "label", quantized(F.col("score")).alias("score"))


def prototype_revisions(spark, sf_dir):
    """Rows whose best prototype score belongs to another label than their own, by a margin."""
    p, s = prototype_score(spark, sf_dir), _s(spark, sf_dir).select("session_id", "idx", "speaker")
    best = p.groupBy("session_id", "idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b"))
    own = p.join(s, ["session_id", "idx"]).filter("label = speaker").select("session_id", "idx", "speaker", F.col("score").alias("own"))
    rows = best.join(own, ["session_id", "idx"]).filter("b.label <> speaker").withColumn("gain", quantized(-F.col("b.s") - F.col("own")))
    return rows.filter("gain >= 0.08").select("session_id", "idx", "speaker", F.col("b.label").alias("revised"), "gain")


def leave_one_out(spark, sf_dir):
    r = V.leave_one_out(_s(spark, sf_dir), ["session_id", "speaker"], "idx")
    return r.select("session_id", "speaker", "idx", quantized(F.col("similarity")).alias("similarity"))


def mad_outliers(spark, sf_dir):
    s, p = _s(spark, sf_dir), _profiles(spark, sf_dir).select("session_id", F.col("label").alias("speaker"), "centroid")
    near = s.join(p, ["session_id", "speaker"]).withColumn("similarity", quantized(VF.cosine(F.col("embedding"), F.col("centroid"))))
    lim = V.outlier_limits(near, ["session_id", "speaker"], "similarity")
    rows = near.join(lim, ["session_id", "speaker"]).filter("similarity < cut")
    return rows.select("session_id", "speaker", "idx", "similarity", quantized(F.col("cut")).alias("cut"))


def medoids(spark, sf_dir):
    m = V.medoids(_s(spark, sf_dir), ["session_id", "speaker"], "idx")
    return m.select("session_id", "speaker", "idx", quantized(F.col("mean_similarity")).alias("mean_similarity"))


def cosine_topk(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    r = V.nearest(e.filter("vec_id % 50 = 0"), e, 5, "vec_id", "vec_id")
    return r.select("query", "match", "place", quantized(F.col("similarity")).alias("similarity"))


def gallery_match(spark, sf_dir):
    s = _s(spark, sf_dir)
    samples = s.filter("idx % 2 = 0").select("session_id", F.col("speaker").alias("person"), F.col("idx").alias("sample"), "embedding")
    r = V.gallery_match(s.filter("idx % 2 = 1").select("session_id", "idx", "embedding"), samples, ["session_id"], "idx", least_similarity=0.2, least_margin=0.02)
    return r.select("session_id", "idx", quantized(F.col("score")).alias("score"), "person")


def duplicate_profiles(spark, sf_dir):
    d = V.duplicate_profiles(_profiles(spark, sf_dir).select("session_id", "label", "centroid"), ["session_id"], 0.2)
    return d.select("session_id", "label_a", "label_b", quantized(F.col("similarity")).alias("similarity"))


def stack_blend(spark, sf_dir):
    s = _s(spark, sf_dir)
    short, long = F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)
    return s.select("session_id", "idx", VF.rounded(VF.blended(short, long, 0.25)).alias("blend"), VF.rounded(VF.stacked([short, long], [1.0, 0.5])).alias("stack"), quantized(VF.cosine_margin(short, long, F.slice("embedding", 17, 8))).alias("margin"), quantized(duration_quality(F.col("duration_ms"))).alias("quality"))


def time_groups(spark, sf_dir):
    """Clusters of each speaker's sentences separated by more than 8 s."""
    from pyspark.sql import Window as W

    s = _s(spark, sf_dir).withColumn("end_ms", F.sum("duration_ms").over(W.partitionBy("session_id").orderBy("idx"))).withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))
    pause = F.col("start_ms") - F.lag("end_ms").over(W.partitionBy("session_id", "speaker").orderBy("idx"))
    return s.withColumn("new", F.when(pause.isNull() | (pause > 8000), 1).otherwise(0)).groupBy("session_id", "speaker").agg(F.sum("new").alias("time_groups"), F.count(F.lit(1)).alias("rows"))


def _q(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1000000.0::DOUBLE"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


_V = "v AS (SELECT session_id, idx, speaker, duration_ms, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(greatest(0.2, least(2.25, duration_ms / 1000.0))) AS w FROM sentences)"
_CENT = f"""{_V}, dims AS (SELECT session_id, speaker AS label, i, sum(e[i] * w) / sum(w) AS m, count(*) AS n, sum(w) AS sw FROM v, (SELECT unnest(range(1, 65)) AS i) d GROUP BY ALL),
raw AS (SELECT session_id, label, list(m ORDER BY i) AS c, max(n) AS rows, max(sw) AS weight FROM dims GROUP BY session_id, label),
profiles AS (SELECT session_id, label, rows, weight, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS centroid FROM raw)"""
_SCORED = f"{_CENT}, scored AS (SELECT v.session_id, v.idx, p.label, {_cos('v.e', 'p.centroid')} AS s FROM v JOIN profiles p ON v.session_id = p.session_id)"
_PROTO = f"""{_V}, protos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY duration_ms DESC, idx) AS place FROM v) WHERE place <= 4),
pd AS (SELECT session_id, speaker AS label, i, avg(e[i]) AS m FROM protos, (SELECT unnest(range(1, 65)) AS i) d GROUP BY ALL),
pc AS (SELECT session_id, label, list(m ORDER BY i) AS c FROM pd GROUP BY ALL),
pairs AS (SELECT v.session_id, v.idx, p.speaker AS label, {_cos('v.e', 'p.e')} AS c FROM v JOIN protos p ON v.session_id = p.session_id),
tops AS (SELECT session_id, idx, label, avg(c) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY session_id, idx, label ORDER BY c DESC) AS r FROM pairs) WHERE r <= 2 GROUP BY ALL),
pscore AS (SELECT t.session_id, t.idx, t.label, {_q(f"(1 - 0.555::DOUBLE) * mean + 0.555::DOUBLE * ({_cos('v.e', 'pc.c')})")} AS score FROM tops t JOIN v ON t.session_id = v.session_id AND t.idx = v.idx JOIN pc ON t.session_id = pc.session_id AND t.label = pc.label)"""

SQL = {
    "weighted_centroids": f"WITH {_CENT} SELECT session_id, label, rows, {_q('weight')} AS weight, list_transform(centroid, lambda x: {_q('x')}) AS centroid FROM profiles",
    "score_existing": f"WITH {_SCORED}, r AS (SELECT session_id, idx, list(label ORDER BY s DESC, label)[1] AS top_label, list(s ORDER BY s DESC, label) AS l FROM scored GROUP BY ALL), m AS (SELECT session_id, idx, top_label, l[1] AS t, coalesce(l[1] - l[2], 1.0) AS g FROM r) SELECT session_id, idx, top_label, {_q('t')} AS top_similarity, {_q('g')} AS margin, CASE WHEN t >= 0.43 AND g >= 0.03 THEN top_label END AS assigned FROM m",
    "softmax_probabilities": f"WITH {_SCORED}, u AS (SELECT * FROM scored UNION ALL SELECT DISTINCT session_id, idx, NULL, 0.3::DOUBLE FROM scored), x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY session_id, idx)) / 0.07::DOUBLE) AS e FROM (SELECT session_id, idx, label, s FROM u)), y AS (SELECT session_id, idx, label, e / sum(e) OVER (PARTITION BY session_id, idx) AS p FROM x) SELECT session_id, idx, label, {_q('p')} AS probability FROM y",
    "prototype_topn": "SELECT session_id, speaker, place, idx, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY duration_ms DESC, idx) AS place FROM sentences) WHERE place <= 3",
    "prototype_score": f"WITH {_PROTO} SELECT * FROM pscore",
    "prototype_revisions": f"WITH {_PROTO}, best AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY score DESC, label) AS r FROM pscore), own AS (SELECT p.session_id, p.idx, v.speaker, p.score AS own FROM pscore p JOIN v ON p.session_id = v.session_id AND p.idx = v.idx AND p.label = v.speaker) SELECT b.session_id, b.idx, o.speaker, b.label AS revised, {_q('b.score - o.own')} AS gain FROM best b JOIN own o ON b.session_id = o.session_id AND b.idx = o.idx WHERE b.r = 1 AND b.label <> o.speaker AND {_q('b.score - o.own')} >= 0.08",
    "leave_one_out": f"WITH {_V}, t AS (SELECT session_id, speaker, i, sum(e[i]) AS t, count(*) AS n FROM v, (SELECT unnest(range(1, 65)) AS i) d GROUP BY ALL), s AS (SELECT session_id, speaker, list(t ORDER BY i) AS total, max(n) AS n FROM t GROUP BY session_id, speaker), o AS (SELECT v.session_id, v.speaker, v.idx, v.e, list_transform(range(1, 65), lambda i: total[i] - v.e[i]) AS o, n FROM v JOIN s ON v.session_id = s.session_id AND v.speaker = s.speaker) SELECT session_id, speaker, idx, CASE WHEN n > 1 THEN {_q(_cos('e', 'o'))} END AS similarity FROM o",
    "mad_outliers": f"WITH {_CENT}, near AS (SELECT v.session_id, v.speaker, v.idx, {_q(_cos('v.e', 'p.centroid'))} AS similarity FROM v JOIN profiles p ON v.session_id = p.session_id AND v.speaker = p.label), mid AS (SELECT session_id, speaker, median(similarity) AS m FROM near GROUP BY ALL), dev AS (SELECT n.session_id, n.speaker, any_value(m) AS m, median(abs(similarity - m)) AS d FROM near n JOIN mid USING (session_id, speaker) GROUP BY ALL) SELECT n.session_id, n.speaker, n.idx, similarity, {_q('m - greatest(0.08::DOUBLE, 3 * d)')} AS cut FROM near n JOIN dev USING (session_id, speaker) WHERE similarity < m - greatest(0.08::DOUBLE, 3 * d)",
    "medoids": f"WITH {_V}, pairs AS (SELECT a.session_id, a.speaker, a.idx, avg({_cos('a.e', 'b.e')}) AS m FROM v a JOIN v b ON a.session_id = b.session_id AND a.speaker = b.speaker GROUP BY ALL) SELECT session_id, speaker, idx, {_q('m')} AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY {_q('m')} DESC, idx) AS r FROM pairs) WHERE r = 1",
    "cosine_topk": f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, r.vec_id AS match, {_cos('q.e', 'r.e')} AS s FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, match) AS place FROM p) SELECT query, match, place, {_q('s')} AS similarity FROM k WHERE place <= 5",
    "gallery_match": f"""WITH {_V}, pairs AS (SELECT q.session_id, q.idx, s.speaker AS person, s.idx AS sample, s.e, {_cos('q.e', 's.e')} AS c FROM v q JOIN v s ON q.session_id = s.session_id WHERE q.idx % 2 = 1 AND s.idx % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx, person ORDER BY c DESC, sample) AS place FROM pairs), best AS (SELECT * FROM ranked WHERE place = 1),
second AS (SELECT r.session_id, r.idx, r.person, max(r.c) AS second FROM ranked r JOIN best b ON r.session_id = b.session_id AND r.idx = b.idx AND r.person = b.person WHERE r.place > 1 AND r.c >= 0.2 AND {_cos('r.e', 'b.e')} < 0.995 GROUP BY ALL),
scored AS (SELECT b.session_id, b.idx, b.person, b.c + coalesce(least(0.025::DOUBLE, 0.025::DOUBLE * s.second), 0) AS s FROM best b LEFT JOIN second s ON b.session_id = s.session_id AND b.idx = s.idx AND b.person = s.person),
r AS (SELECT session_id, idx, list(person ORDER BY s DESC, person)[1] AS p, list(s ORDER BY s DESC, person) AS l FROM scored GROUP BY ALL)
SELECT session_id, idx, {_q('l[1]')} AS score, CASE WHEN l[1] >= 0.2 AND coalesce(l[1] - l[2], 1.0) >= 0.02 THEN p END AS person FROM r""",
    "duplicate_profiles": f"WITH {_CENT}, x AS (SELECT a.session_id, a.label AS label_a, b.label AS label_b, {_cos('a.centroid', 'b.centroid')} AS s FROM profiles a JOIN profiles b ON a.session_id = b.session_id AND a.label < b.label) SELECT session_id, label_a, label_b, {_q('s')} AS similarity FROM x WHERE s >= 0.2",
    "stack_blend": f"""WITH {_V}, p AS (SELECT session_id, idx, duration_ms, e[1:8] AS a, e[9:16] AS b, e[17:24] AS c FROM v), x AS (SELECT *, list_transform(range(1, 9), lambda i: a[i] * 0.75::DOUBLE + b[i] * 0.25::DOUBLE) AS m, list_concat(list_transform(a, lambda y: y / sqrt(list_dot_product(a, a))), list_transform(b, lambda y: y / sqrt(list_dot_product(b, b)) * 0.5::DOUBLE)) AS k FROM p)
SELECT session_id, idx, list_transform(m, lambda y: {_q('y / sqrt(list_dot_product(m, m))')}) AS blend, list_transform(k, lambda y: {_q('y / sqrt(list_dot_product(k, k))')}) AS stack, {_q(f"({_cos('a', 'c')}) - ({_cos('a', 'b')})")} AS margin, {_q('greatest(0.25, least(1.0, (duration_ms / 1000.0 - 0.45) / 2.15))')} AS quality FROM x""",
    "time_groups": "WITH s AS (SELECT session_id, speaker, idx, sum(duration_ms) OVER (PARTITION BY session_id ORDER BY idx) AS e, duration_ms FROM sentences), p AS (SELECT *, e - duration_ms - lag(e) OVER (PARTITION BY session_id, speaker ORDER BY idx) AS pause FROM s) SELECT session_id, speaker, CAST(sum(CASE WHEN pause IS NULL OR pause > 8000 THEN 1 ELSE 0 END) AS BIGINT) AS time_groups, count(*) AS rows FROM p GROUP BY ALL",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
