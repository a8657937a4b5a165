"""Quality rules, mixing, language identification, the quality classifier and the registered queries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from turnloom.llm import language, mixing, quality, rules
from turnloom.llm.queries import oracle_sql, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules ---


def counted(text):
    text = text or ""
    words = SPACE.findall(text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            twice += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(repeated)


def rule_rows():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a b c d e " * 5), (4, "x\nx\n x\n\n\nx"), (5, "É# 字|字 " * 3), (6, " ".join(f"w{k % 9000}" for k in range(20000)))]
    return rows + [(10 + k, "".join(rng.choices(["a", "b", "c", " ", " ", "\n", "#", "\x0b", "\x1c", " "], k=rng.randrange(400)))) for k in range(80)]


def test_rule_counts(spark):
    rows = rule_rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, quality string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        n, chars, symbols, lines, repeats = counted(t)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), i
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and r.kept == (not r.base_failed)
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 10, 400, 3000) for k in (0, 1, 3, n // 2) if k <= n]
    out = spark.createDataFrame(rows, "k long, n long").withColumn("p", rules.binomial_tail(*map(rules.F.col, ("k", "n")), 0.01)).collect()
    for r in out:
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.01 else 1.0
        assert abs(r.p - exact) < 1e-9 * max(1, exact)


def test_cutoffs_reject_outliers_and_keep_good_documents(spark):
    rng = random.Random(1)
    good = [(k, " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(50))) for k in range(1200)]
    bad = [(5000 + k, " ".join("".join(rng.choices("abc#$", k=4)) for _ in range(50))) for k in range(30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (7, None), (7, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert all(out[i].kept for i, _ in good)
    assert not any(out[i].kept for i, _ in bad) and out[5000].reasons == ["symbols"]
    # The same by the query's SQL, where the cutoffs decide.
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    sql = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op6_quality_rules']})").fetchall())
    assert sql == Counter(tuple(r[n] for n in names) for r in out.values()) and sum(not k[-1] for k in sql) >= 30


# --- mixing ---


def dealt(sizes, seats):
    """Sainte-Lague by its definition: one seat after another to the highest quotient."""
    won = [0] * len(sizes)
    for _ in range(seats):
        k = max(range(len(sizes)), key=lambda i: (sizes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment(spark):
    rng = random.Random(3)
    for seats, sizes in [(7, [5, 5, 5]), (0, [3, 4]), (100, [rng.randrange(1, 1000) for _ in range(12)]), (5, [1] * 9), (50, [10**6, 1, 1])]:
        parts = spark.createDataFrame([(k, float(s), seats) for k, s in enumerate(sizes)], "k long, w double, seats long")
        out = mixing.apportioned(parts, [], ["k"], "w", "seats")
        assert [r.quota for r in out.orderBy("k").collect()] == dealt(sizes, seats)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(0, 80), rng.choice(["a", "b", "b", "b", "B", None])) for k in range(3000)] + [(3000, None, "a"), (None, "w w", "b"), (5, "w", "b"), (5000, "x " * 50000, "big")]
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, target string, size int").repartition(7)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    whole, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        whole[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == whole[r.source] for r in out)
    assert abs(sum(target.values()) - 1.5 * sum(whole.values())) < 1e-6
    for s in whole:
        assert target[s] <= 2 * whole[s] + 1e-9 and abs(taken[s] - target[s]) <= 32 * (2 + 3), s
    # B 5, a 2, b 1, big 5, null 2: what is above twice a size goes to the others by weight
    weight, open_, left = {"B": 5, "a": 2, "b": 1, "big": 5, None: 2}, set(whole), 1.5 * sum(whole.values())
    want = {}
    while any(over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * whole[s]]):
        for s in over:
            want[s] = 2 * whole[s]
            open_.discard(s)
        left = 1.5 * sum(whole.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in want)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_spreads_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "w " * 40, "a")] * 5000, "doc_id long, text string, source string").coalesce(2)
    out = mixing.mix(docs, docs_per_shard=100)
    plan = out.select("taken").collect()
    assert len(plan) == 5000 and abs(sum(r.taken for r in plan) - 1.5 * 200000) <= 32 * 52
    shards = docs.select(mixing.seeded(-1 - mixing.F.monotonically_increasing_id(), 17, "shard") % 50).toDF("s").groupBy("s").count().collect()
    assert len(shards) == 50 and max(r["count"] for r in shards) < 200
    assert sorted(r.taken for r in plan) == sorted(r.taken for r in mixing.mix(docs, docs_per_shard=100).collect())


# --- language identification ---


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(97, 105, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)

    def loss():
        p = language.softmax(np.maximum(net.pooled(x), 0) @ net.out + net.out_bias)
        return -np.log(p[np.arange(6), y]).mean()

    for name, g in zip(("embed", "filters", "bias", "out", "out_bias"), net._gradients(x, y)):
        p = getattr(net, name)
        for at in zip(*(rng.choice(k, 4) for k in np.argwhere(np.abs(g) > 1e-4).T)) if (np.abs(g) > 1e-4).any() else ():
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 + 0.1 * abs(g[at]), (name, at)


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "lang", "source").toDF("doc_id", "text", "lang", "lang_pred", "score")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [(r.lang, out[r.doc_id]) for r in docs.collect() if out[r.doc_id].held_out and r.lang is not None and out[r.doc_id].lang_pred != "und"]
    assert len(held) > 100 and sum(a == o.lang_pred for a, o in held) / len(held) > 0.9
    for i, o in out.items():
        assert o.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= o.score <= 1


def test_language_of_odd_texts(spark):
    rows = [(k, f"the quick {k} brown fox and the dog" if k % 2 else f"der schnelle {k} braune fuchs und", "en" if k % 2 else "de") for k in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 456 ... !", None), (None, "und der braune fuchs", "xx"), (103, "the " * 50000, None), (103, "the " * 50000, None), (104, "the quick 77 brown fox and the dog", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    out = language.identify(docs).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and {r.lang_pred for r in out} <= {"en", "de", "und"}
    assert by[None].held_out is False and by[104].lang_pred == "en"
    none = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang")
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# --- quality classifier ---


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.append(rng.integers(0, 500, 30), [600 + k % 2, 700])) for k in range(200)]
    y = np.arange(200) % 2
    ratios = quality.log_count_ratios(sets, y)
    assert ratios[601] > 0 > ratios[600] and abs(ratios[700]) < 0.2
    w, bias, _ = quality.dual_descent(sets, y, ratios)
    margins = np.array([quality.margin(w * ratios, bias, ratios, s) for s in sets])
    assert ((margins > 0) == (y == 1)).mean() > 0.98


def test_dual_descent_meets_the_optimality_conditions():
    """At the dual's solution each variable is at a bound or its gradient is 0, and w is the sum of the vectors."""
    rng = np.random.default_rng(2)
    y = (np.arange(240) % 3 == 0).astype(int)
    sets = [np.unique(np.append(rng.integers(0, 500, 30), [600 + (k if rng.random() > 0.15 else 1 - k), 700])) for k in y]
    ratios = quality.log_count_ratios(sets, y)
    assert ratios[601] > ratios[700] > ratios[600]
    w, bias, alpha = quality.dual_descent(sets, y, ratios, epochs=3000)
    bound = np.where(y == 1, 1 / (2 * y.mean()), 1 / (2 * (1 - y.mean())))
    sign = np.where(y == 1, 1.0, -1.0)
    x = np.zeros((len(sets), quality.SIZE))
    for row, s in zip(x, sets):
        row[s] = ratios[s] / np.sqrt((ratios[s] ** 2).sum())
    assert np.abs((alpha * sign) @ x - w).max() < 1e-3 and abs((alpha * sign).sum() - bias) < 1e-6
    gradient = sign * (x @ w + bias) - 1
    assert ((alpha >= 0) & (alpha <= bound)).all() and {(a == 0, a == b) for a, b in zip(alpha, bound)} >= {(True, False), (False, False)}
    inside = (alpha > 0) & (alpha < bound)
    assert np.abs(gradient[inside]).max() < 1e-2 and (gradient[alpha == 0] > -1e-2).all() and (gradient[alpha == bound] < 1e-2).all()
    margins = np.array([quality.margin(w * ratios, bias, ratios, s) for s in sets])
    assert np.allclose(margins, x @ w + bias, atol=1e-4)


def test_network_equals_a_plain_convolution():
    """Pooled filters and probabilities, computed position by position and filter by filter."""
    rng = np.random.default_rng(5)
    net = language.Network(["a", "b", "c"])
    x = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    for row, got, p in zip(x, net.pooled(x), net.probabilities(x)):
        want = []
        for f in range(net.filters.shape[1]):
            width = language.WIDTHS[f // language.FILTERS]
            kernel = net.filters[: width * language.EMBED, f].reshape(width, language.EMBED)
            assert not net.filters[width * language.EMBED :, f].any()
            want.append(max(sum(float(net.embed[row[i + k]] @ kernel[k]) for k in range(width)) for i in range(len(row) - net.span + 1)) + net.bias[f])
        assert np.allclose(want, got, atol=1e-4)
        z = np.maximum(want, 0) @ net.out + net.out_bias
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_threshold_of_the_sample_at_any_size():
    for total in (5_000, 10**6, 10**10, 10**15, 1 << 62):
        bound = language.threshold(total, 3000)
        assert bound is not None and abs((bound + (1 << 63)) * total / (1 << 64) - 3800) < 1.5 + total / (1 << 60)
        assert -(1 << 63) < bound < 1 << 63
    assert language.threshold(3800, 3000) is None and language.threshold(0, 3000) is None


def test_models_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(20))  # repeated rows too
    nets = [language.trained(d.select("doc_id", "text", "lang"), train_docs=60) for d in (docs, docs.repartition(7))]
    assert all(np.array_equal(getattr(nets[0], n), getattr(nets[1], n)) for n in ("embed", "filters", "bias", "out", "out_bias"))
    scores = [{(r.doc_id, r.score) for r in quality.classify(d, lab, train_docs=100).collect()} for d, lab in ((docs, labels), (docs.repartition(7), labels.repartition(3)))]
    assert scores[0] == scores[1] and len({s for _, s in scores[0]}) > 50


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(truth[i], o.score) for i, o in out.items() if o.held_out and i in truth]
    up, down = ([s for k, s in pairs if k == v] for v in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert area > 0.85, area
    for i, o in out.items():
        assert o.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and o.predicted == (o.score >= 0.7)


def test_features_survive_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 60000, quality.SIZE):
        on = np.zeros(quality.SIZE, np.float32)
        on[rng.permutation(quality.SIZE)[:n]] = 1
        raw = quality.packed(on)
        assert len(raw) <= quality.SIZE // 8 and (quality.unpacked(np.frombuffer(raw, np.uint8)) == np.flatnonzero(on)).all()


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "abc", "q"), (3, "abc", "q"), (None, "abc", "q"), (4, "x" * 300000, "q")], "doc_id long, text string, quality string")
    for labels in ([], [(3, 1), (1, None)], [(3, 1), (4, 0), (1, 1), (2, 0), (8, 0), (None, 1)]):
        out = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 and r.score == r.score for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert quality.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# --- registered queries and the pipeline ---


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(df, duck, sql):
    names = sorted(df.columns)
    spell = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    got = Counter(spell(r) for r in df.select(*names).collect())
    result = duck.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    assert got == Counter(spell([r[found.index(n)] for n in names]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    same(queries()[name](spark, sf_dir), duck, oracle_sql()[name])


def test_pipeline(spark, duck, sf_dir):
    import corpus_pipeline as P

    same(P.run(spark, sf_dir), duck, P.ORACLE_SQL)


def test_stages_leave_no_tables_of_the_stages_before(spark, sf_dir):
    import corpus_pipeline as P
    from turnloom.llm import storage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = lambda: {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in storage.made(start)}
    start = len(storage.made())
    P.quality_rules(spark, docs, sf_dir)
    assert "features" in names()
    kept = P.quality_rules(spark, docs, sf_dir)
    P.line_dedup(spark, kept, sf_dir)  # reads what the first stage left, so that stays
    assert names() >= {"features", "chunks"} and kept.count() > 0
    again = storage.written(kept, "kept")
    P.line_dedup(spark, again, sf_dir)
    assert "features" not in names() and {"chunks", "kept"} <= names()
    out = P.near_duplicates(spark, again, sf_dir)
    assert names().isdisjoint({"features", "chunks", "line-runs"}) and again.count() >= out.count() > 0


def test_pipeline_stages_on_odd_documents(spark, sf_dir):
    import corpus_pipeline as P

    words = " ".join(f"w{k} is" for k in range(30))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, words, "en", "a", 9), (3, words, None, "a", 9), (None, words, "en", None, 9), (4, words + " z", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        kept = source
        for name, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, sf_dir)
            assert tuple(kept.columns) == P.COLUMNS, name
        found = defaultdict(int)
        for r in P.STAGES[-1][1](spark, kept, sf_dir).collect():
            found[r.doc_id] += 1
        assert found == ({3: 2, None: 1} if source is docs else {})
