"""Substring, line and near-duplicate operators and decontamination against brute force on small tables."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from turnloom.llm import decontaminate, exchange, graphs, jaccard, lines, substrings

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, chunk string, n string, bucket long"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(seed=3, n=90):
    """Random texts with shared passages, near copies, odd spaces and characters; ids are not in order."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "字字", "don't", "A", "a", "\x00", "x\x85y"]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (13, 14, 20, 31, 60)]
    base = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        words = rng.choices(vocabulary, k=rng.randrange(0, 40))
        if kind == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(passages))
        if kind == 1:
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = rng.choice(vocabulary)
        if kind == 2 and out:
            words = [rng.choice(out)]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\t", "\r\n"]) for w in words))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "c", "n", 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    found = texts()
    ids = random.Random(5).sample(range(1000), len(found))
    return [*zip(ids, found), (2001, None), (2002, ""), (2003, " \n\n "), (2004, "word " * 30000), (2005, "one two three")]


def test_substrings(spark, rows):
    words = {i: SPACE.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {r.doc_id: r for r in substrings.remove_repeats(table(spark, rows), chunk_rows=16).collect()}
    assert len(out) == len(rows) and any(r.n_removed for r in out.values())
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for j in range(13)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256, out[i].kept_text) == (len(ws), len(gone), sha(kept), kept)


def test_chunks_are_bounded_and_equal_rows_spread(spark):
    text = "w " * 500
    table_, buckets = exchange.dealt(table(spark, [(None, text)] * 50 + [(None, "y " * 5000)]).coalesce(1), limit=4000, rows=20)
    sizes = [(r.rows, r.bytes) for r in table_.groupBy("chunk").agg({"*": "count", "text": "max"}).selectExpr("`count(1)` rows", "length(`max(text)`) bytes").collect()]
    assert sorted(sizes) == [(1, 10000), (2, 1000)] + [(4, 1000)] * 12 and buckets == 7


def test_cuts_cost_the_occupied_buckets_only():
    """Work follows a chunk's keys, not the number of buckets: a million times more of them changes nothing."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for buckets in (1, 7, 1000, 1 << 30):
        began = time.process_time()
        cuts = exchange.Cuts(keys, buckets)
        found = list(cuts)
        assert time.process_time() - began < 0.2
        assert sum(j - i for _, i, j in found) == 5000 and [b for b, _, _ in found] == sorted({((int(k) >> 32) * buckets) >> 32 for k in keys})
        assert all(((int(keys[i]) >> 32) * buckets) >> 32 == b == ((int(keys[j - 1]) >> 32) * buckets) >> 32 for b, i, j in found)
    assert list(exchange.Cuts(keys[:0], 5)) == []


def test_substrings_repeated_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    out = substrings.remove_repeats(table(spark, [(3, text), (3, text), (None, text), (None, text), (5, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (0, 0), (3, 0), (3, 0), (5, 20)]
    assert substrings.remove_repeats(table(spark, []).limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(8)
    pool = ["Top", " top\t", "TOP\r", "menu | home", "é", "É", "", "   ", "rare one"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(0, 6)) + ([f"own {k}"] if k % 2 else []))) for k in range(60)] + [(100, None), (101, ""), (102, "x\n" * 20000)]

    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = {r.doc_id: r for r in lines.drop_frequent_lines(table(spark, rows).repartition(5), chunk_rows=8, fanout=2, batches=3, batch_chunks=1).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not (key(x) and len(held[key(x)]) >= 10)]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_sha256) == (len(split), len(split) - len(kept), sha("\n".join(kept)))
    assert lines.drop_frequent_lines(table(spark, []).limit(0)).count() == 0


def test_keys_settle_while_a_corpus_is_counted(spark, monkeypatch):
    """One file with one part: its chunks still come in six batches, and a key that ten documents have is counted no more."""
    counted, count = [], lines.LineRuns.count
    monkeypatch.setattr(lines.LineRuns, "count", lambda self, sent, batch: (counted.append(sent.count()), count(self, sent, batch)))
    rows = [(k, f"everywhere\nin third {k % 3}\nown {k}\n{k // 9} in nine") for k in range(120)]
    out, runs = lines._dropped(table(spark, rows).coalesce(1), 10, 1, 3, 6, 1, False, exchange.CHUNK_BYTES, 5, ())
    assert [r.n_dropped for r in out.collect()] == [2] * 120
    assert len(counted) == 6 and min(counted) >= 4
    found = sorted(unpacked_runs(runs).values())
    assert found[:-4] == [1] * 120 + [3] + [9] * 13 and all(10 <= n < 40 for n in found[-4:])  # of 40 and 120 documents
    assert max(level for level, _ in runs.runs()) >= 1
    counted.clear()
    few, _ = lines._dropped(table(spark, rows).repartition(7), 10, 1, 3, 6, 32, False, exchange.CHUNK_BYTES, exchange.CHUNK_ROWS, ())
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, out.collect())) and len(counted) == 1


def test_repeated_ids_count_as_documents(spark):
    out = lines.drop_frequent_lines(table(spark, [(1, "same")] * 6 + [(None, "same")] * 4)).collect()
    assert [r.n_dropped for r in out] == [1] * 10


def packed_keys(spark, found):
    """Rows as chunks send them: a bucket's distinct keys, sorted, with the documents of each."""
    keys = sorted(found)
    raw = b"".join(k.encode().ljust(lines.KEY, b"_") for k in keys)
    return spark.createDataFrame([(0, 1, len(keys), bytearray(raw), bytearray(np.array([found[k] for k in keys], "<u4").tobytes()))], exchange.SENT)


def unpacked_runs(runs):
    out = defaultdict(int)
    for r in runs.table().collect():
        for k, n in zip(np.frombuffer(bytes(r.keys), f"S{lines.KEY}"), np.frombuffer(bytes(r.counts), "<u4")):
            out[k.decode("latin-1").rstrip("_")] += int(n)
    return dict(out)


def test_runs_are_compacted_by_levels_and_settled_keys_stay_out(spark, tmp_path):
    rng, total = random.Random(1), defaultdict(int)
    runs = lines.LineRuns(spark, str(tmp_path / "runs"), fanout=2, settled=6)
    for batch in range(5):
        found = {f"k{rng.randrange(12)}": rng.randrange(1, 4) for _ in range(6)}
        runs.count(packed_keys(spark, found), str(batch))
        for k, n in found.items():
            total[k] += n if total[k] < 6 else 0
    assert unpacked_runs(runs) == dict(total)
    assert sorted(level for level, _ in runs.runs()) == [0, 2]  # 5 is 101 in binary


BATCHES = [[(1, "a\nb\nA"), (2, "c"), (None, "c")], [(3, "B\nd\n"), (3, "B\nd\n"), (4, None)], [], [(5, "a\nd\ne")], [(6, "")]]


def added(runs, spark, name, batch):
    docs = spark.createDataFrame([(i, t, "n", "x") for i, t in batch], "doc_id long, text string, n_lines string, chunk string").coalesce(1)
    return sorted((r.doc_id or 0, r.kept_text) for r in runs.add(docs, name).collect())


def test_line_runs_over_batches(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    got = [added(runs, spark, str(k), b) for k, b in enumerate(BATCHES)]
    assert got == [[(0, ""), (1, "a\nb"), (2, "c")], [(3, ""), (3, "d\n"), (4, "")], [], [(5, "e")], [(6, "")]]
    assert added(runs, spark, "1", BATCHES[1]) == got[1]  # added before: the same result again
    assert sorted(unpacked_runs(runs).values()) == [1, 1, 1, 2, 2] and sorted(level for level, _ in runs.runs()) == [0, 2]


@pytest.mark.parametrize("at", ["result", "publish", "compaction", "deletion"])
def test_a_batch_that_fails_can_be_added_again(spark, tmp_path, monkeypatch, at):
    runs = lines.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    want = [added(lines.LineRuns(spark, str(tmp_path / "other"), fanout=2), spark, str(k), b) for k, b in enumerate(BATCHES[:1])]
    assert [added(runs, spark, "0", BATCHES[0])] == want

    def fail(*_, **__):
        raise OSError("injected")

    with monkeypatch.context() as m:
        if at == "result":
            m.setattr(lines, "_rewrite", fail)
        elif at == "publish":
            m.setattr(lines.LineRuns, "_publish", fail)
        elif at == "compaction":
            m.setattr(lines.LineRuns, "_compact", fail)
        else:  # the compacted run is out, the old ones are still there
            publish = lines.LineRuns._publish
            m.setattr(lines.LineRuns, "_publish", lambda self, aside, level, name: (publish(self, aside, level, name), level and fail()))
        with pytest.raises(OSError):
            added(runs, spark, "1", BATCHES[1])
    assert added(runs, spark, "1", BATCHES[1]) == [(3, ""), (3, "d\n"), (4, "")]
    assert sorted(unpacked_runs(runs).values()) == [1, 1, 2, 2]
    assert added(runs, spark, "3", BATCHES[3]) == [(5, "e")]


def shingles(text):
    words = SPACE.findall(low(text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(rows):
    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, rows):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(table(spark, rows), chunk_rows=16).collect()}
    assert out == classes(rows)


def test_jaccard_of_many_copies_that_differ_at_two_places(spark, monkeypatch):
    """Copies just below and above the bound: most don't link with the pivot, and blocks must find the links."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(110)]
    rows = []
    for k in range(130):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            words[rng.randrange(110)] = f"x{rng.randrange(12)}"
        rows.append((k * 7 % 1009, " ".join(words)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(table(spark, rows), chunk_rows=16).collect()}
    assert out == classes(rows)


def test_jaccard_join_finds_every_link(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rng = random.Random(12)
    base = [f"b{k}" for k in range(80)]
    copies = [(3000 + k, " ".join([*base[: rng.randrange(70, 80)], f"x{rng.randrange(5)}"])) for k in range(60)]
    all_rows = [*rows, *copies]
    members, links = jaccard.joined(table(spark, all_rows), chunk_rows=16)
    sets = {i: shingles(t) for i, t in all_rows}
    want = {i: set() for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a and 100 * len(a & b) >= 80 * len(a | b):
                want[i].add(j)
    out = {r.doc_id: r for r in members.collect()}
    assert {i: r.n_links for i, r in out.items()} == {i: len(x) for i, x in want.items()}
    pairs = [(r.class_a, r.class_b) for r in links.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {tuple(sorted((out[i].class_id, out[j].class_id))) for i, x in want.items() for j in x if out[i].class_id != out[j].class_id}
    assert all(out[i].class_id == (min(j for j in sets if sets[j] == s) if s else None) for i, s in sets.items())


def test_jaccard_missing_and_repeated(spark):
    text = "a b c d e f g"
    rows = [(9, text), (4, text.upper()), (4, "z y x w v u"), (6, "z y x w v u"), (None, text), (1, None), (2, ""), (3, "a b"), (8, "A b")]
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(table(spark, rows)).collect())
    assert out == [(-1, 3, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (4, 3, 4), (6, 2, 4), (8, 1, 3), (9, 3, 4)]
    assert jaccard.linked(table(spark, []).limit(0)).count() == 0


def test_tree_overlaps():
    rng = np.random.default_rng(6)
    query = np.unique(rng.integers(0, 200, 80)).astype(np.uint64)
    sets = [np.unique(rng.integers(0, 200, n)).astype(np.uint64) for n in (1, 5, 50, 90, 90, 120)] + [query, query[:40], query[:41]]
    for need in (0, 10, 35, len(query)):
        exact = [len(set(query.tolist()) & set(s.tolist())) for s in sets]
        assert jaccard.tree_overlaps(query, sets, [need] * len(sets)) == [x if x >= need else -1 for x in exact]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    out = {r.node: r.component for r in graphs.components(edges).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def leaks(doc, items):
    ws, hit, found = PLAIN.findall(low(doc or "")), set(), set()
    for item, text in items:
        iw = PLAIN.findall(low(text or ""))
        if item is None or not iw:
            continue
        n = min(10, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("part_words", [1 << 20, 20])
def test_decontamination(spark, rows, part_words):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices([f"W{j}" for j in range(40)], k=n))) for k, n in enumerate([1, 3, 10, 12, 40])]
    items += [(10, SPACE.sub(lambda m: m[0], rows[1][1] or "x y z")), (10, "É 字字"), (11, None), (12, "... !!"), (None, "w1"), (13, "don't A")]
    docs = [*rows, (3000, f"Intro: {items[4][1].lower()}; end"), (3001, "don t, a"), (None, items[4][1])]
    benchmark = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    out = decontaminate.find_leaks(table(spark, docs), benchmark, part_words=part_words).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.items, r.contaminated, r.items_sha256) for r in out)
    want = sorted((i or -1, n, h, ids, h > 0, sha(",".join(ids))) for i, t in docs for n, h, ids in [leaks(t, items)])
    assert got == want
    by = {r.doc_id: r for r in out}
    assert [docs[-3][1][s.start : s.end] for s in by[3000].spans if s.end - s.start > 20] == [items[4][1].lower()]
    kept = {r.doc_id for r in decontaminate.without_leaks(table(spark, docs), benchmark, part_words=part_words).collect()}
    assert kept == {r.doc_id for r in out if not r.contaminated}


def test_decontamination_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_leaks(table(spark, [(1, "a b")]), empty).collect()] == [False]
    assert decontaminate.find_leaks(table(spark, []).limit(0), empty).count() == 0


def test_one_automaton_for_a_large_benchmark():
    """5 MB of items are one automaton, and texts pass it about as fast as one of 200 KB; matches are the exact ones."""
    rng = np.random.default_rng(3)
    seconds = {}
    for n in (2_000, 50_000):  # items of about 17 words of 6 bytes
        items = [(str(k), rng.integers(1, 60_000, 17).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in range(n)]
        a = decontaminate.Automaton(items, 10)
        assert sum(len(w) for _, w in items) < decontaminate.PART_WORDS
        texts = [rng.integers(1, 60_000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3000)]
        for k in range(0, 3000, 100):
            texts[k][50:67] = items[k % n][1]
        hashes, rows = np.concatenate(texts), np.arange(3001) * 300
        began = time.process_time()
        last, state = a.matches(hashes, rows)
        seconds[n] = time.process_time() - began
        assert sorted(last) == [k * 300 + 59 + j for k in range(0, 3000, 100) for j in range(8)]
        assert {a.items[i] for i in a.owners(state)[1]} == {str(k % n) for k in range(0, 3000, 100)}
    assert seconds[50_000] < 8 * seconds[2_000] + 0.5, seconds


def test_long_stretches_and_nested_patterns():
    """One text of known words only, longer than a lane, with patterns of several lengths inside one another."""
    rng = random.Random(5)
    words = [rng.randrange(1, 4) for _ in range(2000)]
    items = [(str(k), words[i : i + n]) for k, (i, n) in enumerate([(0, 1), (3, 2), (9, 4), (100, 7), (300, 10), (700, 30)])]
    a = decontaminate.Automaton([(i, np.array(w, np.uint64)) for i, w in items], 10)
    want = set()
    for _, w in items:
        n = min(10, len(w))
        for p in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            want |= {(k + n - 1, n) for k in range(len(words) - n + 1) if tuple(words[k : k + n]) == p}
    last, state = a.matches(np.array(words, np.uint64), np.array([0, 2000]))
    assert {(int(e), int(a.size[s])) for e, s in zip(last, state)} == want and len(last) == len(want)
