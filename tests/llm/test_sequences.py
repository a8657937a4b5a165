"""Periodic runs, fill-in-the-middle and pieces: brute force, round trips and the sentencepiece library."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from turnloom.llm import infill, oracles, pieces, queries, runs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "doc_id long, text string, n long, words string, runs string, h long"


def _plain_runs(words, min_length, exponent):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j + q - 1), q)
            i = j
    return sorted((s, e, q) for (s, e), q in found.items())


def test_all_runs_are_found():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            n = rng.randrange(0, 60)
            k = rng.choice([1, 2, 2, 3, 5])
            words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if n and rng.random() < 0.4:
                a = rng.randrange(n)
                p = 1 + rng.randrange(1 + (n - a) // 4)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words * rng.choice([1, 1, 2, 3]))
        symbols, first = runs.numbered(docs)
        for exponent, least in ((2, 1), (4, 6), (3, 4)):
            expected = [(s + f, e + f, q) for words, f in zip(docs, first.tolist()) for s, e, q in _plain_runs(words, least, exponent)]
            assert runs.runs_of(symbols, least, exponent) == sorted(expected)


def test_previous_factors_are_longest():
    rng = random.Random(4)
    for _ in range(60):
        words = [bytes([97 + rng.randrange(3)]) for _ in range(40)]
        symbols, first = runs.numbered([words])
        length, place = runs.previous_factors(runs.Factors(symbols))
        for i in range(40):
            common = [next((k for k in range(41 - i) if i + k == 40 or words[i + k] != words[j + k]), 0) for j in range(i)]
            assert length[i + 1] == max(common, default=0)
            assert length[i + 1] == 0 or common[place[i + 1] - 1] == length[i + 1]


def test_long_periodic_text_is_quick():
    """A period of 7 words over 200,000 words, one word 100,000 times, and words that never repeat."""
    docs = [[b"%d" % (i % 7) for i in range(200_000)], [b"x"] * 100_000, [b"%d" % i for i in range(50_000)]]
    symbols, first = runs.numbered(docs)
    assert runs.runs_of(symbols, 6, 4) == [(1, 200_000, 7), (200_002, 300_001, 1)]


def _expected_runs(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain_runs(words, 6, 4)
    gone = {i for s, e, q in found for i in range(s + q, e + 1)}
    found = [(s, e - s + 1, q) for s, e, q in found]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(3)
    repeated = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 300))), i, "x", "y", 1) for i in [*range(40), *repeated]]
    rows += [(repeated[0], "", 1, "", "", 1), (repeated[1], None, 1, "", "", 1), (repeated[2], " \t\n", 1, "", "", 1), (None, "a a a a a a", 1, "", "", 1), (None, None, 1, "", "", 1), (7, "a b " * 9, 1, "", "", 1), (7, "a b " * 9, 1, "", "", 1)]
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((_expected_runs(r[0], r[1]) for r in rows), key=str)
    assert runs.periodic_runs(spark.createDataFrame(rows, CLASHING).limit(0)).count() == 0


def test_query_of_runs_on_the_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 6000").collect()
    found = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [found[r.doc_id] for r in rows] == [_expected_runs(r.doc_id, r.text) for r in rows]


_UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def _expected_form(text, doc_id):
    units = _UNITS.findall(text)
    n, h = len(units), infill.draws(doc_id, "1")
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("step", "block"), [(1, 1), (3, 7), (64, 64), (64, 1 << 19)])
def test_cuts_by_checkpoints(step, block):
    rng = random.Random(2)
    alphabet = ["a", "bc", "Z", " ", "\n", "é", "漢", "😀", "<", "1", "_", "long", "\x00"]
    for at in range(60):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, rng.choice([3, 40, 200])))) for _ in range(rng.randrange(1, 6))]
        if at % 20 == 0:
            texts.append("x" * 900 + "é" + "y" * 2000 + "!é" * 50)
        raw = [t.encode() for t in texts]
        buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        index = infill.Checkpoints(buf, offsets, step, block)
        for row, text in enumerate(texts):
            units = _UNITS.findall(text)
            assert index.units()[row] == len(units)
            for k in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(8))}:
                head = "".join(units[:k])
                assert index.cut(row, k) == (offsets[row] + len(head.encode()), len(head))
        assert len(index.at) == -(-int(index.units().sum()) // step)


def test_forms_and_round_trip(spark):
    rng = random.Random(6)
    alphabet = ["ab", "c", " ", "é", "漢", "<", ">", "P>", "<S", "\n", "x1"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(0, 60))), 1, "", "", 1) for i in range(300)]
    rows += [(5, "has <M> inside", 1, "", "", 1), (6, None, 1, "", "", 1), (None, "no id at all", 1, "", "", 1), (None, "no id at all", 1, "", "", 1)]
    made = infill.fill_in_middle(spark.createDataFrame(rows, CLASHING))
    out = made.withColumn("back", infill.restored(made.output, made.form)).collect()
    assert sorted((tuple(r)[:-1] for r in out), key=str) == sorted(((r[0], *_expected_form(r[1] or "", r[0])) for r in rows), key=str)
    assert sorted(r.back for r in out) == sorted(r[1] or "" for r in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(spark.createDataFrame(rows, CLASHING).limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame(rows, CLASHING), markers=("<<", "a", "b"))


def test_fill_in_middle_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(oracles.OP12)
    found = queries.op12_fill_in_middle(spark, sf_dir)
    assert found.columns == [d[0] for d in result.description]
    assert sorted(map(tuple, found.collect())) == sorted(result.fetchall())


@pytest.fixture(scope="module")
def vocabulary():
    with open(MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = ["a", "bc", "Z", " ", "\n", "é", "漢", "😀", "<", "1", "▁", "\x00", "the", "ing", "  ", "\t", "ß", "don't", "http://", "你好", "▁▁", "<0x0A>", "<s>", "<unk>", "ﬁ", "́", "ا", "한국", "\r\n", "0" * 9, "ab" * 20, " " * 17]


@pytest.mark.parametrize(("long", "short"), [(1 << 10, 24), (4, 2), (1 << 10, 0)])
def test_same_ids_as_the_library(vocabulary, library, monkeypatch, long, short):
    monkeypatch.setattr(pieces, "LONG", long)
    monkeypatch.setattr(pieces, "SHORT", short)
    rng = random.Random(7)
    texts = ["", "a", " ", "▁", "x" * 3000, " " * 3000, "ab" * 2000, "你好世界" * 800, *("".join(rng.choices(ALPHABET, k=rng.randrange(1, 80))) for _ in range(1500)), *("".join(chr(rng.randrange(32, 0xD7FF)) for _ in range(50)) for _ in range(100))]
    expected = library.encode(texts)
    for check in (None, "stretches", "texts"):
        ids, agrees = pieces.Encoder(vocabulary, check).encode(texts)
        assert [np.frombuffer(x, "<i4").tolist() for x in ids] == expected
        assert set(agrees) == {check and True}
    assert [vocabulary.decode(x).decode() for x in expected] == [library.decode(x) for x in expected]


def test_any_ids_decode_as_in_the_library(vocabulary, library):
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(300), 3 + rng.choice([0xE4, 0xBD, 0xA0, 0xF0, 0xC3])]) for _ in range(rng.randrange(0, 9))]
        assert vocabulary.decode(ids).decode() == library.decode(ids)


def test_long_stretches_and_a_full_memory(vocabulary, library, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "a" * 200_000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(50_000))]
    ids, _ = pieces.Encoder(vocabulary, None).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == library.encode(texts)
    monkeypatch.setattr(pieces, "MEMO", 3)
    encoder = pieces.Encoder(vocabulary, "stretches")
    for text in ("one two three four", "five one", "two two"):
        assert np.frombuffer(encoder.encode([text])[0][0], "<i4").tolist() == library.encode(text)


def test_a_difference_is_seen(vocabulary):
    class Other(pieces.Vocabulary):
        def ids(self, stretch):
            return super().ids(stretch) + (np.array([5], "<i4").tobytes() if "b" in stretch else b"")

    other = Other(vocabulary.model)
    for check in ("stretches", "texts"):
        assert pieces.Encoder(other, check).encode(["a c", "a b", ""])[1] == [True, False, True]


def test_rows_of_pieces(spark, library):
    rows = [(1, None, 1, "", "", 1), (2, "", 1, "", "", 1), (None, "hello world", 1, "", "", 1), (3, "x  y", 1, "", "", 1), (3, "x  y", 1, "", "", 1)]
    docs = spark.createDataFrame(rows, CLASHING)
    expected = sorted(((r[0], library.encode(r[1] or ""), r[1] or "", True) for r in rows), key=str)
    for check in ("stretches", "texts"):
        assert sorted((tuple(r) for r in pieces.encoded(docs, MODEL, check).collect()), key=str) == expected
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        pieces.encoded(docs, MODEL, "all")


def test_query_of_pieces(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op13_sentencepiece(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), *digests, True)


def test_strings_keep_their_bytes():
    from turnloom.llm.textbytes import strings

    assert strings(["é".encode(), b"", b"a"]).to_pylist() == ["é", "", "a"] and strings([]).type == pa.string()
