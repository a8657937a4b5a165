"""Token counts against the tokenizers library."""

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from turnloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _merges():
    with open(PATH, encoding="utf-8") as f:
        return tokens.Merges(json.load(f))


def test_same_counts_as_the_library():
    rng = random.Random(5)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "​", "é", "ß", "漢", "字", "😀", "'s", "'re", "1", "٣", "½", "$$$", "<|endoftext|>", "<|endof", "A", "-", "́", "\r\n", "\x00"]
    texts = ["", "aaaaaaaaaaaaaaaaaaaaa", "ab" * 300, "x" * 5000, " " * 400, "<|endoftext|><|endoftext|>", *("".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(2000))]
    library = Tokenizer.from_file(PATH)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(_merges())(texts) == expected


def test_memory_of_pretokens_may_overflow(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 4)
    count = tokens.counter(_merges())
    library = Tokenizer.from_file(PATH)
    for text in ("one two three four five six", "seven eight one", "two"):
        assert count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_very_long_pretokens():
    """A million characters without a break: unspaced script, symbols, letters, one letter; work follows the merges."""
    rng, library, count = random.Random(8), Tokenizer.from_file(PATH), tokens.counter(_merges())
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(100_000)), "".join(rng.choices("$#%&*^=+-_/", k=200_000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "a" * 1_000_000, "".join(rng.choices("aab", k=5000)), "ab" * 3000]
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello world", "x"), (3, "hello world", "x"), (3, "hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted((tuple(r) for r in tokens.count_tokens(docs, PATH, limit=1).collect()), key=str)
    assert out == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, True), (3, 11, 2, True), (3, 11, 2, True)], key=str)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    from turnloom.llm.queries import queries

    out = {r.doc_id: r for r in queries()["op10_token_counts"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    library = Tokenizer.from_file(PATH)
    assert len(out) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (out[r.doc_id].n_bytes, out[r.doc_id].n_tokens, out[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 1024)
