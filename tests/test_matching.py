"""Alignment of short texts and joins of near rows against brute force."""

import random
import re
from functools import lru_cache

from turnloom.functions import matching as M
from turnloom.plans import matching as plans
from turnloom.plans.views import frame


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 9))] for _ in range(2))

        @lru_cache(None)
        def best(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

        pairs = M.alignment(a, b)
        assert len(pairs) == best(0, 0) == M.common_length(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert M.alignment(["x", "y"], ["y", "x"]) == [(0, 1)]  # the left word goes first


def test_near_verbatim():
    said = "the quick brown fox jumps over the lazy dog today".split()
    assert M.near_verbatim("quick brown fox".split(), said) and M.near_verbatim("quick brown cat jumps over".split(), said)
    assert M.near_verbatim("quik brown fox jumps".split(), said) and not M.near_verbatim("slow red hen".split(), said)
    assert not M.near_verbatim(["hen", "fox"], said) and not M.near_verbatim([], said) and not M.near_verbatim(["fox"], [])


def tokens(text):
    return re.findall("[a-z0-9']+", (text or "").lower())


def test_speaker_votes(spark, sf_dir):
    rows = [(r.session_id, r.idx, r.text) for r in frame(spark, sf_dir, "captions").collect()]
    turns = [(r.session_id, r.idx, r.speaker, r.text) for r in frame(spark, sf_dir, "turns").collect()]
    votes = {}
    for s, i, text in rows:
        by = {}
        for s2, j, speaker, other in turns:
            if s2 == s and abs(i - j) <= 2:
                by[speaker] = by.get(speaker, 0) + M.common_length(tokens(text), tokens(other))
        if any(by.values()):
            votes[s, i] = max((v, k) for k, v in by.items())
    assert {(r.session_id, r.place): r.speaker for r in plans.speaker_votes(spark, sf_dir).collect()} == {k: v[1] for k, v in votes.items()}


def test_evidence_of_a_row_is_found_in_it(spark, sf_dir):
    out = plans.evidence_matches(spark, sf_dir).collect()
    turns = {(r.session_id, r.idx): r.text for r in frame(spark, sf_dir, "turns").collect()}
    texts = {(r.session_id, r.idx): r.text for r in frame(spark, sf_dir, "captions").collect()}
    for r in out:
        words = re.findall(r"\w+", turns[r.session_id, r.other].lower())
        assert r.matches == M.near_verbatim(words[:2] + words[3:12], re.findall(r"\w+", (texts[r.session_id, r.idx] or "").lower()))
    assert any(r.matches for r in out) and not all(r.matches for r in out)


def test_near_verbatim_compares_few_windows_and_loses_none(monkeypatch):
    from difflib import SequenceMatcher

    def plain(evidence, said):
        whole, n = " ".join(evidence), len(evidence)
        parts = [said[i : i + k] for k in range(max(1, n - 2), n + 3) for i in range(len(said) - k + 1)] if n >= 3 else []
        near = lambda p: len(set(evidence) & set(p)) >= 0.75 * len(set(evidence)) or SequenceMatcher(None, whole, " ".join(p)).ratio() >= 0.82
        return bool(evidence and said) and (whole in " ".join(said) or any(map(near, parts)))

    rng, found = random.Random(2), [0, 0]
    for _ in range(400):
        known = ["".join(rng.choice("abcde\u00e9") for _ in range(rng.choice([0, 1, 2, 3, 6]))) for _ in range(rng.choice([3, 30]))]
        said = [rng.choice(known) for _ in range(rng.randrange(25))]
        evidence = said[3 : 3 + rng.randrange(14)]
        for _ in range(rng.randrange(6) if evidence else 0):
            evidence[rng.randrange(len(evidence))] = rng.choice(known) + rng.choice("abc")
        want = plain(evidence, said)
        assert M.near_verbatim(evidence, said) == want
        found[want] += 1
    assert min(found) > 100
    calls = []
    monkeypatch.setattr(M, "SequenceMatcher", lambda *a: calls.append(a) or SequenceMatcher(*a))
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(411)]
    assert not M.near_verbatim(words[:11], words[11:]) and len(calls) < 20
