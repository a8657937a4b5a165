"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds further spans.

Base spans are what the fixed patterns find: e-mail addresses, IP addresses, card numbers and phone numbers.

The random field scores whole candidate segments of one to ``LONGEST`` words by features of the entire span (shape,
digits, check sums, brackets, neighbouring words). A bounded-entity dynamic program over segment ends chooses
boundaries and kinds jointly; words outside entities are segments of length one. Weights are trained here by
gradient ascent on the exact conditional likelihood of generated sentences. Every entity feature needs a marked first
and last word, one with a digit, an @ or a run of ``KEY_CHARS`` characters that keys are made of, so a text decomposes,
without loss, at words farther than ``LONGEST`` from any such word. A segment is bounded in words, not in characters.
Spans that touch a base span give way to it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

BASE = ("email", "ip", "card", "phone")
#: Kinds that the random field tells apart; the last three are not among the base kinds.
KINDS = (*BASE, "secret", "iban", "ssn")
LONGEST, KEY_CHARS = 7, 20
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run can only match from its first digit, so later starts in a run are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it, not reaching into the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at and at >= done else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = (emails(text) if "@" in text else [], ips(text), cards(text), phones(text) if "+" in text else [])
    return [(kind, s, e) for kind, spans in zip(BASE, found) for s, e in spans]


# --- the random field -----------------------------------------------------------------------------------------

_MARKED = re.compile(r"[0-9@]|[A-Za-z_+/=-]{20}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\Z")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]+\Z")
_TRIM = "\"'`.,;:!?()[]{}<>=#$%&*|"
_CUES = {"token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "apikey": "secret", "api_key": "secret", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "iban": "iban", "account": "iban", "ssn": "ssn", "social": "ssn", "security": "ssn"}
#: Cues of passwords, which may be short, and of sums and names that look like keys and are public.
_CUES |= dict.fromkeys(("password", "passwd", "pwd", "passphrase"), "password")
_CUES |= dict.fromkeys(("commit", "sha1", "sha256", "sha512", "sha", "md5", "sum", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "blob", "tree", "fingerprint", "build", "trace", "request"), "sum")


def iban_holds(span: str) -> bool:
    """Whether an IBAN's check digits fit: letters as 10 to 35, the first four characters last, modulo 97."""
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without punctuation around it; an opening bracket of a phone number stays."""
    while start < end and text[start] in _TRIM and not (text[start] == "(" and text[start + 1 : start + 2].isdigit()):
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}\Z")
_FOURS = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\Z")
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*\Z")


def _size(n: int) -> str:
    """Class of a count of digits."""
    return "0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"


def span_features(span: str, k: int) -> tuple[list[str], list[tuple[list[str], list[str], bool]]]:
    """Features of a span of k words: those that its shape alone decides, and (features if so, else, is it so) for each question
    that the digits and letters themselves decide."""
    digits = _DIGITS.sub("", span)
    letters = sum(c.isalpha() for c in span)
    n = len(digits)
    size = _size(n)
    out, asked = ["any", f"words={k}", f"digits={size}"], []
    if not letters:
        out += ["no letters", f"no letters,digits={size}"]
        if 13 <= n <= 19 and _GROUPS.match(span):
            asked.append((["check sum holds"], ["check sum fails"], luhn(digits)))
        if span.startswith("+"):
            out += ["plus", f"plus,digits={size}"]
        if _PHONE_SHAPE.match(span):
            out.append("phone shape")
        if _FOURS.match(span):
            out.append("groups of four")
    if _SSN.match(span):
        out.append("ssn shape")
    if _IBAN.match(span):
        asked.append((["iban holds"], ["iban fails"], iban_holds(span)))
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        asked.append((["dotted quad"], ["large quad"], all(len(p) < 4 and int(p) < 256 for p in parts)))
    if "@" in span:
        left, _, right = span.partition("@")
        out.append("at")
        if left and "." in right.strip(".") and "@" not in right and not any(c.isspace() for c in span):
            out.append("address shape")
    if k == 1 and letters and "@" not in span:
        if "://" in span or span.count("/") > 1 and "=" not in span or span.startswith("www."):
            out.append("path")
        body = span.rsplit("=", 1)[-1].strip("\"'")
        if re.fullmatch(r"[0-9a-zA-Z]{8}(?:-[0-9a-zA-Z]{4}){3}-[0-9a-zA-Z]{12}", body):
            asked.append((["uuid shape"], [], bool(_UUID.match(body))))
        if _KEY.match(body):
            length = "long" if len(body) >= 32 else "medium" if len(body) >= 20 else "short"
            key, hexed = [f"key,{length}"], [f"hex,{length}"]
            if not n:
                out.append(f"no digits,mixed={sum(a.isupper() != b.isupper() for a, b in zip(body, body[1:])) >= 8},{length}")
            elif length != "short":
                key.append(f"mixed={sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:])) >= 6}")
                if body.isupper() and body.isalnum():
                    key.append(f"upper,{length}")
            asked.append((hexed, key, bool(_HEX.match(body))))
    return out, asked


def cues(text: str, words: list[tuple[int, int]], i: int) -> list[str]:
    """Features of the three words before a segment; a cue may also be joined to what it announces by = or :."""
    found = (_CUES.get(text[s:e].strip(_TRIM).lower()) for s, e in words[max(0, i - 3) : i])
    return [f"after {cue}" for cue in found if cue]


def features(text: str, words: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Features of the segment of words i to j (exclusive), or None if it can't be an entity."""
    start, end = core(text, words[i][0], words[j - 1][1])
    span = text[start:end]
    ends = span.split()
    if not ends or not (_MARKED.search(ends[0]) and _MARKED.search(ends[-1])):
        return None
    out, asked = span_features(span, j - i)
    if j - i > 1 and any(text[s:e].rstrip(",;").isdecimal() for s, e in (*words[max(0, i - 1) : i], *words[j : j + 1])):
        out.append(ROW)
    return [*out, *(x for yes, no, holds in asked for x in (yes if holds else no)), *cues(text, words, i)]


#: Feature of a segment of several words next to a plain number.
ROW = "in a row"
#: Letters and digits by kind: spans of one shape differ only in what ``span_features`` asks.
_SHAPE = {c: "a" if chr(c).islower() else "A" if chr(c).isupper() else "9" for c in range(128) if chr(c).isalnum()}
#: Shapes whose bounds a worker keeps.
SHAPES = 1 << 16


class Field:
    """Weights by kind and feature; segments of one word outside entities score 0."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}
        self.shapes: dict[tuple[bool, str, int], float] = {}  # bounds by shape and words, and by plain counts
        self.plain: dict[tuple[bool, int, str, bool, bool], float] = {}

    def candidates(self, text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """For each end, the possible (start, features)."""
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(words) + 1)]
        for j in range(1, len(words) + 1):
            for i in range(max(0, j - LONGEST), j):
                f = features(text, words, i, j)
                if f is not None:
                    out[j].append((i, f))
        return out

    def score(self, kind: str, f: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, x), 0.0) for x in f)

    def bound(self, out: list[str], asked: list) -> float:
        """The best score of any kind that a segment can have with these features, without cues, whatever the answers are."""
        return max(self.score(kind, out) + sum(max(self.score(kind, yes), self.score(kind, no)) for yes, no, _ in asked) for kind in KINDS)

    def _plain_bound(self, row: bool, k: int, size: str, letters: bool, plus: bool) -> float:
        """``bound`` for several words without a shape of their own: beyond four words no pattern but the check sum's fits."""
        out = ["any", f"words={k}", f"digits={size}"] + [ROW] * row + ([] if letters else ["no letters", f"no letters,digits={size}"]) + (["plus", f"plus,digits={size}"] if plus and not letters else [])
        return self.bound(out, [(["check sum holds"], ["check sum fails"], True), ([], [], True)] if not letters and size in ("13-15", "16-19") else [])

    def plausible(self, text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """``candidates`` that may score above 0 in some kind; the others never improve a segmentation, since leaving their
        words outside entities costs nothing. Most fall by their shape alone, whose bound is kept."""
        shape = text.translate(_SHAPE)
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(words) + 1)]
        cores = [core(text, s, e) for s, e in words]
        digit, letter = [0], [0]
        marked = []
        for s, e in cores:
            digit.append(digit[-1] + shape.count("9", s, e))
            n = shape.count("a", s, e) + shape.count("A", s, e)
            letter.append(letter[-1] + (n if n or text[s:e].isascii() else sum(map(str.isalpha, text[s:e]))))
            marked.append(s < e and _MARKED.search(text, s, e) is not None)
        cue = [_CUES.get(text[s:e].lower()) if letter[k + 1] > letter[k] else None for k, (s, e) in enumerate(cores)]
        number = [False, *(text[s:e].rstrip(",;").isdecimal() for s, e in words), False]
        bounds, plain = self.shapes, self.plain
        if len(bounds) > SHAPES:
            bounds.clear()
        for i in range(len(words)):
            s = cores[i][0]
            if s < words[i][1] and not marked[i]:
                continue
            told = any(cue[max(0, i - 3) : i])
            for j in range(i + 1, min(len(words), i + LONGEST) + 1):
                if not marked[j - 1] and cores[j - 1][0] < words[j - 1][1]:
                    continue
                e = cores[j - 1][1]
                if not told and marked[i] and marked[j - 1]:
                    if j - i > 1 and (j - i > 4 or digit[j] - digit[i] > 19 or letter[j] > letter[i]) and text.find("@", s, e) < 0 and shape[s : s + 4] != "AA99":
                        known = (number[i] or number[j + 1], j - i, _size(digit[j] - digit[i]), letter[j] > letter[i], text[s] == "+")
                        best = plain.get(known)
                        if best is None:
                            best = plain[known] = self._plain_bound(*known)
                    else:
                        known = (j - i > 1 and (number[i] or number[j + 1]), shape[s:e], j - i)
                        best = bounds.get(known)
                        if best is None:
                            out_, asked = span_features(known[1], j - i)
                            best = bounds[known] = self.bound(out_ + [ROW] * known[0], asked)
                    if best <= 0:
                        continue
                f = features(text, words, i, j)
                if f is not None:
                    out[j].append((i, f))
        return out

    def decode(self, text: str, words: list[tuple[int, int]], ends: list[list[tuple[int, list[str]]]] | None = None) -> list[tuple[str, int, int]]:
        """Best segmentation: (kind, first word, end word) of its entities."""
        ends = self.plausible(text, words) if ends is None else ends
        best, back = [0.0] * (len(words) + 1), [None] * (len(words) + 1)
        for j in range(1, len(words) + 1):
            best[j] = best[j - 1]
            for i, f in ends[j]:
                for kind in KINDS:
                    s = best[i] + self.score(kind, f)
                    if s > best[j]:
                        best[j], back[j] = s, (kind, i)
        out, j = [], len(words)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                kind, i = back[j]
                out.append((kind, i, j))
                j = i
        return out[::-1]

    def gradient(self, ends: list[list[tuple[int, list[str]]]], truth: list[tuple[str, int, int]]) -> dict[tuple[str, str], float]:
        """Gradient of the log likelihood of a segmentation, by the forward-backward recursion over segment ends."""
        n = len(ends) - 1
        arcs = [(i, j, kind, f, self.score(kind, f)) for j in range(n + 1) for i, f in ends[j] for kind in KINDS]
        fore, aft = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fore[0] = aft[n] = 0.0
        into: list[list] = [[] for _ in range(n + 1)]
        out_of: list[list] = [[] for _ in range(n + 1)]
        for a in arcs:
            into[a[1]].append(a)
            out_of[a[0]].append(a)
        for j in range(1, n + 1):
            fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[a[0]] + a[4] for a in into[j])])
        for i in range(n - 1, -1, -1):
            aft[i] = np.logaddexp.reduce([aft[i + 1], *(aft[a[1]] + a[4] for a in out_of[i])])
        grad: dict[tuple[str, str], float] = {}
        gold = {(i, j, kind) for kind, i, j in truth}
        for i, j, kind, f, s in arcs:
            g = ((i, j, kind) in gold) - float(np.exp(fore[i] + s + aft[j] - fore[n]))
            if abs(g) > 1e-9:
                for x in f:
                    grad[kind, x] = grad.get((kind, x), 0.0) + g
        return grad

    def train(self, sentences: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Field:
        rng = np.random.default_rng(seed)
        square: dict[tuple[str, str], float] = {}
        seen = [(self.candidates(text, word_list(text)), truth) for text, truth in sentences]
        for _ in range(epochs):
            for k in rng.permutation(len(seen)):
                for key, g in self.gradient(*seen[k]).items():
                    g -= decay * self.weights.get(key, 0.0)
                    square[key] = square.get(key, 1e-2) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / square[key] ** 0.5
        return self


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def generated(count: int = 1300, seed: int = 4) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with entities and look-alikes, and the words that each entity covers."""
    rng = np.random.default_rng(seed)

    def some(*options):
        return options[rng.integers(len(options))]

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(n=None):
        return "".join(rng.choice(list("abcdefghilmnoprstu"), n or rng.integers(2, 9)))

    def card():
        body = some("4", "5") + digits(14)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return full if rng.random() < 0.5 else some(" ", "-").join(full[k : k + 4] for k in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return some("+1 ", "+49 ", "+44-", "", "") + some(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}")

    def key():
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), rng.integers(24, 44))) + digits(1)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), n))

    def iban():
        head, body = some("DE", "FR", "GB", "ES", "NL"), some("", "ABNA", "NWBK") + digits(some(14, 18, 20))
        plain = next(f"{head}{k:02d}{body}" for k in range(2, 99) if iban_holds(f"{head}{k:02d}{body}"))
        return plain if rng.random() < 0.5 else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))

    def hexes(n):
        return "".join(rng.choice(list("0123456789abcdef"), n))

    def upper_key():
        return some("AKIA", "ASIA") + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 15)) + some("2", "7", "Q")

    def password():
        return word(rng.integers(3, 8)).title() * int(rng.random() < 0.5) + word(rng.integers(3, 8)) + digits(rng.integers(1, 5)) + some("", "!", "$")

    def uuid():
        return "-".join(hexes(n) for n in (8, 4, 4, 4, 12))

    def row():
        """Numbers one after another; of those of four digits some would pass for a card."""
        if rng.random() < 0.3:
            full = next(c for c in iter(lambda: digits(16), None) if luhn(c))
            return " ".join([digits(4) for _ in range(rng.integers(0, 3))] + [full[k : k + 4] for k in range(0, 16, 4)] + [digits(4) for _ in range(rng.integers(1, 3))])
        size, point = rng.integers(1, 8), some("", "", ",", ".")
        number = lambda: digits(size if rng.random() < 0.7 else rng.integers(1, 8)) + (point + digits(rng.integers(1, 4)) if point else "")
        return some(" ", "  ", ", ", "; ").join(number() for _ in range(rng.integers(3, 9)))

    make = {
        "email": lambda: f"{word()}{some('', '.' + word(), digits(2))}@{word()}{some('', digits(1))}.{some('com', 'org', 'example.com')}",
        "ip": lambda: ".".join(str(rng.integers(0, some(256, 256, 100, 10))) for _ in range(4)),
        "card": card,
        "phone": phone,
        "password": lambda: some("password", "passwd", "Password", "pwd", "passphrase") + some(": ", " = ", " is ", " ") + password(),
        "secret": lambda: upper_key() if rng.random() < 0.2 else some("", f'token{some("=", ":")}') + some("", '"') + some("".join(rng.choice(list("0123456789abcdef"), some(32, 40, 64))) + digits(1), key(), some("sk-", "", "ghp_") + letters(rng.integers(24, 60))),
        "iban": iban,
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    cues = {k: [c for c, kind in _CUES.items() if kind == k] for k in make if k != "password"}
    plain = (lambda: digits(rng.integers(1, 7)), lambda: str(rng.integers(1900, 2100)), lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: word() + digits(2), lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: digits(rng.integers(7, 22)), lambda: f"{digits(3)}.{some('300', '999', '256')}.{digits(2)}.{digits(1)}", lambda: "@" + word() + digits(1), lambda: f"{word()}-{digits(3)}-{word()}", lambda: f"{digits(3)} {digits(3)} {digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}", lambda: "".join(rng.choice(list("0123456789abcdef"), 8)), lambda: word(12) + digits(1) + word(12), lambda: f"{word()}@{digits(2)}", lambda: word(28), lambda: "-".join(word() for _ in range(6)), lambda: "_".join(word(6) for _ in range(5)), lambda: f"https://{word()}.example/{word()}/{word(9)}-{word(9)}-{word(8)}", lambda: f"{word(4).title()}{word(5).title()}{word(6).title()}{word(7).title()}", lambda: "=" * 30, lambda: f"{digits(2)}-{digits(3)}-{digits(2)}", lambda: f"AB{digits(2)} {digits(4)} {digits(3)}")
    public = (lambda: some("commit", "Commit", "revision", "tree") + " " + hexes(40), lambda: some("sha256", "SHA256", "checksum", "digest", "sha256 sum") + some(" ", ": ", " = ") + hexes(64), lambda: some("md5", "MD5", "hash", "etag") + some(" ", ": ", " = ") + hexes(32), lambda: some("", "uuid ", "request ") + uuid(), lambda: f"https://{word()}.example/{word()}/{hexes(some(16, 32, 40))}{some('', '.html', '/' + word())}", lambda: f"/{word()}/{word()}/{hexes(32)}/{word()}.txt", row, row, row, lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}.{digits(3)}Z {some('INFO', 'WARN')} {word()}={digits(4)} {word()}={hexes(8)}")
    out = []
    for _ in range(count):
        text, truth = "", []
        for _ in range(rng.integers(1, 5)):
            text += " ".join(word() for _ in range(rng.integers(0, 5))) + " "
            if rng.random() < 0.55:
                kind = some(*make)
                if kind == "password":
                    text += make[kind]() + some("", ".", ",") + " "
                    truth.append(("secret", len(word_list(text)) - 1, len(word_list(text))))
                    continue
                if rng.random() < 0.3:
                    text += some(*cues[kind]) + some(" ", ": ", " = ")
                at = len(word_list(text))
                value = make[kind]()
                if kind == "card" and rng.random() < 0.25:
                    value, kind = value[:-1] + str((int(value[-1]) + 1) % 10), None
                text += some("", "", "(", '"') + value + some("", "", ".", ",", ")", '"', "###")
                if kind:
                    truth.append((kind, at, len(word_list(text))))
                text += " "
            else:
                text += some(*(plain if rng.random() < 0.7 else public))() + some("", "", ".", ",") + " "
        out.append((text, truth))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field().train(generated())


_CUE_BYTE = np.zeros(256, np.int64)
_CUE_BYTE[48:58] = 1
_CUE_BYTE[64] = 1
_KEY_BYTE = np.zeros(256, bool)
_KEY_BYTE[65:91] = _KEY_BYTE[97:123] = True
_KEY_BYTE[[43, 45, 47, 61, 95]] = True  # + - / = _


def marked_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with an ASCII digit, an @ or a long run of key characters; others hold no span of any kind."""
    seen = np.append(0, np.cumsum(_CUE_BYTE[buf]))
    marked = seen[offsets[1:]] > seen[offsets[:-1]]
    breaks = np.concatenate([[-1], np.flatnonzero(~_KEY_BYTE[buf]), [len(buf)]])
    runs = np.flatnonzero(np.diff(breaks) > KEY_CHARS)  # a run may cross texts; a text too many does no harm
    for s, e in zip(breaks[runs] + 1, breaks[runs + 1]):
        marked[np.searchsorted(offsets, s, "right") - 1 : np.searchsorted(offsets, e, "left")] = True
    return np.flatnonzero(marked)


def field_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the random field adds to the base spans."""
    words, zones = word_list(text), []
    for m in _zone_words(text, words):
        if zones and m - zones[-1][1] <= LONGEST:
            zones[-1][1] = m + 1
        else:
            zones.append([m, m + 1])
    taken: list[tuple[int, int]] = []  # base spans, merged where kinds overlap
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for i, j in zones:
        lo = max(0, i - 3)  # words before a zone serve as its cues
        for kind, a, b in field.decode(text, words[lo:j]):
            s, e = core(text, words[lo + a][0], words[lo + b - 1][1])
            k = bisect_left(taken, (e, 0)) - 1
            if k < 0 or taken[k][1] <= s:
                out.append((kind, s, e))
    return out


def _zone_words(text: str, words: list[tuple[int, int]]) -> list[int]:
    search = _MARKED.search
    return [k for k, (s, e) in enumerate(words) if search(text, s, e)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def _find(sent):
    def run(batches):
        field = sent.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            buf, offsets = B.column_bytes(batch.column("text"))
            n = len(offsets) - 1
            counts, sums, spans = np.zeros((len(BASE), n), np.int64), [nothing] * n, [""] * n
            for i, j, b, o in B.pieces(buf, offsets):
                for k in marked_texts(b, o):
                    text = b[o[k] : o[k + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    for kind, _, _ in base:
                        counts[BASE.index(kind), i + k] += 1
                    sums[i + k] = hashlib.sha256(digest(base).encode()).hexdigest()
                    spans[i + k] = digest([*base, *field_spans(text, field, base)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())], schema=_OUT_ARROW)

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data for each row: doc_id, n_<kind> of the base kinds, base_sha256, spans.

    ``spans`` lists kind:start:end, by kind, then start, in code points with the end exclusive: the base spans and
    those that the random field adds (also of the kinds secret, iban and ssn). A null, empty or clean text has counts of 0 and no
    spans. Texts are read whole; rows that repeat are judged one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find(sent), OUT)
