"""SentencePiece encoding and decoding of merge-type vocabularies with a score-ordered agenda.

A text's symbols are its characters, blanks written as U+2581. The agenda holds the adjacent pairs of symbols that
form a piece, best score first and leftmost among equals; popping one merges it and puts the pairs with its new
neighbours on the agenda. Symbols that are no piece fall back to their bytes. No merge crosses a place that lies inside
no piece (before a blank that follows another character, between letters and others, around characters of no longer
piece), so a text is cut there, and the ids of the distinct stretches are kept between batches up to ``MEMO`` entries and ``MEMO_CHARS`` characters.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import textbytes as B

#: Fixed value: the character that stands for a blank in pieces.
BLANK = "▁"
#: Stretches whose ids a worker keeps, and their characters.
MEMO, MEMO_CHARS = 3 << 18, 1 << 24
#: Characters from which a stretch is cut between any two characters that no piece holds side by side.
LONG = 1 << 10
#: Symbols below which the agenda is a plain list instead of a heap.
SHORT = 24

OUT = "doc_id long, ids array<int>, decoded string, agrees boolean"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("agrees", pa.bool_())])


class Vocabulary:
    """Pieces, scores and byte pieces of a merge-type model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, a blank before the text and no normalisation are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.model = model
        self.id: dict[str, int] = {}
        score: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.is_byte: list[bool] = []
        self.has_blank: list[bool] = []  # pieces that start with a blank
        self.byte = [0] * 256
        for i, p in enumerate(proto.pieces):
            self.is_byte.append(p.type == kinds.BYTE)
            self.has_blank.append(p.type == kinds.NORMAL and p.piece[:1] == BLANK)
            if p.type == kinds.NORMAL:
                self.id[p.piece], score[p.piece] = i, p.score
                self.surface.append(p.piece.replace(BLANK, " ").encode())
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        order = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}  # the higher the score, the lower the rank
        self.neighbours = {a + b for p in self.id for a, b in zip(p, p[1:])}
        inside = sorted({c for p in self.id if len(p) > 1 for c in p} - {BLANK})
        kinds_of = [[c for c in inside if c.isalpha()], [c for c in inside if not c.isalpha()]]
        if any(a.isalpha() != b.isalpha() for a, b in self.neighbours if BLANK not in (a, b)):
            kinds_of = [inside]  # some piece joins letters and other characters
        blanks = f"{BLANK}*"
        if any(b == BLANK and a != BLANK for a, b in self.neighbours):
            kinds_of, blanks = [[*inside, BLANK]], ""  # some piece has a blank after another character
        classes = ["[" + "".join(map(re.escape, chars)) + "]+" for chars in kinds_of if chars]
        self.stretches = re.compile("|".join([*(blanks + c for c in classes), f"{BLANK}+", "."]), re.S)
        self.kept: Encoder | None = None  # a worker's memory, for all tasks of a query

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when no two neighbours form a piece."""
        symbols, n, rank = list(text), len(text), self.rank.get
        if n < SHORT:
            return self._merged_short(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << 40 | i for i, r in enumerate(map(rank, map(add, text, text[1:]))) if r is not None]  # rank, then place
        heapq.heapify(agenda)
        while agenda:
            r = heapq.heappop(agenda)
            i = r & ((1 << 40) - 1)
            j = after[i]
            if j >= n or not (s := symbols[i]) or rank(s := s + symbols[j]) != r >> 40:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = s, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(s + symbols[k])) is not None:
                    heapq.heappush(agenda, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + s)) is not None:
                heapq.heappush(agenda, r << 40 | h)
        return list(filter(None, symbols))

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """The same for a few symbols, with the agenda as a plain list in the order of places."""
        rank, none = self.rank.get, len(self.rank)
        agenda = [rank(p, none) for p in map(add, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            s = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(s + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + s, none)
        return symbols

    def ids(self, stretch: str) -> bytes:
        """The ids of a stretch, 32 bits each."""
        if len(stretch) < LONG:
            symbols = self.merged(stretch)
        else:
            cuts = [0, *(i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.neighbours), len(stretch)]
            symbols = [s for a, b in zip(cuts, cuts[1:]) for s in self.merged(stretch[a:b])]
        found = [*map(self.id.get, symbols)]
        if None in found:
            found = [i for s, own in zip(symbols, found) for i in ([own] if own is not None else map(self.byte.__getitem__, s.encode("utf-8", "replace")))]
        return array("i", found).tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of ids: the blank that starts the first piece goes; bytes that are no UTF-8 become U+FFFD."""
        surface, first = self.surface, 0
        while first < len(ids) and not surface[ids[first]]:
            first += 1
        out = b"".join(map(surface.__getitem__, ids))
        if first < len(ids) and self.has_blank[ids[first]]:
            out = out[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return self._decode_runs(ids, first)

    def _decode_runs(self, ids: list[int], first: int) -> bytes:
        """The same where byte pieces do not form UTF-8: each run of byte pieces by itself."""
        out, run = [], bytearray()
        for at, i in enumerate([*ids, None]):
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�".encode())
                del run[:size]
            if i is not None:
                piece = self.surface[i]
                out.append(piece[1:] if at == first and self.has_blank[i] else piece)
        return b"".join(out)


class Encoder:
    """A vocabulary with the ids of the stretches met so far, within bounds."""

    def __init__(self, vocabulary: Vocabulary, check: str | None):
        self.vocabulary, self.check, self.library = vocabulary, check, None
        self.memo: dict[str, bytes] = {}
        self.held, self.differs = 0, set()
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
            self.skip = len(self.library.encode("\n"))

    def learn(self, new: set[str]) -> None:
        found = [*new]
        ids = [*map(self.vocabulary.ids, found)]
        self.memo.update(zip(found, ids))
        self.held += sum(map(len, found))
        if self.check == "stretches":  # behind a line end, which no piece holds, a stretch is encoded by itself
            theirs = self.library.encode(["\n" + s.replace(BLANK, " ") for s in found], num_threads=1)
            self.differs.update(s for s, a, b in zip(found, ids, theirs) if np.frombuffer(a, "<i4").tolist() != b[self.skip :])

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool | None]]:
        """(ids, 32 bits each; does the library agree) of each text."""
        stretches = [self.vocabulary.stretches.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*stretches).difference(self.memo)
        if len(self.memo) + len(new) > MEMO or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
            new = set().union(*stretches)
        self.learn(new)
        ids = [b"".join(map(self.memo.__getitem__, s)) for s in stretches]
        if self.check == "stretches":
            return ids, [not self.differs or self.differs.isdisjoint(s) for s in stretches]
        if self.check == "texts":
            return ids, [np.frombuffer(a, "<i4").tolist() == b for a, b in zip(ids, self.library.encode(texts, num_threads=1))]
        return ids, [None] * len(texts)


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) >> 2 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _encode(sent, check: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        encoder = vocabulary.kept = vocabulary.kept or Encoder(vocabulary, check)
        for batch in batches:
            for i, j, buf, offsets in B.pieces(*B.column_bytes(batch.column("text"))):
                ids, agrees = encoder.encode([buf[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in range(j - i)])
                lists = [np.frombuffer(x, "<i4").tolist() for x in ids]
                decoded = [vocabulary.decode(x) for x in lists]
                if check:
                    agrees = [a and t.decode() == d for a, t, d in zip(agrees, decoded, encoder.library.decode(lists))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), _lists(ids), B.strings(decoded), pa.array(agrees, pa.bool_())], schema=_OUT_ARROW)

    return run


def encoded(docs: DataFrame, model: str, check: str | None = "stretches") -> DataFrame:
    """doc_id, ids, decoded, agrees of every row, whole texts.

    ``model`` is the path of a merge-type model, read once on the driver. ``agrees`` says whether the library decodes
    the ids to the same text and gives the same ids, for each distinct stretch that a worker meets (``check``
    "stretches") or for the text as a whole ("texts", which takes the library's time for every text); with None it is null. A null or empty text has no ids and an
    empty decoded text; rows repeat as they come; other columns are not read; an empty table gives an empty result.
    """
    if check not in (None, "stretches", "texts"):
        raise ValueError(f"no such check: {check}")
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(sent, check), OUT)
