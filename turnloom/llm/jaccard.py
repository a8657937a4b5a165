"""N-gram Jaccard join with prefix trees, and the components of its links.

A document's set holds its distinct ``WIDTH``-word shingles (A-Z lower-cased) as 64-bit hashes. Two documents link
when the share of common shingles reaches ``NUM`` / ``DEN``.

1. Documents with equal sets form a class; only its smallest id goes on.
2. Of a set of n, a partner holds at least t = ceil(n NUM / DEN). In the order of hashes, the first k common
   shingles lie among the first n - t + k of either set. Sets send those (about 40 %) to hash buckets, which answer
   which of them two classes hold; a class with fewer than k of them has no partner.
3. The rest send their whole sets and learn how many classes hold each shingle. Globally ordered from rare to
   frequent, shingles of one class only come first, count for the bounds and are then left out.
4. Classes meet at the shingles of their prefixes. At each shingle the most central class, that with the highest
   mean frequency rank, is the pivot, and every class is compared with the pivot that most of its prefix names.
   Shingles whose classes are then all connected are done. At the others, classes that named the same pivot form
   blocks of bounded size, and blocks that meet within the size and position bounds are compared as wholes, without
   a row for each pair. So a group of copies costs one comparison per copy, but no pair that could link is lost.
5. A comparison joins a set with a prefix tree of its partners' sets, from frequent to rare: partial overlaps are
   shared along common prefixes, and a subtree is left as soon as what remains can't reach the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import exchange as X
from turnloom.llm import textbytes as B
from turnloom.llm.graphs import components
from turnloom.llm.storage import discard, written

WIDTH, NUM, DEN = 5, 80, 100
KEY_BYTES = 6
#: Shingles, and sets, in one block of a comparison, about.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 15, 128


def least_overlap(n, num: int = NUM, den: int = DEN):
    """Smallest number of shingles that a set of n shares with any partner."""
    return -(-n * num // den)


def pair_overlap(n, m, num: int = NUM, den: int = DEN):
    """Smallest overlap of sets of n and m that links them."""
    return -(-(n + m) * num // (num + den))


def _first(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many common shingles are looked for near the front: a fifth of ``of``, at least one."""
    return np.minimum(np.maximum(1, of // 5), np.maximum(n, 1))


class _Chunk:
    """Shingle sets of a chunk's documents, each in the order of hashes, one after another."""

    def __init__(self, docs: pa.Table, width: int):
        self.ids = docs.column("doc_id")
        buf, offsets = B.column_bytes(docs.column("text"))
        parts, counts = [np.zeros(0, B.U64)], [np.zeros(0, np.int64)]
        for _, _, b, o in B.pieces(buf, offsets):
            s, e, w = B.word_spans(b, o)
            words = B.segment_hashes(B.LOWER[b], s, e, 0)
            at = B.window_starts(w, width)
            rows = np.searchsorted(w, at, "right") - 1
            h = B.run_hashes(words, at, width)
            n = np.diff(w)
            short = np.flatnonzero((n > 0) & (n < width))
            if len(short):
                few = [B.mix(np.array([sum(int(x) * pow(3, k + 1) for k, x in enumerate(words[w[i] : w[i + 1]])) * 31 + int(n[i]) & (1 << 64) - 1], B.U64))[0] for i in short]
                rows, h = np.concatenate([rows, short]), np.concatenate([h, np.array(few, B.U64)])
            order = np.lexsort((h, rows))
            rows, h = rows[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
            parts.append(h[new])
            counts.append(np.bincount(rows[new], minlength=len(n)))
        self.hash, self.n = np.concatenate(parts), np.concatenate(counts)
        self.offsets = np.append(0, np.cumsum(self.n))

    def only(self, rows: np.ndarray) -> None:
        """Keep the sets of some rows; the others become empty."""
        keep = np.zeros(len(self.n), bool)
        keep[rows] = True
        self.hash, self.n = self.hash[np.repeat(keep, self.n)], np.where(keep, self.n, 0)
        self.offsets = np.append(0, np.cumsum(self.n))

    def keys(self, upto: np.ndarray):
        """(position, rows, distinct hashes, index of each) of the first shingles of each set."""
        row = np.repeat(np.arange(len(self.n)), self.n)
        front = (np.arange(len(self.hash)) - self.offsets[row]) < upto[row]
        distinct, back = np.unique(self.hash[front], return_inverse=True)
        return front, row[front], distinct, back


def _class_rows(docs: pa.Table, notes: pa.Table) -> np.ndarray:
    """Rows of the chunk that stand for a class."""
    parts, ids = np.array(notes.column("part")), np.array(notes.column("bucket"))
    known = docs.column("doc_id")
    return np.flatnonzero(np.isin(np.asarray(known.fill_null(0)), ids[parts == _REP]) & np.asarray(known.is_valid()))


_REP, _FRONT, _ALL = 0, 1, 2


def _signatures(width: int):
    def sign(key, docs):
        c = _Chunk(docs, width)
        chunk, out = key[0].as_py(), []
        for i, doc in enumerate(c.ids.to_pylist()):
            s = c.hash[c.offsets[i] : c.offsets[i + 1]]
            spread = B.mix(s * B.U64(0xD6E8FEB86659FD93) + B.U64(1))
            one, two = (int(x.sum(dtype=B.U64)) for x in (s, spread))
            out.append((doc, chunk, len(s), np.uint64(one).astype(np.int64).item(), np.uint64(two).astype(np.int64).item()))
        return pa.Table.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*out) if out else [[]] * 5)], names=["doc_id", "chunk", "n", "sig1", "sig2"])

    return sign


def _front_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(n, n - least_overlap(n, num, den) + _first(n, n))


def _send_front(buckets: int, width: int, num: int, den: int):
    def send(key, docs, notes):
        if not docs.num_rows or not notes.num_rows:
            return X.SENT_ARROW.empty_table()
        c = _Chunk(docs, width)
        c.only(_class_rows(docs, notes))
        _, _, distinct, back = c.keys(_front_sizes(c.n, num, den))
        many = np.bincount(back, minlength=len(distinct)) > 1
        return X.Cuts(distinct, buckets).sent(key[0].as_py(), lambda i, j: (X.packed(distinct[i:j], KEY_BYTES), np.packbits(many[i:j]).tobytes()))

    return send


def _mark_front(table):
    keys = X.unpacked(X.joined(table, "keys"), KEY_BYTES)
    many = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(table.column("more"), table.column("n").to_pylist())])
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    seen = counts > 1
    seen |= np.bincount(back, many, len(counts)) > 0
    return X.answer(table, _FRONT, seen[back])


def _survivors(c: _Chunk, notes: pa.Table, buckets: int, num: int, den: int) -> np.ndarray:
    """Rows with enough shared shingles near the front."""
    front, row, distinct, back = c.keys(_front_sizes(c.n, num, den))
    shared = X.bits_of(notes, _FRONT, X.Cuts(distinct, buckets))[back]
    t = least_overlap(c.n, num, den)
    k = np.minimum(_first(c.n, t), _first(c.n, c.n))
    place = np.flatnonzero(front) - c.offsets[row]
    near = shared & (place < (c.n - t + k)[row])
    return np.flatnonzero((np.bincount(row[near], minlength=len(c.n)) >= k) & (c.n > 0))


def _send_all(buckets: int, width: int, num: int, den: int):
    def send(key, docs, notes):
        if not docs.num_rows or not notes.num_rows:
            return X.SENT_ARROW.empty_table()
        c = _Chunk(docs, width)
        c.only(_class_rows(docs, notes))
        c.only(_survivors(c, notes, buckets, num, den))
        _, _, distinct, back = c.keys(c.n)
        count = np.bincount(back, minlength=len(distinct))
        return X.Cuts(distinct, buckets).sent(key[0].as_py(), lambda i, j: (X.packed(distinct[i:j], KEY_BYTES), count[i:j].astype("<u4").tobytes()))

    return send


def _count_all(table):
    """Answers a byte for each key: 0 for one class, else a rank that grows with the number of classes."""
    keys = X.unpacked(X.joined(table, "keys"), KEY_BYTES)
    counts = np.frombuffer(X.joined(table, "more").tobytes(), "<u4").astype(np.int64)
    _, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, counts)
    rank = np.minimum(255, 6 * np.log2(total)).astype(np.uint8)[back]
    rows, at = [], 0
    for bucket, chunk, n in zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "n"))):
        if rank[at : at + n].any():
            rows.append((chunk, _ALL, bucket, rank[at : at + n].tobytes()))
        at += n
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 4, X.ANSWER_ARROW.types)], schema=X.ANSWER_ARROW)


def _ranks_of(notes: pa.Table, cuts: X.Cuts) -> np.ndarray:
    out = np.zeros(cuts.size, np.uint8)
    for i, j, raw in cuts.answered(notes, _ALL):
        out[i:j] = np.frombuffer(raw.as_buffer(), np.uint8)
    return out


SETS = "doc_id long, n int, own int, centre int, prefix array<long>, shingles binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("centre", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary())])


def _make_sets(buckets: int, width: int, num: int, den: int):
    """Sets from rare to frequent, without shingles of their own class only (``own`` of them).

    ``centre`` is the mean frequency rank of the whole set: in a group of near copies, the class that the others
    were made from, or the one closest to it, has the highest.
    """

    def make(key, docs, notes):
        if not docs.num_rows or not notes.num_rows:
            return _SETS_ARROW.empty_table()
        c = _Chunk(docs, width)
        c.only(_class_rows(docs, notes))
        c.only(_survivors(c, notes, buckets, num, den))
        _, row, distinct, back = c.keys(c.n)
        rank = _ranks_of(notes, X.Cuts(distinct, buckets))[back]
        ids, out = c.ids.to_pylist(), []
        for i in np.flatnonzero(c.n):
            r, h = rank[c.offsets[i] : c.offsets[i + 1]], c.hash[c.offsets[i] : c.offsets[i + 1]]
            n, t = len(h), int(least_overlap(len(h), num, den))
            own = int((r == 0).sum())
            if n - own < t:
                continue
            h = h[np.lexsort((h, r))][own:]
            out.append({"doc_id": ids[i], "n": n, "own": own, "centre": int(r.sum(dtype=np.int64)) * 64 // n, "prefix": h[: n - t + 1 - own].view(np.int64).tolist(), "shingles": h.astype("<u8").tobytes()})
        return pa.Table.from_pylist(out, schema=_SETS_ARROW)

    return make


def tree_overlaps(query: np.ndarray, sets: list[np.ndarray], needs: list[int]) -> list[int]:
    """Overlap of the query with each set, or -1 where it stays below the set's need.

    The sets, each in the global order from frequent to rare, are walked as a prefix tree: sorted, so that each
    shares a path with the one before it, whose partial overlaps at each depth are kept.
    """
    query = np.sort(query)
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    out = [-1] * len(sets)
    path, depth, counts = np.zeros(0, B.U64), 0, np.zeros(1, np.int64)  # counts[d]: overlap of path[:d], for d <= depth
    step = 64
    for i in order:
        s, need = sets[i], needs[i]
        m = min(len(path), len(s), depth)
        differs = np.flatnonzero(path[:m] != s[:m])
        d = int(differs[0]) if len(differs) else m
        grown = np.empty(len(s) + 1, np.int64)
        grown[: d + 1] = counts[: d + 1]
        # Anywhere on the shared path, what remains may already be too little: the whole subtree is left.
        low = np.flatnonzero(grown[: d + 1] + (len(s) - np.arange(d + 1)) < need)
        if len(low):
            d = int(low[0])
        while d < len(s) and grown[d] + len(s) - d >= need:
            part = s[d : d + step]
            at = np.minimum(np.searchsorted(query, part), len(query) - 1)
            grown[d + 1 : d + 1 + len(part)] = grown[d] + np.cumsum(query[at] == part)
            d += len(part)
        path, depth, counts = s, d, grown
        if d == len(s) and grown[d] >= need:
            out[i] = int(grown[d])
    return out


LINKS = "a long, b long, common int"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32())])


def _compare(num: int, den: int):
    def compare(key, table):
        ids, ns = table.column("doc_id").to_pylist(), table.column("n").to_pylist()
        sets = [np.frombuffer(s.as_buffer(), "<u8")[::-1] for s in table.column("shingles")]
        asks = table.column("asks").to_pylist()
        members = [i for i, a in enumerate(asks) if not a]
        rows = []
        for q in (i for i, a in enumerate(asks) if a):
            found = tree_overlaps(sets[q], [sets[i] for i in members], [int(pair_overlap(ns[q], ns[i], num, den)) for i in members])
            rows += [(ids[q], ids[i], c) for i, c in zip(members, found) if c >= 0 and ids[i] != ids[q]]
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 3, _LINKS_ARROW.types)], schema=_LINKS_ARROW)

    return compare


def compared(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Links (a, b, common) among written pairs (query, member, n: shingles of the member)."""
    totals = written(pairs.groupBy("query").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks")), "blocks")
    placed = pairs.join(totals, "query").select("query", "member", F.pmod(F.xxhash64("member"), "blocks").alias("block"))
    body = sets.select("doc_id", "n", "shingles")
    members = placed.join(body, F.col("member") == F.col("doc_id")).select("query", "block", F.lit(False).alias("asks"), "doc_id", "n", "shingles")
    queries = placed.select("query", "block").distinct().join(body, F.col("query") == F.col("doc_id")).select("query", "block", F.lit(True).alias("asks"), "doc_id", "n", "shingles")
    out = written(members.unionByName(queries).groupBy("query", "block").applyInArrow(_compare(num, den), LINKS), "links")
    discard(totals)
    return out


def _block_links(num: int, den: int, every: bool):
    """Links between the sets of two blocks, or within one: every one, or those that connect labels not yet connected."""

    def compare(key, table):
        ids, ns, labels, asks = (table.column(c).to_pylist() for c in ("doc_id", "n", "label", "asks"))
        sets = [np.frombuffer(s.as_buffer(), "<u8")[::-1] for s in table.column("shingles")]
        root: dict[int, int] = {}

        def top(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        one = [i for i, a in enumerate(asks) if a]
        two = [i for i, a in enumerate(asks) if not a]
        rows = []
        for k, q in enumerate(one):
            mine = top(labels[q])
            others = [i for i in (two or one[k + 1 :]) if every or top(labels[i]) != mine]
            needs = [int(pair_overlap(ns[q], ns[i], num, den)) for i in others]
            for i, c in zip(others, tree_overlaps(sets[q], [sets[i] for i in others], needs)):
                if c >= 0 and (every or top(labels[i]) != top(labels[q])):
                    root[top(labels[i])] = top(labels[q])
                    rows.append((ids[q], ids[i], c))
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 3, _LINKS_ARROW.types)], schema=_LINKS_ARROW)

    return compare


def block_links(rest: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN, every: bool = False) -> DataFrame:
    """Links among classes that meet at the shingles of ``rest`` and have different labels.

    Classes that named the same pivot are cut into blocks of bounded size. Blocks that meet at a shingle, with
    sizes and positions that allow a link, are compared as wholes, so each set moves once for each partner block:
    no row is made for a pair of classes unless it is a link, and, but for ``every``, one that connects two labels.
    """
    classes = rest.groupBy("doc_id", "n", "label", "cluster").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    parts = classes.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("long").alias("parts"))
    placed = written(classes.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).drop("parts"), "blocks")
    block = F.struct("cluster", "part")
    met = rest.drop("n", "label", "cluster").join(placed, "doc_id").groupBy("shingle", block.alias("block")).agg(F.max("left").alias("most"), F.min("n").alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = written(met, "meeting")
    able = F.expr(f"least(a.most, b.most) * {num + den} >= (a.least + b.least) * {num} AND a.block <= b.block AND (a.low <> b.high OR a.high <> b.low)")
    pairs = met.alias("a").join(met.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & able).select(F.col("a.block").alias("one"), F.col("b.block").alias("two")).distinct()
    pairs = written(pairs, "pairs")
    discard(met)
    body = placed.select(block.alias("block"), "doc_id", "label").join(sets.select("doc_id", "n", "shingles"), "doc_id")
    first = pairs.join(body, F.col("one") == F.col("block")).withColumn("asks", F.lit(True))
    second = pairs.filter("one <> two").join(body, F.col("two") == F.col("block")).withColumn("asks", F.lit(False))
    out = written(first.unionByName(second).drop("block").groupBy("one", "two").applyInArrow(_block_links(num, den, every), LINKS), "links")
    discard(placed, pairs)
    return out


def _meetings(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where two classes or more meet (shingle, doc_id, n, left, pivot), and the pivot that each class names most."""
    every = sets.select("doc_id", "n", "own", "centre", F.posexplode("prefix").alias("place", "shingle"))
    every = written(every.select("shingle", "doc_id", "n", "centre", (F.col("n") - F.col("own") - F.col("place")).alias("left")), "met")
    pivots = every.groupBy("shingle").agg(F.max_by("doc_id", F.struct("centre", -F.col("doc_id"))).alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    met = written(every.join(pivots, "shingle").drop("centre"), "shared")
    discard(every)
    named = met.filter("pivot <> doc_id").groupBy("doc_id", "n", "pivot").agg(F.count(F.lit(1)).alias("c"))
    chosen = named.groupBy("doc_id", "n").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("query")).select("query", F.col("doc_id").alias("member"), "n")
    return met, written(chosen, "chosen")


def _clustered(met: DataFrame, chosen: DataFrame) -> DataFrame:
    at = chosen.select(F.col("member").alias("doc_id"), "query")
    return met.join(at, "doc_id", "left").withColumn("cluster", F.coalesce("query", "doc_id")).drop("query")


def connecting_links(sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Links that connect all classes that links connect; not each link within a component is looked for."""
    met, chosen = _meetings(sets)
    stars = compared(chosen, sets, num, den)
    at = written(components(stars.select("a", "b")), "stars")
    labelled = met.drop("pivot").join(at, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    labelled = written(_clustered(labelled, chosen), "labels")
    discard(met, chosen, at)
    undone = labelled.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("shingle")
    rest = written(labelled.join(undone, "shingle"), "rest")
    discard(labelled)
    more = block_links(rest, sets, num, den)
    discard(rest)
    return stars.unionByName(more)


def all_links(sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Every link (a, b, common) between two classes, once."""
    met, chosen = _meetings(sets)
    rest = written(_clustered(met.drop("pivot").withColumn("label", F.col("doc_id")), chosen), "rest")
    discard(met, chosen)
    out = block_links(rest, sets, num, den, every=True)
    discard(rest)
    return out


class Classes:
    """Documents in classes of equal shingle sets, and the sets of classes that may have a partner.

    ``signed``: doc_id, n, sig1, sig2 of each row; ``classes``: n, sig1, sig2, rep.doc_id (the smallest); ``sets``.
    """

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, chunk_bytes: int, chunk_rows: int):
        table, buckets = X.dealt(docs, chunk_bytes, chunk_rows)
        groups = table.groupBy("chunk")
        self.signed = written(groups.applyInArrow(_signatures(width), "doc_id long, chunk long, n long, sig1 long, sig2 long"), "signatures")
        self.able = self.signed.filter("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(self.able.groupBy("n", "sig1", "sig2").agg(F.min(F.struct("doc_id", "chunk")).alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
        reps = self.classes.select(F.col("rep.chunk").alias("chunk"), F.lit(_REP).cast("long").alias("part"), F.col("rep.doc_id").alias("bucket"), F.lit(None).cast("binary").alias("bits"))
        front = groups.cogroup(reps.groupBy("chunk")).applyInArrow(_send_front(buckets, width, num, den), X.SENT).groupBy("bucket").applyInArrow(_mark_front, X.ANSWER)
        notes = written(front.unionByName(reps), "front")
        counts = groups.cogroup(notes.groupBy("chunk")).applyInArrow(_send_all(buckets, width, num, den), X.SENT).groupBy("bucket").applyInArrow(_count_all, X.ANSWER)
        self.sets = written(groups.cogroup(notes.unionByName(counts).groupBy("chunk")).applyInArrow(_make_sets(buckets, width, num, den), SETS), "sets")
        discard(table, notes)


def linked(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, chunk_bytes: int = X.CHUNK_BYTES, chunk_rows: int = X.CHUNK_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) for each row.

    Takes doc_id and text; other columns are ignored. A text with fewer words than ``width`` has its whole sequence
    as one shingle; a null or empty text, or one without words, has none and links with nothing, and its
    component_id is its own. A row with a null doc_id links with nothing and has a null component_id. Rows that
    repeat a doc_id are one node with the links of each. An empty table gives an empty result.
    """
    c = Classes(docs, width, num, den, chunk_bytes, chunk_rows)
    found = connecting_links(c.sets, num, den)
    same = c.able.join(c.classes, ["n", "sig1", "sig2"]).select(F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("rep"))
    # Rows that repeat a doc_id with different texts tie their classes together.
    ties = same.groupBy("a").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = written(components(found.select("a", "b").unionByName(ties)), "components")
    named = c.classes.select("n", "sig1", "sig2", F.col("rep.doc_id").alias("rep")).join(whole, F.col("rep") == F.col("node"), "left")
    named = written(named.select("n", "sig1", "sig2", F.coalesce("component", "rep").alias("of")), "named")
    discard(c.sets, c.classes, whole)
    out = c.signed.join(named, ["n", "sig1", "sig2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("of")).otherwise(F.col("doc_id"))).alias("component_id"))


def joined(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, chunk_bytes: int = X.CHUNK_BYTES, chunk_rows: int = X.CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The join itself: (members, links), no link between different sets left out.

    ``members`` has one row for each row of ``docs``: doc_id, n_shingles, class_id (smallest doc_id with the same
    set) and n_links, the number of other rows that it links with, equal sets included. ``links`` has each pair of
    linked classes once: class_a, class_b, common (shingles in both). Rows without an id or without words have no
    class and no links.
    """
    c = Classes(docs, width, num, den, chunk_bytes, chunk_rows)
    found = all_links(c.sets, num, den)
    rows = c.classes.select(F.col("rep.doc_id").alias("node"), "rows")
    ends = found.selectExpr("a AS x", "b AS node").unionByName(found.selectExpr("b AS x", "a AS node"))
    partners = ends.join(rows, "node").groupBy("x").agg(F.sum("rows").alias("others"))
    sized = c.classes.select("n", "sig1", "sig2", F.col("rep.doc_id").alias("class_id"), "rows").join(partners, F.col("class_id") == F.col("x"), "left")
    sized = written(sized.select("n", "sig1", "sig2", "class_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "classes")
    out = c.signed.withColumn("known", F.col("doc_id").isNotNull()).join(sized, ["n", "sig1", "sig2"], "left")
    members = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("class_id")).alias("class_id"), F.when(F.col("known"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return members, found.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "common")
