"""Vector assignment: scoring against profiles, prototypes, robust centroids, gallery search.

Sums per dimension are grouped aggregates over exploded vectors, so that partial sums are combined before the
shuffle and no group's vectors are gathered. Profiles are joined per key; queries meet blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from turnloom.functions import vectors as V
from turnloom.functions.numbers import quantized


def weighted_centroids(rows: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Unit-length weighted mean of each key's vectors, with the number of rows and the summed weight."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    parts = rows.select(*keys, w.alias("_w"), F.posexplode(V.doubles(F.col(vector))).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    out = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.max("_n").alias("rows"), F.max("_s").alias("weight"))
    return out.select(*keys, "rows", "weight", V.normalized(F.transform("_v", lambda x: x["_m"])).alias("centroid"))


def scores(rows: DataFrame, profiles: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Cosine of each row with each profile of its key (label, centroid)."""
    return rows.join(profiles.select(*keys, "label", "centroid"), keys).withColumn("similarity", V.cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def assigned(scored: DataFrame, row_keys: list[str], least_similarity: float = 0.43, least_margin: float = 0.03) -> DataFrame:
    """Best label of each row, its margin to the second (1 where there is none), and the label if both gates pass."""
    ranked = scored.groupBy(*row_keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "label"))).alias("r"))
    top, second = -F.col("r")[0]["s"], -F.get(F.col("r"), F.lit(1))["s"]
    out = ranked.select(*row_keys, F.col("r")[0]["label"].alias("top_label"), top.alias("top_similarity"), F.coalesce(top - second, F.lit(1.0)).alias("margin"))
    return out.withColumn("assigned", F.when((F.col("top_similarity") >= least_similarity) & (F.col("margin") >= least_margin), F.col("top_label")))


def probabilities(scored: DataFrame, row_keys: list[str], temperature: float = 0.07, unknown_similarity: float = 0.3) -> DataFrame:
    """Softmax over a row's labels and an unknown class of fixed similarity; one row per label, unknown as null."""
    top = F.max("similarity").over(W.partitionBy(*row_keys))
    with_unknown = scored.select(*row_keys, "label", "similarity").unionByName(scored.select(*row_keys).distinct().withColumns({"label": F.lit(None).cast("string"), "similarity": F.lit(unknown_similarity)}))
    e = with_unknown.withColumn("_e", F.exp((F.col("similarity") - top) / temperature))
    return e.withColumn("probability", F.col("_e") / F.sum("_e").over(W.partitionBy(*row_keys))).drop("_e")


def prototypes(rows: DataFrame, keys: list[str], quality: Column, tie: str, most: int = 32) -> DataFrame:
    """The best rows of each label by quality, ``most`` at most."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(quality.desc(), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def prototype_scores(rows: DataFrame, protos: DataFrame, keys: list[str], row_keys: list[str], top_k: int = 12, centroid_blend: float = 0.555) -> DataFrame:
    """(1 - b) x mean of the k best cosines with a label's prototypes + b x cosine with their centroid."""
    centers = weighted_centroids(protos, [*keys, "label"], "embedding").select(*keys, "label", "centroid")
    p = protos.select(*keys, "label", F.col("embedding").alias("proto"))
    pairs = rows.join(p, keys).select(*keys, *row_keys, "label", V.cosine(F.col("embedding"), F.col("proto")).alias("c"))
    best = pairs.groupBy(*keys, *row_keys, "label").agg(F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, top_k).alias("b"))
    mean = F.aggregate("b", F.lit(0.0), lambda s, x: s + x) / F.size("b")
    near = rows.join(centers, keys).select(*keys, *row_keys, "label", V.cosine(F.col("embedding"), F.col("centroid")).alias("near"))
    return best.join(near, [*keys, *row_keys, "label"]).select(*keys, *row_keys, "label", ((1 - centroid_blend) * mean + centroid_blend * F.col("near")).alias("score"))


def leave_one_out(rows: DataFrame, keys: list[str], row_key: str, vector: str = "embedding") -> DataFrame:
    """Cosine of each row with the sum of the other vectors of its group; null for a group of one."""
    parts = rows.select(*keys, row_key, F.posexplode(V.doubles(F.col(vector))).alias("i", "x"))
    totals = parts.groupBy(*keys, "i").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"))
    sums = totals.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("total"), F.max("n").alias("n"))
    others = F.zip_with("total", V.doubles(F.col(vector)), lambda t, x: t - x)
    return rows.join(sums, keys).select(*keys, row_key, F.when(F.col("n") > 1, V.cosine(V.doubles(F.col(vector)), others)).alias("similarity"))


def outlier_limits(rows: DataFrame, keys: list[str], value: str, least: float = 0.08, factor: float = 3.0) -> DataFrame:
    """Median, median absolute deviation and the cut below which a row is an outlier."""
    mid = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    dev = rows.join(mid, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return dev.withColumn("cut", F.col("median") - F.greatest(F.lit(least), factor * F.col("mad")))


def robust_centroids(rows: DataFrame, keys: list[str], row_key: str, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Centroids without the rows that lie below the cut of their group, and the cohesion of those kept."""
    first = weighted_centroids(rows, keys, vector, weight).select(*keys, "centroid")
    near = rows.join(first, keys).withColumn("similarity", V.cosine(F.col(vector), F.col("centroid"))).drop("centroid")
    kept = near.join(outlier_limits(near, keys, "similarity").select(*keys, "cut"), keys).filter("similarity >= cut")
    centers = weighted_centroids(kept, keys, vector, weight)
    return centers.join(kept.groupBy(*keys).agg(F.avg("similarity").alias("cohesion")), keys)


def medoids(rows: DataFrame, keys: list[str], row_key: str, vector: str = "embedding") -> DataFrame:
    """The row of each group with the largest mean cosine to the group, itself included: the dot product with the sum of unit vectors, so no pairs are formed. Means equal to six decimals tie, the smaller key first."""
    unit = rows.withColumn("_u", V.normalized(F.col(vector)))
    parts = unit.select(*keys, F.posexplode("_u").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("total"), F.max("n").alias("n"))
    means = unit.join(sums, keys).withColumn("mean_similarity", V.dot(F.col("_u"), F.col("total")) / F.col("n"))
    best = means.groupBy(*keys).agg(F.min(F.struct((-quantized(F.col("mean_similarity"))).alias("m"), row_key)).alias("b"))
    return best.select(*keys, F.col(f"b.{row_key}").alias(row_key), (-F.col("b.m")).alias("mean_similarity"))


#: Queries that meet a block of rows at once; blocks of rows, at least, and the rows of one when there are more.
QUERY_BLOCK, ROW_BLOCKS, BLOCK_ROWS = 16384, 12, 1 << 16
#: Pairs of a query and a row that are held at once.
PAIRS = 1 << 20


class Best:
    """The k best rows so far of each query of a block, of equal ones those that came first. NaN is above all numbers."""

    def __init__(self, k: int, queries: int):
        self.k, self.least, self.full = k, np.full(queries, -np.inf), np.zeros(queries, bool)
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.parts, self.waiting, self.room = [], 0, 0

    def offered(self, rank: np.ndarray, margin: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of a tile that can be among the best when ranks are off by ``margin`` at most."""
        low, few = self.least - margin, np.flatnonzero(~self.full)
        if len(few) and rank.shape[1] > self.k:
            low[few] = np.partition(rank[few], -self.k, axis=1)[:, -self.k] - margin
        mask = rank > low[:, None]
        if len(few):
            mask[few] = rank[few] >= low[few][:, None]
        return np.nonzero(mask if allowed is None else mask & allowed)

    def add(self, queries: np.ndarray, rows: np.ndarray, s: np.ndarray) -> None:
        """Rows are numbered as they come; later ones have higher numbers."""
        self.parts.append((queries, rows, s))
        self.waiting += len(queries)
        if self.waiting > self.room:
            self.settle()

    def settle(self) -> None:
        q, at, s = (np.concatenate(c) for c in zip(self.held, *self.parts))
        odd = np.isnan(s)
        rank = np.where(odd, np.inf, s)
        order = np.lexsort((at, -rank, ~odd, q) if odd.any() else (at, -rank, q))
        q, at, s, rank = q[order], at[order], s[order], rank[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        last, kept = place == self.k - 1, place < self.k
        self.least[q[last]], self.full[q[last]] = rank[last], True
        self.held, self.parts, self.waiting = (q[kept], at[kept], s[kept]), [], 0
        self.room = max(PAIRS >> 4, len(self.least) * self.k)


    def found(self, ids: list, matches: list) -> list[list]:
        """Queries, rows and scores as columns; a score of -inf is none."""
        self.settle()
        q, at, s = self.held
        return [[ids[i] for i in q], [matches[i] for i in at], [None if x == -np.inf else x for x in s.tolist()]]


class _Nearest:
    """The k best rows so far of each query of a block; sums run through the dimensions in order, as ``vectors.dot`` does."""

    def __init__(self, k: int, digits: int | None):
        self.k, self.digits = k, digits
        self.ids, self.vectors, self.matches = [], [], []
        self.best, self.sides, self.place = None, {}, {}  # made when all queries are there

    def ask(self, batch: pa.RecordBatch) -> None:
        self.ids += batch.column("query").to_pylist()
        self.vectors += batch.column("_v").to_pylist()

    @staticmethod
    def _sides(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: places of its vectors, the vectors as columns, and their norms; 0 for one with nulls."""
        places: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None:
                places.setdefault(len(v), []).append(i)
        out = {}
        for size, at in places.items():
            m = np.array([vectors[i] if None not in vectors[i] else [0.0] * size for i in at], float).reshape(len(at), size).T.copy()
            with np.errstate(invalid="ignore", over="ignore"):
                out[size] = np.array(at), m, np.sqrt(_Nearest._dots(m, m))
        return out

    @staticmethod
    def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
        for x, y in zip(a, b):
            total += x * y
        return total

    def _cosines(self, dots: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            s = np.where(n <= 0, 0.0, dots / n)
            if self.digits is not None:
                scale = float(10**self.digits)
                s = np.floor(s * scale + 0.5) / scale
        return s

    def _similarities(self, theirs: dict, rows: int) -> np.ndarray:
        """Cosines of all queries with the rows, -inf where there is none."""
        out = np.full((len(self.ids), rows), -np.inf)
        for size in self.sides.keys() & theirs.keys():
            (at, a, n), (to, b, m) = self.sides[size], theirs[size]
            with np.errstate(invalid="ignore", over="ignore"):
                out[np.ix_(at, to)] = self._cosines(self._dots(a[:, :, None], b[:, None, :]), n[:, None] * m[None, :])
        return out

    @staticmethod
    def _units(sides: dict, count: int) -> np.ndarray | None:
        """The vectors as columns of length 1 or 0; None where they differ in length or lie outside of a safe range."""
        if len(sides) != 1:
            return None
        at, m, n = next(iter(sides.values()))
        if len(at) < count or not np.all((n == 0) | ((n > 1e-100) & (n < 1e100))):
            return None
        return m / np.where(n > 0, n, 1.0)

    def add(self, batch: pa.RecordBatch) -> None:
        matches, vectors = batch.column("match").to_pylist(), batch.column("_v").to_pylist()
        if not self.ids:
            return
        if self.best is None:
            self.best, self.sides = Best(self.k, len(self.ids)), self._sides(self.vectors)
            self.units = self._units(self.sides, len(self.ids))
            for i, q in enumerate(self.ids):
                self.place.setdefault(q, []).append(i)
        step = max(1, PAIRS // len(self.ids))
        for low in range(0, len(matches), step):
            keys = matches[low : low + step]
            theirs = self._sides(vectors[low : low + step])
            itself = [(i, j) for j, m in enumerate(keys) for i in self.place.get(m, ())]
            allowed = None
            if itself:
                allowed = np.ones((len(self.ids), len(keys)), bool)
                allowed[tuple(zip(*itself))] = False
            i, j, s = self._tile(theirs, len(keys), allowed)
            self.best.add(i, len(self.matches) + j, s)
            self.matches += keys

    def _tile(self, theirs: dict, rows: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that can be among the best, with their exact cosines: a matrix product, whose sums run in another order, only tells which."""
        units = None if self.units is None else self._units(theirs, rows)
        if units is not None and len(units) == len(self.units):
            rank = self.units.T @ units
            if allowed is not None:
                rank[~allowed] = -np.inf
            i, j = self.best.offered(rank, 1e-9 + (0.0 if self.digits is None else 10.0**-self.digits), allowed)
            (_, a, n), (_, b, m) = next(iter(self.sides.values())), next(iter(theirs.values()))
            total = np.zeros(len(i))
            for x, y in zip(a, b):
                total += x[i] * y[j]
            return i, j, self._cosines(total, n[i] * m[j])
        s = self._similarities(theirs, rows)
        rank = np.where(np.isnan(s), np.inf, s)  # NaN is the largest number in Spark
        if allowed is not None:
            rank[~allowed] = -np.inf
        i, j = self.best.offered(rank, 0.0, allowed)
        return i, j, s[i, j]

    def found(self) -> list[list]:
        return [[], [], []] if self.best is None else self.best.found(self.ids, self.matches)


def met(asked: DataFrame, told: DataFrame, queries: int, rows: int, state, out: StructType) -> DataFrame:
    """Blocks of the queries (query, ...) meet blocks of the rows (match, ..., the same columns), as streams.

    ``queries`` and ``rows`` say how many there are, ``state`` makes what holds the queries of a block (``ask``), sees its
    rows, which come sorted by ``match`` (``add``), and tells the columns of ``out`` at the end (``found``). Each task's work
    and what it passes on are bounded by the sizes of the blocks.
    """
    parts, blocks = max(1, -(-queries // QUERY_BLOCK)), max(ROW_BLOCKS, -(-rows // BLOCK_ROWS))
    kinds, rest = (asked.schema["query"].dataType, told.schema["match"].dataType), [c for c in asked.columns if c != "query"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = asked.select(deal("query", parts).alias("_q"), every(blocks).alias("_b"), F.lit(0).alias("_side"), "query", F.lit(None).cast(kinds[1]).alias("match"), *rest)
    told = told.select(every(parts).alias("_q"), deal("match", blocks).alias("_b"), F.lit(1).alias("_side"), F.lit(None).cast(kinds[0]).alias("query"), "match", *rest)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        found = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held.found(), schema.types)], schema=schema)
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_q", "_b", "_side")])
            cuts = [0, *(np.flatnonzero(np.any(at[1:] != at[:-1], axis=1)) + 1), len(at)] if len(at) else []
            for low, high in zip(cuts, cuts[1:]):
                if now != tuple(at[low, :2]):
                    if held is not None:
                        yield found()
                    now, held = tuple(at[low, :2]), state()
                (held.add if at[low, 2] else held.ask)(batch.slice(low, high - low))
        if held is not None:
            yield found()

    return asked.unionByName(told).repartition(F.xxhash64("_q", "_b")).sortWithinPartitions("_q", "_b", "_side", "match").mapInArrow(run, out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_key: str, row_key: str, vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k rows with the largest cosine to each query vector, ties by row key: exact search of a stated query set.

    A task holds a block of queries, one batch of rows and the best k rows of each query, and passes on only these. With
    ``digits`` similarities are rounded before they are ranked, so that sums in another order give the same places.
    """
    q = queries.select(F.col(query_key).alias("query"), F.col(vector).cast("array<double>").alias("_v")).filter("query IS NOT NULL")
    body = rows.select(F.col(row_key).alias("match"), F.col(vector).cast("array<double>").alias("_v")).filter("match IS NOT NULL")
    out = StructType([StructField("query", q.schema["query"].dataType), StructField("match", body.schema["match"].dataType), StructField("similarity", DoubleType())])
    both = met(q, body, q.count(), body.count(), lambda: _Nearest(k, digits), out)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "match"))
    return both.withColumn("place", place).filter(F.col("place") <= k)


def gallery_match(queries: DataFrame, samples: DataFrame, keys: list[str], query_key: str, least_similarity: float = 0.62, duplicate: float = 0.995, bonus: float = 0.025, least_margin: float = 0.05) -> DataFrame:
    """The person whose best sample, helped by one corroborating sample, is nearest.

    A second sample corroborates if its cosine reaches ``least_similarity`` and it isn't a near copy of the best
    (mutual cosine below ``duplicate``); it adds up to ``bonus``. The person counts if the score reaches
    ``least_similarity`` and leads the next person by ``least_margin``.
    """
    s = samples.select(*keys, "person", "sample", F.col("embedding").alias("v"))
    pairs = queries.select(*keys, query_key, F.col("embedding").alias("q")).join(s, keys).withColumn("c", V.cosine(F.col("q"), F.col("v")))
    place = F.row_number().over(W.partitionBy(*keys, query_key, "person").orderBy(F.desc("c"), "sample"))
    ranked = pairs.withColumn("place", place)
    best = ranked.filter("place = 1").select(*keys, query_key, "person", F.col("c").alias("top"), F.col("v").alias("best_v"))
    other = ranked.filter((F.col("place") > 1) & (F.col("c") >= least_similarity)).join(best, [*keys, query_key, "person"]).filter(V.cosine(F.col("v"), F.col("best_v")) < duplicate)
    second = other.groupBy(*keys, query_key, "person").agg(F.max("c").alias("second"))
    scored = best.join(second, [*keys, query_key, "person"], "left").withColumn("score", F.col("top") + F.coalesce(F.least(F.lit(bonus), bonus * F.col("second")), F.lit(0.0)))
    ranks = scored.groupBy(*keys, query_key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "person"))).alias("r"))
    top, nxt = -F.col("r")[0]["s"], -F.get(F.col("r"), F.lit(1))["s"]
    ok = (top >= least_similarity) & (F.coalesce(top - nxt, F.lit(1.0)) >= least_margin)
    return ranks.select(*keys, query_key, top.alias("score"), F.when(ok, F.col("r")[0]["person"]).alias("person"))


def duplicate_profiles(profiles: DataFrame, keys: list[str], threshold: float = 0.86) -> DataFrame:
    """Pairs of profiles of a key whose centroids are alike."""
    a, b = profiles.select(*keys, F.col("label").alias("label_a"), F.col("centroid").alias("ca")), profiles.select(*keys, F.col("label").alias("label_b"), F.col("centroid").alias("cb"))
    pairs = a.join(b, keys).filter("label_a < label_b").withColumn("similarity", V.cosine(F.col("ca"), F.col("cb")))
    return pairs.filter(F.col("similarity") >= threshold).drop("ca", "cb")
