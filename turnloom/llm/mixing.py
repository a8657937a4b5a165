"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: the mix holds ``share`` times all words. Sources share it by weight; none gets more than ``cap`` times
   its own words, and what is over goes to the others by weight.
2. Seats: the mix is cut into blocks of ``block_words`` words. Blocks go to sources by the highest quotients
   target / (2 k - 1), and a source's blocks to its shards in the same way by their words: whole quotas everywhere.
3. Selection: a shard's documents in seeded order are one stream of blocks. With a quota of q blocks of n, every
   block is taken q // n times, and of the rest every n / (q mod n)-th from a seeded offset on.

Sizes move once, by (source, shard). A source has at most ``SHARDS`` shards, so a source's apportionment is one small
task; a shard has ``DOCS_PER_SHARD`` documents, or a ``SHARDS``-th of its source where that is more, as numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.llm.storage import written

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS = 32
DOCS_PER_SHARD, SHARDS = 1024, 1 << 16
SEED = 17


def seeded(column: Column, seed: int, what: str) -> Column:
    """A whole number from 0 to 2**32 - 1 drawn for the column's value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{what}:{seed}:"), column.cast("string"))), 1, 8), 16, 10).cast("long")


def words_in(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds weight and target to (source, source_size), one row for each source; null is the last source."""
    order = [F.col("source").isNull(), F.col("source")]
    place = F.row_number().over(W.orderBy(*order))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("double")
    full = sources.withColumns({"weight": weight, "most": cap * F.col("source_size")})
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.sum("source_size").over(everyone) * share
    by_fill = W.orderBy(F.col("most") / F.col("weight"), *order)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (whole - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / rest
    # Sources fill up in the order of most / weight; the first that the level doesn't fill sets the level for the rest.
    filled = full.withColumn("level", level).withColumn("open", F.col("most") > F.col("weight") * F.col("level"))
    fill = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everyone)["level"]
    return filled.withColumn("fill", fill).withColumn("target", F.least("most", F.coalesce(F.col("weight") * F.col("fill"), F.col("most")))).select("source", "source_size", "weight", "target")


def apportioned(parts: DataFrame, group: list[str], order: list[Column | str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the group's seats dealt by Sainte-Lague to its rows; ``seats`` is the same in all of a group.

    Every row surely gets the seats that a divisor with n seats fewer gives; only the few seats between that and a
    divisor with n seats more compete by quotient, so the work follows the rows, not the seats. Ties go by ``order``.
    """
    g = W.partitionBy(*group) if group else W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, total = F.count(F.lit(1)).over(g), F.sum(weight).over(g)

    def at(seat_count: Column) -> Column:
        return F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.greatest(seat_count, F.lit(0)) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long")

    low = parts.withColumns({"_n": n, "_w": total.cast("double")})
    low = low.withColumns({"_base": F.when(F.col(seats) > F.col("_n"), at(F.col(seats) - F.col("_n"))).otherwise(F.lit(0).cast("long")), "_top": at(F.col(seats) + F.col("_n"))})
    low = low.withColumn("_left", F.col(seats) - F.sum("_base").over(g))
    k = F.explode_outer(F.when(F.col("_top") > F.col("_base"), F.sequence(F.col("_base") + 1, F.col("_top"))))
    rivals = low.withColumn("_k", k).withColumn("_q", F.col(weight) / (2 * F.col("_k") - 1))
    place = F.row_number().over((W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(F.col("_q").desc_nulls_last(), *order, "_k"))
    won = F.when(F.col("_k").isNotNull() & (place <= F.col("_left")), 1).otherwise(0)
    return rivals.withColumn("_won", won).groupBy(*parts.columns, "_base").agg(F.sum("_won").alias("_more")).withColumn("quota", F.col("_base") + F.col("_more")).drop("_base", "_more")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of each row: doc_id, source, size, source_size, target, taken.

    A null text has size 0 and nothing is taken of it; a null source is a source of its own, after all others. Of
    no row more than ``cap`` times its size is taken. A source's taken words differ from its target by about a
    block for each shard at most. Rows that repeat a doc_id share their place in the order, one after another; rows
    without one are spread over the shards by their place in the table. The same table gives the same result on
    every run. An empty table gives an empty result. There is one row for each source in the steps that weigh
    sources against one another (one task): millions of sources pass, as numbers only.
    """
    row = F.when(F.col("doc_id").isNull(), -1 - F.monotonically_increasing_id())
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), row.alias("row")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aims = targets(sources, weights, share, cap).join(sources.select(F.col("source").alias("s2"), "docs"), F.expr("source <=> s2")).drop("s2")
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    aims = aims.withColumn("all_blocks", F.floor(F.sum("target").over(everyone) / block_words + 0.5).cast("long"))
    aims = apportioned(aims, [], [F.col("source").isNull(), F.col("source")], "target", "all_blocks").select("source", "source_size", "target", F.least(F.ceil(F.col("docs") / docs_per_shard), F.lit(SHARDS)).cast("long").alias("shards"), F.col("quota").alias("blocks"))
    aims = written(aims, "targets")
    a = aims.withColumnRenamed("source", "s2")
    placed = sized.join(a, F.expr("source <=> s2")).drop("s2").withColumn("shard", seeded(F.coalesce("doc_id", "row"), seed, "shard") % F.col("shards"))
    parts = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = apportioned(parts, ["source"], ["shard"], "words", "blocks").select(F.col("source").alias("s3"), F.col("shard").alias("shard3"), "words", "quota")
    rows = placed.join(quotas, F.expr("source <=> s3 AND shard = shard3")).drop("s3", "shard3")
    stream = W.partitionBy("source", "shard").orderBy(seeded(F.coalesce("doc_id", "row"), seed, "order"), "doc_id", "size")
    n = F.ceil(F.col("words") / block_words).cast("long")
    rows = rows.withColumns({"end": F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)), "n": n})
    rows = rows.withColumn("quota", F.least("quota", F.floor(F.lit(cap) * F.col("n")).cast("long")))
    once = F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long")
    rows = rows.withColumn("rest", F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(0))
    rows = rows.withColumn("offset", F.when(F.col("n") > 0, seeded(F.col("shard"), seed, "offset") % F.col("n")).otherwise(0))

    def passed(blocks: Column) -> Column:
        """Chosen blocks among the first ones of the stream."""
        return F.when(F.col("n") > 0, F.floor((blocks * F.col("rest") + F.col("offset")) / F.col("n"))).otherwise(0).cast("long")

    def chosen(words: Column) -> Column:
        """Words of chosen blocks among the first words of the stream."""
        full = F.floor(words / block_words).cast("long")
        return block_words * passed(full) + (words % block_words) * (passed(full + 1) - passed(full))

    taken = F.col("size") * once + chosen(F.col("end")) - chosen(F.col("end") - F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
