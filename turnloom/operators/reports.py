"""Reports over transcript rows: cue extraction, evidence revisions, roll-ups, change sets and edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cue patterns by object type, with how many of a type a session may have: fixed values.
CUES = {
    "decision": (r"(?i)\b(decided|decision|agreed|agreement|final|beschlossen|beschluss|entschieden|entscheidung|machen wir so)\b", 8),
    "action_item": (r"(?i)\b(action|todo|follow up|i will|i'll|we need to|can you|please|owner|deadline|task|aufgabe|bitte|ich mache|ich uebernehme|wir muessen|frist|bis)\b", 8),
    "open_question": (r"(?i)\?|\b(open question|unclear|clarify|who will|what is|what are|how do|offen|unklar|klaeren|frage)\b", 6),
    "risk": (r"(?i)\b(risk|blocker|blocked|blocking|problem|issue|concern|warning|delay|risiko|blocker|blockiert|problem|kritisch|verzoegerung)\b", 6),
    "claim": (r"(?i)\b(is|are|has|have|was|were|ist|sind|hat|haben|war|waren)\b.*\b(\d+|percent|prozent|million|millionen|eur|usd)\b", 4),
}


def cue_objects(rows: DataFrame, key: str, text: str = "text", cues: dict[str, tuple[str, int]] = CUES) -> DataFrame:
    """Rows with a cue, once per type, numbered in row order up to the type's cap."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(k).alias("type"), F.lit(n).alias("cap"))) for k, (p, n) in cues.items())))
    each = rows.select(key, "idx", text, F.explode(found).alias("_c")).select(key, "idx", text, F.col("_c.type").alias("type"), F.col("_c.cap").alias("_cap"))
    place = F.row_number().over(W.partitionBy(key, "type").orderBy("idx"))
    return each.withColumn("number", place).filter(F.col("number") <= F.col("_cap")).drop("_cap")


def ordered_sha256(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, digest, rows): SHA-256 of a key's values joined by commas in the order of ``at``, a whole number, then value.

    The same hash as that of one joined string, but no list or string is longer than 256 values: blocks of
    neighbouring places are joined in parallel, and one hash reads a key's blocks in order, as a stream.
    """
    kind = rows.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, n, held = None, 0, 0, []
        for batch in batches:
            out = []
            for k, block, v in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "v"))):
                if n and ((k, block) != now or n == 256):
                    out.append((*now, part, n, ",".join(held) if held else None))
                    part, n, held = part + 1 if (k, block) == now else 0, 0, []
                now, n = (k, block), n + 1
                if v is not None:
                    held.append(v)
            yield _arrow(out, batch.schema.field("k").type, "block", "part", "n", "v")
            last = batch.schema.field("k").type
        if n:
            yield _arrow([(*now, part, n, ",".join(held) if held else None)], last, "block", "part", "n", "v")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state, begun = (), 0, None, False
        for batch in batches:
            out = []
            for k, m, v in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "v"))):
                if now != (k,):
                    if now:
                        out.append((*now, state.hexdigest(), n))
                    now, n, state, begun = (k,), 0, hashlib.sha256(), False
                n += m
                if v is not None:
                    state.update(("," * begun + v).encode())
                    begun = True
            yield _arrow(out, batch.schema.field("k").type, "v", "n")
            last = batch.schema.field("k").type
        if now:
            yield _arrow([(*now, state.hexdigest(), n)], last, "v", "n")

    each = rows.select(F.col(key).alias("k"), F.shiftright(F.col(at).cast("long"), 8).alias("block"), F.col(at).alias("at"), F.col(value).cast("string").alias("v"))
    joined = each.repartition("k", "block").sortWithinPartitions("k", "block", "at", "v").mapInArrow(pieces, f"k {kind}, block long, part long, n long, v string")
    return joined.repartition("k").sortWithinPartitions("k", "block", "part").mapInArrow(digest, f"k {kind}, v string, n long").select(F.col("k").alias(key), F.col("v").alias("digest"), F.col("n").alias("rows"))


def _arrow(rows: list[tuple], key: pa.DataType, *names: str) -> pa.RecordBatch:
    kinds = [key, *(pa.string() if x == "v" else pa.int64() for x in names)]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", *names])


def row_revision(*columns: str) -> Column:
    """Hash of a row's content; null and the empty string differ."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns)), 256), 1, 16)


def revision_ids(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """Hash over a session's row revisions in order; no list of a session's rows is built."""
    return ordered_sha256(rows, key, "idx", revision).select(key, F.substring("digest", 1, 32).alias("revision_id"), "rows")


def stale_evidence(evidence: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence whose row is gone, or has another revision or speaker; null speakers equal one another."""
    now = rows.select(*keys, F.col("revision").alias("_rev"), F.col("speaker").alias("_speaker"), F.lit(True).alias("_there"))
    j = evidence.join(now, keys, "left")
    why = F.when(F.col("_there").isNull(), "missing").when(F.col("revision") != F.col("_rev"), "changed").when(~F.col("speaker").eqNullSafe(F.col("_speaker")), "reassigned").otherwise("current")
    return j.withColumn("state", why).drop("_rev", "_speaker", "_there")


def change_set(old: DataFrame, new: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """insert, update, delete or keep for each key of two versions."""
    a = old.select(*keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(hash_column).alias("_new"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row with the highest version of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(v) for v in version)))
    return rows.withColumn("_p", place).filter("_p = 1").drop("_p")


def renamed(rows: DataFrame, renames: DataFrame, key: str, label: str = "speaker") -> DataFrame:
    """Rows with labels replaced as (key, from_label, to_label) says."""
    return rows.join(renames.select(key, F.col("from_label").alias(label), "to_label"), [key, label], "left").withColumn(label, F.coalesce("to_label", label)).drop("to_label")


def corrected(rows: DataFrame, corrections: DataFrame, keys: list[str], label: str = "speaker") -> DataFrame:
    """Rows reassigned to the label of a correction, marked as confirmed by a user."""
    c = corrections.select(*keys, F.col(label).alias("_to"))
    return rows.join(c, keys, "left").withColumns({"source": F.when(F.col("_to").isNotNull(), F.lit("user_confirmed")).otherwise(F.lit("embedding")), label: F.coalesce("_to", label)}).drop("_to")


def missing_keys(selected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Selected keys without a row."""
    return selected.join(rows, keys, "left_anti")


def speaker_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech_ms"))


def diverse_top(rows: DataFrame, group: str, by: str, key: str, limit: int) -> DataFrame:
    """The best row of each group first, then the rest by rank, up to ``limit``."""
    own = F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), key))
    return rows.withColumn("_lead", F.when(own == 1, 0).otherwise(1)).orderBy("_lead", F.desc(by), key).limit(limit).drop("_lead")


def outline(rows: DataFrame, key: str, most: int = 80) -> DataFrame:
    """Every (n // most)-th row of a session, the first ``most`` of them."""
    w = W.partitionBy(key)
    numbered = rows.withColumns({"_p": F.row_number().over(w.orderBy("idx")) - 1, "_n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return numbered.filter((F.col("_p") % step == 0) & (F.col("_p") / step < most)).drop("_p", "_n")
