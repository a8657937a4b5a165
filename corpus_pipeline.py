"""A corpus pipeline of five stages over the table of documents.

Each stage reads all that the one before it kept, and its output is written as Parquet and read again before the
next. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import decontaminate, jaccard, lines, mixing, oracles, rules
from turnloom.llm.storage import delete, discard, made, written

#: Intermediate folders that the result of a stage may still read, by stage.
_left: dict[str, list[str]] = {}


def _stage(step):
    """A stage that first deletes the intermediate tables of the stages before it: what they returned has been written by
    then. Where ``docs`` itself still reads one of them, they stay."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [f.__name__ for _, f in STAGES]
        for before in order[: order.index(step.__name__)]:
            if delete(spark, _left.get(before, []), docs):
                _left.pop(before, None)
        since = len(made())
        out = step(spark, docs, sf_dir)
        _left[step.__name__] = _left.get(step.__name__, []) + made(since)
        return out

    return run_step


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids``, as one semi join; a null id equals a null id."""
    return docs.join(ids.select(F.col("doc_id").alias("_id")), F.expr("doc_id <=> _id"), "left_semi")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own verdict."""
    judged = rules.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS[1:])
    return judged.filter("kept").select("doc_id", *(F.col(f"_{c}").alias(c) for c in COLUMNS[1:]))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents have; a document left without text stays, empty."""
    kept = lines.drop_frequent_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id are in no group."""
    groups = jaccard.linked(docs)
    return _with_ids(docs.select(*COLUMNS), groups.filter("component_id IS NULL OR component_id = doc_id"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing)]

ORACLE_SQL = oracles.PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is a table before the next begins."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
