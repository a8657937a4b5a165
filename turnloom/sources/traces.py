"""Trace files: one JSON object a line, and truth segments in two shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.segments import transcript_lines

PAYLOAD = "speaker_id STRING, start DOUBLE, end DOUBLE, hold_seconds DOUBLE, reason STRING, replay_speed DOUBLE, text STRING, `index` LONG, pending BOOLEAN, revision LONG"
TRACE = f"time DOUBLE, event STRING, payload STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in PAYLOAD.split(','))}>"


def read_trace(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """Rows of a trace; blank lines are skipped and a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stream_trace(spark: SparkSession, path: str, schema: str = TRACE, files_per_trigger: int = 64) -> DataFrame:
    """The same rows as a stream over a folder of trace files."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, start, end, text) of truth files: a list of segments, or an object with ``segments``."""
    segment = "speaker STRING, speaker_id STRING, start DOUBLE, start_sec DOUBLE, end DOUBLE, end_sec DOUBLE, text STRING"
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in segment.split(","))
    raw = spark.read.schema(f"segments ARRAY<STRUCT<{fields}>>, {segment}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    one = F.struct("speaker", "speaker_id", "start", "start_sec", "end", "end_sec", "text")
    s = raw.select(F.explode(F.coalesce("segments", F.array(one))).alias("s"))
    return s.select(F.coalesce("s.speaker", "s.speaker_id").alias("speaker"), F.coalesce("s.start", "s.start_sec").alias("start"), F.coalesce("s.end", "s.end_sec").alias("end"), F.col("s.text").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of text transcripts, a file each (``path``), as ``transcript_lines`` gives them."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\r?\\n")).alias("at", "line"))
    return transcript_lines(files.withColumn("at", F.col("at") + 1), "path", "at")


def write_trace(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.json(path)
