"""A text index of sessions that is kept up to date session by session.

The index is a set of Parquet tables, one folder for each bucket of sessions, and a manifest that names the folder of each
bucket. A change writes new folders for the buckets that hold changed sessions and then publishes a new manifest by one
rename, so readers see all of a change or nothing of it, and one who has opened the index keeps reading that version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.numbers import quantized
from turnloom.operators import reports, retrieval
from turnloom.operators import vectors as V

ROW = "session_id long, ordinal long, chunk_id string, title string, speaker string, text string, content_hash string, revision_id string, identity string, embedding array<double>, version int, reused boolean"
COLUMNS = tuple(c.split(" ")[0] for c in ROW.split(", "))


def scratch_index(spark: SparkSession, name: str) -> str:
    """A new folder for an index in the folder that all executors share; it goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _written(df: DataFrame) -> DataFrame:
    """The same rows from a table in a scratch folder, so that they are made once; as they are if no folder is shared."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df
    df.write.parquet(path := f"{scratch_index(spark, 'search')}/rows")
    return spark.read.schema(df.schema).parquet(path)


class SessionIndex:
    """Chunks of sessions with their hashes and vectors, for one writer at a time and any number of readers.

    ``identity`` names how vectors are made; chunks of another identity are made again when their session is written next
    and are not searched before.
    """

    def __init__(self, spark: SparkSession, path: str, identity: str = "hashed-64", buckets: int = 16):
        self.spark, self.path, self.identity, self.buckets = spark, path.rstrip("/"), identity, buckets
        self.version, self.folders = self._opened()

    def _opened(self) -> tuple[int, dict[str, str]]:
        """Number and folders of the newest published version."""
        fs, p = _at(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        newest = max((int(n.removesuffix(".json").rpartition("-")[2]) for n in names if n.startswith("manifest-")), default=0)
        if not newest:
            return 0, {}
        return newest, json.loads(self.spark.read.text(f"{self.path}/manifest-{newest}.json", wholetext=True).first()[0])

    def snapshot(self) -> SessionIndex:
        """The index as it is now, for a reader."""
        return SessionIndex(self.spark, self.path, self.identity, self.buckets)

    def chunks(self) -> DataFrame:
        """All chunks of this version."""
        return self._read(self.folders.values())

    def _read(self, folders) -> DataFrame:
        paths = sorted(folders)
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def _bucket(self):
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")

    def _publish(self, rows: DataFrame, touched: list[int]) -> None:
        """Write the rows of the touched buckets and publish the version that has them; nothing else changes."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
        fs, p = _at(self.spark, f"{self.path}/{name}")
        found = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in self.folders.items() if int(b) not in touched} | {b: f"{self.path}/{name}/bucket={b}" for b in found}
        fs, aside = _at(self.spark, f"{self.path}/aside-{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not fs.rename(aside, _at(self.spark, f"{self.path}/manifest-{self.version + 1}.json")[1]):
            raise OSError(f"could not publish version {self.version + 1}")
        self.version, self.folders = self.version + 1, folders

    def _touched(self, sessions: DataFrame) -> list[int]:
        """Buckets, ``self.buckets`` at most, of the sessions."""
        return [r[0] for r in sessions.select(self._bucket().alias("b")).distinct().collect()]

    def _kept(self, touched: list[int], gone: DataFrame) -> DataFrame:
        rows = self._read(f for b, f in self.folders.items() if int(b) in touched)
        return rows.join(gone.select("session_id"), "session_id", "left_anti")

    def upsert(self, chunks: DataFrame) -> None:
        """Write the sessions of ``chunks`` (session_id, ordinal, title, speaker, text), each with all its chunks.

        A session with the same chunks and identity as before is skipped; of a changed one the vectors of chunks with the
        same content are kept, and chunks that it no longer has go. Rows without a session or an ordinal don't count. If
        nothing has changed, no version is published.
        """
        new = chunks.filter("session_id IS NOT NULL AND ordinal IS NOT NULL").select(F.col("session_id").cast("long").alias("session_id"), F.col("ordinal").cast("long").alias("ordinal"), "title", "speaker", "text")
        value = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c), F.lit("~")) for c in ("title", "speaker", "text")))
        new = new.withColumn("content_hash", F.substring(F.sha2(value, 256), 1, 24))
        revision = reports.ordered_sha256(new, "session_id", "ordinal", "content_hash").select("session_id", F.substring("digest", 1, 32).alias("revision_id"))
        old = self.chunks()
        same = old.select("session_id", "revision_id", "identity").distinct().filter(F.col("identity") == self.identity)
        changed = revision.join(same, ["session_id", "revision_id"], "left_anti")
        touched = self._touched(changed)
        if not touched:
            return
        known = old.filter(F.col("identity") == self.identity).select("session_id", "ordinal", "content_hash", F.col("embedding").alias("_old"))
        rows = new.join(changed, "session_id").join(known, ["session_id", "ordinal", "content_hash"], "left")
        rows = rows.withColumns({"chunk_id": F.concat_ws("#", "session_id", "ordinal"), "reused": F.col("_old").isNotNull()})
        fresh = retrieval.hashed_vectors(rows.filter("NOT reused").select("chunk_id", T.unicode_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), "chunk_id", "tokens")
        zeros = F.array_repeat(F.lit(0.0), retrieval.DIMENSIONS)
        rows = rows.join(fresh, "chunk_id", "left").withColumns({"embedding": F.coalesce("_old", "embedding", zeros), "identity": F.lit(self.identity), "version": F.lit(self.version + 1)})
        self._publish(self._kept(touched, changed).select(*COLUMNS).unionByName(rows.select(*COLUMNS)), touched)

    def delete(self, sessions: DataFrame) -> None:
        """Take out the sessions of ``sessions`` (session_id); those that are not there don't matter."""
        gone = self.chunks().select("session_id").join(sessions.select("session_id"), "session_id", "left_semi").distinct()
        touched = self._touched(gone)
        if touched:
            self._publish(self._kept(touched, gone), touched)

    def state(self, sessions: DataFrame) -> DataFrame:
        """(session_id, indexed, revision_id, chunks, current, dimensions) of each asked session; ``current``: of this identity."""
        held = self.chunks().groupBy("session_id").agg(F.first("revision_id").alias("revision_id"), F.count(F.lit(1)).alias("chunks"), F.min(F.col("identity") == self.identity).alias("current"), F.max(F.size("embedding")).alias("dimensions"))
        out = sessions.select("session_id").filter("session_id IS NOT NULL").distinct().join(held, "session_id", "left")
        return out.select("session_id", F.col("chunks").isNotNull().alias("indexed"), F.coalesce("revision_id", F.lit("")).alias("revision_id"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("current", F.lit(False)).alias("current"), F.coalesce("dimensions", F.lit(0)).alias("dimensions"))

    def search(self, sessions: DataFrame, questions: DataFrame, k: int = 30) -> DataFrame:
        """(query, chunk_id, score): the k best chunks of the sessions for each question (query, text): ranks by vectors and by
        words are fused; a speaker's name or a title in the question adds points. Ties go by chunk_id."""
        body = self.chunks().filter(F.col("identity") == self.identity).join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        words = body.select("chunk_id", T.unicode_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
        asked = questions.select("query", "text", T.unicode_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
        lexical = retrieval.bm25_top(words, "chunk_id", "tokens", asked, "query", "tokens", 30)
        vectors = retrieval.hashed_vectors(asked, "query", "tokens").select(F.concat(F.lit("?"), F.col("query").cast("string")).alias("query"), "embedding")
        near = V.nearest(vectors, body.select("chunk_id", "embedding"), 30, "query", "chunk_id", digits=6)
        near = near.select(F.expr("substring(query, 2)").cast(questions.schema["query"].dataType).alias("query"), F.col("match").alias("chunk_id"), "place")
        lists = _written(near.withColumn("near", F.lit(True)).unionByName(lexical.select("query", "chunk_id", "place", F.lit(False).alias("near"))))
        named = {c: _written(retrieval.named_titles(asked, body.select(F.col(c).alias("title")), n)) for c, n in (("title", 4), ("speaker", 3))}
        bonus = retrieval.title_bonuses(named, body, "chunk_id", lists, k)
        scored = retrieval.fused(lists.filter("near"), lists.filter("NOT near"), "chunk_id", bonus=bonus)
        return retrieval.top(scored.withColumn("score", quantized(F.col("score"), 9)), k, "chunk_id").select("query", "chunk_id", "score")


def listed_sessions(sessions: DataFrame, show: str = "active", query: str = "") -> DataFrame:
    """Sessions (title, created_at, updated_at, speaker_names, archived, ...) that are active, archived or all, in which every
    word of the query occurs in the title, the dates or a speaker's name, newest first, then by title."""
    if show not in ("active", "archived"):
        show = "all"
    archived = F.coalesce("archived", F.lit(False))
    out = sessions if show == "all" else sessions.filter(archived if show == "archived" else ~archived)
    place = F.lower(F.concat_ws(" ", "title", F.col("created_at").cast("string"), F.col("updated_at").cast("string"), F.array_join("speaker_names", " ")))
    for word in query.lower().split():
        out = out.filter(F.contains(place, F.lit(word)))
    return out.orderBy(F.desc(F.coalesce("updated_at", "created_at")), "title")
