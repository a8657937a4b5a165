"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import decontaminate, infill, jaccard, language, lines, mixing, personal, pieces, quality, rules, runs, substrings, tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_docs(spark, sf_dir), keep_text=False).drop("kept_text")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal_data(_docs(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items", "spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_frequent_lines(_docs(spark, sf_dir), keep_text=False).drop("kept_text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("reasons", "n_lines", "n_exclaims")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("source")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_docs(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def with_repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by crc32 of doc_id, the words from one on repeat a short stretch."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words")
    g = F.expr("h div 10")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    words = F.concat(F.slice("words", F.lit(1), a), tail)
    return chosen.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeating_tails(_docs(spark, sf_dir)))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("first.shorter")
    return named.select("doc_id", "n_runs", F.col("first.start").alias("start"), length.alias("length"), F.col("first.period").alias("period"), F.floor(1000 * length / F.col("first.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_docs(spark, sf_dir))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def queries() -> dict:
    """Query by name, op1 to op13."""
    return {f.__name__: f for f in (op1_substring_dedup, op2_personal_data, op3_decontamination, op4_line_dedup, op5_language_id, op6_quality_rules, op7_quality_classifier, op8_source_mixing, op9_ngram_jaccard, op10_token_counts, op11_periodic_runs, op12_fill_in_middle, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    from turnloom.llm import oracles

    return oracles.oracle_sql()
