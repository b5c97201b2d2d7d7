"""The opN queries: each applies its operator to a whole table and derives the
columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import chat

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = chat.read_back(chat.format_windows(turns.unionByName(own)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("targets").cast("long").alias("loss_chars"), F.sha2("targets", 256).alias("loss_sha256"), "formatted_chars")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import quality

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, _read(spark, sf_dir, "labels").where(~held_out))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import langid

    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import fingerprints

    return fingerprints.fingerprint_pairs(_read(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import decontam

    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from loomgraph.llm import tokens

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import mixing

    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import linededup

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import licenses

    return licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm import neardup

    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_quality, op3_language, op4_fingerprints, op5_benchmark_leaks, op6_token_counts, op7_source_mix, op8_line_dedup, op9_license_scan, op10_near_duplicates)}
