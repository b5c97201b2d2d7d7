"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and
mixing, each stage over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the
last one adds size, target and copies: how often the mix has the document. Its
result is written to the shared folder and read again as the next one's docs.
Nulls: a text that is null goes in the first stage; a null id or source stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, langid, linededup, mixing, neardup
from loomgraph.scratch import table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those whose calibrated score is too low."""
    return langid.identify(docs, langid.fit(docs)).where("not rejected").select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8; the least id of each component stays.
    Rows that share an id go or stay by their own texts; repeated rows stay or go together."""
    copies = neardup.near_duplicates(docs, width=5, percent=80, carry={"__hash": F.xxhash64("text")}).where("not kept")
    copies = table(copies.select(F.col("doc_id").alias("__copy"), "__hash").distinct(), "copies")
    return docs.join(copies, (docs["doc_id"] == copies["__copy"]) & (F.xxhash64(docs["text"]) == copies["__hash"]), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("copies > 0").select(*docs.columns, "size", "target", "copies")


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_shared_lines),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("mix", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
