"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's rows as
Parquet in the shared folder, reads them again for the next and then removes what the stage before wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bpe, decontaminate, language, lines, simhash
from graphloom.llm.common import new_folder, remove, table
from graphloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; the model is learnt from these documents."""
    return language.recognised(docs, language.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many documents share; n_chars follows the text."""
    rows, (_, n_dropped) = lines.drop_repeated_lines(docs), lines.counts_of(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: The first stage is a learned model, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, done = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), False
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
        done = True
    finally:
        if not done:
            remove(spark, folder)
    return docs
