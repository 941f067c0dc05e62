"""A pipeline over the documents: language, near duplicates, benchmark passages, personal data, tokens.

Each stage gets what its predecessor kept, written as Parquet and read again.  All but the last return the columns of their
input.  What the stages decide: documents that no learned language's prototype is like go; of a group of near duplicates
(five-word shingles, 0.8) the smallest id stays; documents with a benchmark passage go; personal data and secrets in the texts
are replaced by their kind in brackets, and n_chars follows; the last stage returns each document's token ids and the digests
of ids and decoded text.  A stage's table is removed once the next one is written, the last when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.llm import bpe, decontam, langid, neardup, pii
from rulesieve.llm.common import dropped, shared_dir, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.stage(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.stage(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
#: Models, automata and tokens can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), folder, f"{k}_{name}")
        if k:
            dropped(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
