"""The corpus pipeline: whole documents through five operators of ``claimlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of ``documents``; what a stage drops or rewrites is gone for
the stages after it.

The language model of the first stage learns from all labelled rows it is given,
also those that the query of operator 9 holds out: nothing is measured here.

Defined results: a text that is null or has no letter has no known language and
goes in the first stage; after it, a null or empty text would stay and have no
tokens; rows with a null id stay, each; rows that repeat an id are judged by
their texts, equal ones once; without labelled languages nothing is known and
nothing stays; an empty table gives no rows; an empty benchmark removes none.
Extra columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import byte_bpe, decontamination, language_id, ngram_join, secret_scan
from claimlens.llm.scratch import written


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (operator 9); rejected ones go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def join_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (operator 1): the one of the smallest id."""
    return ngram_join.keep_one(docs)


def remove_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (operator 3)."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced (operator 8), and counted anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 2), decoded again to prove the round trip."""
    m = byte_bpe.default_model(spark)
    return byte_bpe.encode(docs, m, ("doc_id", "lang", "source", "text"), decoded=True).select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("tokens", encode_tokens),
]

#: SQL can't express the trained stages and BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
