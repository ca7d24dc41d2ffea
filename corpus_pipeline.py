"""A corpus from raw documents to token ids: language, near copies, benchmark leaks, source mix, token file.

Every stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next stage's ``docs``. Extra columns of any name are carried
through all stages but the last. An empty table stays empty. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import codes, decontam, jaccard, langid, mixing, queries, simhash
from scoreloom.llm.common import free_name
from scoreloom.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, texts without letters, and texts far from every language, go. Repeated rows stay."""
    name = free_name(docs, "language")
    found = langid.with_language(docs, queries.language_model(docs), name=name)
    return found.filter(~F.col(name).getField("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingle sets of Jaccard similarity 0.8 or more.

    Candidates come from SimHash components, and from MinHash bands for pairs beyond the radius; each is verified on the sets.
    The one with the smallest id stays, null last, then the smallest text hash; different texts under one id are documents of their own, of
    fully repeated rows one stays. Texts without words are one group.
    """
    return simhash.keep_one(docs, find=jaccard.near_duplicates)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are alike."""
    name = free_name(docs, "leaks")
    found = decontam.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.filter(F.size(name) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source weights ask for. Texts without words are taken zero times; a null source is a source of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of what is left, read back: place, length and checksum of every document, in ascending order of ids, null first."""
    path = scratch_path(spark, "corpus-tokens")
    codes.write_tokens(docs, path, queries.token_encoder())
    return codes.read_tokens(spark, path)


STAGES = [
    ("language", language), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mix", mix), ("tokens", tokens),
]

#: Stages 1, 2, 4 and 5 (k-means, SimHash and MinHash, random rounding, a tokenizer) cannot be written in SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
