"""The corpus pipeline over `documents`: language ID, exact dedup, near-dedup, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of `docs`. `run` writes each stage's result as a table in the shared folder and reads it
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe_automaton, exact_dedup, language_id, mixing, near_dedup
from sieveline.llm.common import stage, table


def without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """`docs` without the ids that `marked` (doc_id, kept) never keeps. A null id is never dropped."""
    dropped = marked.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(stage(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID (operator 2) accepts; `lang` stays as it was."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 8)."""
    return without(docs, exact_dedup.groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4)."""
    return without(docs, near_dedup.groups(docs, by="shingles"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by their weights (operator 6), as documents; one that is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document (operator 5)."""
    ids = bpe_automaton.encode(docs, bpe_automaton.default_tokenizer())
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", tokenize),
]

#: Language ID learns its centroids, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over all of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
