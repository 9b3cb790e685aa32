"""A training corpus from raw documents: language, near duplicates, benchmark copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents, extra ones of any name included. An empty table gives an empty result. Stages are separated by Parquet tables in the shared folder, so a lost executor repeats tasks
of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import decontamination, jaccard_join, language_id, packing, pii
from driftlens.llm.common import shorten_batches, stash, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose best two languages can't be told apart, go."""
    shorten_batches(spark)
    return language_id.drop_rejected(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of repeated rows one; documents without
    words link with nothing, and rows with a null id stay."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go; those with a null id or text stay."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; ``n_chars`` follows the text. No row goes; null texts stay null."""
    out = pii.with_surrogates(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048; null and empty texts are one piece of one id, repeated rows are packed each."""
    shorten_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: No SQL for language models of compressed bytes and tokenizers; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
