"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` stores it as Parquet and gives it to the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotquery.llm.common import prepare, stored, table
from lotquery.llm.decontam import remove_contamination
from lotquery.llm.langid import UNKNOWN, label_languages
from lotquery.llm.mixing import mix_sources
from lotquery.llm.near_dedup import drop_near_duplicates
from lotquery.llm.token_output import token_output

TOKENIZER = "byte_bpe_50k.json"
#: A document goes if less than this share of its words look like the labelled texts' words.
LEAST_KNOWN = 0.6
#: Percent of the five-word shingles of two documents that near copies share.
SIMILARITY = 80

#: Token ids and bytes of context mixing aren't SQL; tests/llm holds the run
#: against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the labels know, go."""
    prepare(spark)
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_known") >= LEAST_KNOWN)
    return label_languages(docs).filter(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id."""
    prepare(spark)
    return drop_near_duplicates(docs, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that hold nothing else go."""
    prepare(spark)
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once at least, those of
    small sources again as far as the repetition limit goes."""
    prepare(spark)
    return mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as coded blocks, and read back."""
    prepare(spark)
    return token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
