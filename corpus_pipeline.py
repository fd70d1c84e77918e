"""A training-corpus pipeline over the documents table: each stage is written as Parquet and read back as the next one's input."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.bpe import encode_texts
from codeloom.llm.common import remove, scratch, shared_dir, table
from codeloom.llm.decontam import clean_rows
from codeloom.llm.exact_dedup import kept_rows
from codeloom.llm.langid import in_known_language
from codeloom.llm.near_copies import without_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learnt language: null and empty texts, texts without letters, and strangers. All columns stay."""
    return in_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, of repeated rows one, rows without doc_id last. All columns stay."""
    return kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that five-word shingles of similarity 0.8 or more connect, the smallest doc_id stays; rows without doc_id stay."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that overlap with an item of the benchmark table; rows without doc_id are judged by their own texts. All columns stay."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the token ids of each row that is left, and hashes of them and of the decoded bytes."""
    return encode_texts(docs, with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL cannot express language models or byte-level BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in order. A stage's intermediate tables and its input go once its own rows are written."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        docs, last = spark.read.parquet(f"{folder}/{name}"), name
    return docs
