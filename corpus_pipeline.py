"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents, extra ones included, whatever their names.

Defined results of all stages: null and empty texts count as texts without words, they are never rejected, linked, masked or
given tokens; very long texts are read whole; rows without doc_id take part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm import byte_bpe, minhash_dedup, mixing, personal_data, quality_classifier
from rulewright.llm.common import Scratch, bound_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Rows are judged one by one: repeated ones stay or go together, texts of
    fewer than four words stay."""
    return quality_classifier.keep_good(docs, Scratch(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id: five-word shingles, similarity 0.8.  Of
    repeated rows of a doc_id one stays; of a text that no row with an id has, one; blank texts of different ids all stay."""
    return minhash_dedup.deduplicate(docs, Scratch(spark))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; a row per row, repeated rows alike, null texts null.  Of spans that
    overlap the first gives the name."""
    return personal_data.mask(docs, Scratch(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice is there twice.  Rows of one doc_id, and those
    without, share a hash and are taken together; texts without words are taken as their hash says and weigh nothing."""
    return mixing.mix(docs, Scratch(spark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of their decoding: a row per row; no ids for null and empty texts."""
    import public_tokenizers

    bound_batches(spark, 500, 4 << 20)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixture", mixture), ("tokens", tokens)]

#: Trained weights, minima and recursive merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
