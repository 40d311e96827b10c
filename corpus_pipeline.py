"""From raw documents to token ids: quality filter, line dedup, near-duplicate removal, mixing, encoding.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs, with
the columns of documents; the last one returns (doc_id, n_tokens, ids, ids_sha256, decoded_sha256). What a stage
returns comes in as many parts as its input's size needs, since a file is made of each (few_parts)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, line_dedup, mixing, near_dup, quality
from tracewell.llm._common import cut, table
from tracewell.plans.block import frame_bytes

#: A part stands for so many bytes of the stage's input as Spark knows its size, and there are so many for each core at least.
PART_BYTES = 4 << 20
PARTS_A_CORE = 2


def few_parts(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out in at most so many parts as go with the size of docs, small parts being read one after the other by one task.
    A file of each part makes Hadoop start processes from the executor's JVM (chmod) if the folder is a local one."""
    parts = max(PARTS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-frame_bytes(docs) // PART_BYTES))
    return out.coalesce(parts) if parts < 1 << 31 else out  # beyond that the size isn't known


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, doesn't reject."""
    return few_parts(quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels"))), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines that stay; n_chars is counted again."""
    return few_parts(line_dedup.with_kept_text(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id."""
    return few_parts(near_dup.one_of_each(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return few_parts(mixing.mixed_documents(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of these and of what they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    digests = coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return few_parts(digests, docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encode", encode),
]
#: The classifier and the similarity join can't be put in SQL; a test holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
