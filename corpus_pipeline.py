"""A corpus pipeline of five operators; each stage's rows are written and reread as the next stage's documents.

Order: quality rules, line de-duplication, near-duplicates, mixing, byte-level BPE. All stages but the last return the
columns of ``documents``; the last returns token ids.

Defined cases: a null or blank text has no words, so the first stage rejects it; a null host is a host of its own; rows
without an id count nowhere and are never near-duplicates; rows that repeat a doc_id are one document, each with its own
fate; ties go to the smallest doc_id; very long texts pass whole; other columns pass all stages as they are, whatever their
names, save that the last replaces ``n_tokens``, ``ids`` and ``round_trip`` and drops the text and its length; an empty table gives
an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechgrain.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash
from speechgrain.llm.common import remove_folder, scratch, shared_folder, table


def _sized(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``out``; ``n_chars`` follows the text."""
    lengths = F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[lengths.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the lines that too many of their host's hold.

    The first holder of such a line keeps it, so that one of a large group of copies is left for the later stages.
    """
    return _sized(quality_rules.kept_documents(docs, keep_first=True), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _sized(line_dedup.dedup_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints within 2 bits, or 5-word shingles with a similarity of 0.8 or more."""
    return simhash.keep_first_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix makes over a document, in order of training position."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding, in place of the texts and their lengths; other columns stay."""
    import public_tokenizers

    return byte_bpe.encode_documents(docs.drop("n_chars"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: Fingerprints and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    *first, (_, last) = STAGES
    for k, (_, stage) in enumerate(first):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return last(spark, docs, sf_dir)
