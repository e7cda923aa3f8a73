"""Training-data pipeline over ``documents``: each stage takes what the one before kept, as a table.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.

In every stage a null text counts as empty and a null source as a source of its own; rows
without a doc_id are rows like others, whom no near-duplicate class and no label names; repeated rows
are scored alike, one of them outlasts exact deduplication; whole texts are read, however long;
ties go to the smaller doc_id; an empty table passes as one; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offergrid.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from offergrid.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go; it learns from the labelled rows of these documents."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_dedup.keep_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's budget takes them, whole."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and the digests of a round trip."""
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can express neither the learned scorer nor the signatures; a test holds run() against plain Python, but for the scorer's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
