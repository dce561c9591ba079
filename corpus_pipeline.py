"""From documents to packed windows: toxic texts go, repeated lines go, one text of each near-duplicate group stays, PII is replaced, what is left is packed.

Each stage works on all that its predecessor kept, and its decisions take effect. Defined results of all stages: null texts and
empty ones pass through as they are (the toxicity model scores them like a text without words) until packing, where they take no
place; rows without a doc_id are judged by their text alone, are no duplicates of others, and are packed; repeated rows are
judged alike, and rows that share a doc_id stay or go together in near-dedup; a text all of whose lines go becomes empty and its
row stays; ties keep the smallest doc_id; an empty table gives an empty table; columns that documents has besides doc_id and text
pass through all stages but the last (n_chars follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import lines, packing, pii, simhash, toxicity
from quirefold.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that a model fitted to the labels doesn't reject; without labels of both classes all rows."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that an earlier line equals, or is within one word of."""
    return lines.drop_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest doc_id of each near-duplicate group, and of all documents in no group."""
    return simhash.keep_one(docs)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, entities in their texts replaced under the session's key."""
    return pii.replace_all(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """window_id, slot, doc_id, start, tokens of every text that has tokens."""
    return packing.pack(packing.bpe_counts(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("pii", with_surrogates),
    ("packing", packed_windows),
]
# Trees, signatures, keyed permutations and least squares aren't SQL; a test holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
