"""A corpus from raw documents to packed training windows, in five stages.

Toxic documents go; of equal texts one row stays, of near copies (five-word shingles, similarity 0.8 or
more) one document; sources are mixed to their target weights, a document taken twice being two rows; all
that is left is packed into windows of 1,024 tokens. Every stage works on what its predecessor kept and
returns the columns of documents, whatever else they are called; the last returns the pieces of the windows,
in which `row` tells the copies of a document apart.

Defined results, stage by stage: a null or empty text is clean, equal to all other empty texts, near to
none, and of size 0, so that mixing never takes it. Rows without doc_id are judged by their texts like any
other; among equals they give way to a row with an id. Rows that repeat doc_id and text are one after exact
deduplication; rows that repeat doc_id with different texts are documents of their own throughout. A null
source is a source of its own. Without labels of both classes nothing is toxic unless all labels are. An
empty table stays empty.

SQL can't express the trained classifier, hashing or differencing, so there is no ORACLE_SQL; the stages
are tested against brute force on small tables, and the whole on empty, null and clashing ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm.exactdedup import without_duplicates
from gridweave.llm.minhash import without_near_duplicates
from gridweave.llm.mixing import mixed
from gridweave.llm.packing import pack
from gridweave.llm.runtime import settle, table
from gridweave.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below the threshold, by a machine trained on the labels."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one of smallest doc_id."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id."""
    return without_near_duplicates(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to two times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows: document, row, range of tokens, window and offset."""
    return pack(docs, capacity=1024, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
