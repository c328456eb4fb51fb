"""A corpus pipeline of five stages: each takes documents and gives documents, the last one gives packed pieces.

Toxic documents go; lines that occur earlier go; of each group of documents whose five-word shingles are alike by 0.8 or
more the smallest doc_id stays (found by SimHash at a measured recall, each link verified, see nearcopies.py); personal data gets pseudonyms; what is left is packed. A document that lost all its lines stays as an empty text until the
third stage, where all empty texts are one group. Stages with Python workers lower the session's rows per Arrow batch, and leave it so, as their
results are computed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import linededup, nearcopies, packing, pii, toxicity
from tidegauge.llm.common import settle, small_batches, table
from tidegauge.llm.queries import pii_key

#: Word shingles of the near-duplicate stage, and their Jaccard similarity from which documents are near copies.
SHINGLE, ALIKE = 5, 0.8


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars following the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _like(docs, linededup.remove_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return nearcopies.first_of_group(docs, SHINGLE, ALIKE)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, pii.pseudonymise(docs, pii_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("pii", pseudonymise),
    ("packing", pack),
]
#: Tokenising, automata and fingerprints have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
