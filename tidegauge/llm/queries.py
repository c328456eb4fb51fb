"""Queries over the corpus tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import automaton, bitplanes, bpe, crosspolytope, impact, linededup, packing, pii, prefixtrie, rlbwt, simhash, toxicity, variants
from tidegauge.llm.common import shared_path, table


#: The setting that names the file with the key of the pseudonyms, and the public key of the examples, used where it is unset.
KEY_FILE, EXAMPLE_KEY = "spark.tidegauge.pii.keyFile", "tidegauge example key"


def pii_key(spark: SparkSession) -> str | Column:
    path = spark.conf.get(KEY_FILE, None)
    return pii.key_file(spark, path) if path else EXAMPLE_KEY


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), count_col="n_replaced")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_lines(docs)


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rlbwt.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = automaton.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "ids")
    bitplanes.write_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return bitplanes.digests(bitplanes.read_ids(spark, path))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_feistel_pseudonyms, op2_byte_bpe, op3_line_dedup, op4_impact_topk, op5_cross_polytope, op6_run_length_dedup, op7_simhash,
            op8_best_fit_packing, op9_toxicity, op10_automaton_dedup, op11_spelling_variants, op12_bit_planes,
            op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {}
