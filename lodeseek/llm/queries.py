"""The queries opN_<name> over the tables of a scale factor's folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of the pseudonyms; a deployment passes its own.
PII_KEY = "lodeseek"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by format-preserving pseudonyms."""
    from . import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"), "pii_spans", "source")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, found through a trigram index."""
    from . import secrets

    return secrets.digests(_table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of embeddings with a cosine of 0.9 or more."""
    from . import near_vectors

    return near_vectors.near_components(_table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted texts."""
    from . import chat

    return chat.digests(_table(spark, sf_dir, "conversations"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learnt from those that are not held out."""
    from . import bit_mixing

    return bit_mixing.score_documents(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all documents, by the ranks of a public vocabulary."""
    import public_tokenizers

    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document."""
    from . import mixing

    return mixing.digests(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with a shingle similarity of 0.75 or more."""
    from . import ngram_join

    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that start anywhere else."""
    from . import suffix_dedup

    done = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")  # a cut may fall inside a character
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, and which the rules and the forest keep."""
    from . import quality

    return quality.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    from . import prefix_trie

    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the leading components of their covariance, with unit variance.

    deviation is null where the exact value, in deviation_exact, is beyond a long.
    """
    from . import whitening

    done = whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("deviation", "deviation_exact")
    return done.select("vec_id", "component", "n", F.col("deviation_exact").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", "deviation_exact")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items, and which items those are."""
    from . import decontaminate

    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii_pseudonyms, op2_secret_scan, op3_near_vectors, op4_chat_format, op5_context_mixing, op6_byte_bpe, op7_source_mix, op8_ngram_jaccard, op9_suffix_dedup, op10_quality_forest, op11_prefix_trie, op12_whitening, op13_decontaminate]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import chat, decontaminate, prefix_trie, secrets

    return {"op2_secret_scan": secrets.oracle(), "op4_chat_format": chat.oracle(), "op11_prefix_trie": prefix_trie.oracle(), "op13_decontaminate": decontaminate.oracle()}
