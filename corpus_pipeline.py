"""A training corpus from raw documents: quality rules, near-duplicates, personal data, mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import bpe, mixing, ngram_join, pii, quality
from lodeseek.llm.common import cut
from lodeseek.llm.queries import PII_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the isolation forest keep.

    A null text has no words, so it goes; repeated rows share a verdict and stay repeated.
    Without labels that match a document there is no forest, and the rules decide alone.
    """
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id, null last.

    Repeated rows and ties are one document, of which one row stays. Rows without words
    are no duplicates of anything and all stay.
    """
    return ngram_join.deduplicate(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars follows the text where it changed.

    Row by row: null texts stay null, repeated rows stay equal.
    """
    done = pii.pseudonymise(docs, PII_KEY, spans="pii_spans")
    return done.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources reads them.

    A null source is a source of its own, rows without words aren't in the mix, repeated
    rows are documents of their own, and ties are ordered by a hash of all columns.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the offsets that decode a part of it, decoded again as a check.

    A null text has no ids and decodes to no bytes; repeated rows are encoded each.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, decoded="decoded")
    exact = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", "id_ends", exact.alias("round_trip"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("personal data", hide_personal_data),
    ("source mix", mix_sources),
    ("byte-level BPE", tokens),
]

#: SQL can't express the forest, the pseudonyms or the merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if n < len(STAGES) - 1 else docs
    return docs
