"""The thin queries of the operators, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, language, minhash, mixing, pieces, quality, suffixes, toxicity, vectors, warc
from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]


#: The edge cases (nulls, empty and long texts, ties, repeated rows, empty tables, other columns) are stated by the
#: operators that the queries call.
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: its record, read back from the archives through the merged index."""
    return warc.warc_query(table(spark, sf_dir, "pages"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the base counts and the verdict."""
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a vector: its links and the component they reach."""
    return vectors.vector_links(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the size of its set and its component."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the words that the mix takes of it."""
    return mixing.mix_query(table(spark, sf_dir, "documents"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its base and model scores."""
    return language.language_scores(table(spark, sf_dir, "documents"))


def op7_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: the digests of its ids and of the decoded text."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), pieces.default_model())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its score, learned without the held-out labels."""
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: what repeats in it and the digest of the rest."""
    return suffixes.dedup_digests(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation: digests read back from the formatted text."""
    return chat.chat_query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_warc_index, op2_quality_outliers, op3_vector_links, op4_minhash, op5_source_mix, op6_context_mixing, op7_piece_codes, op8_toxicity, op9_suffix_dedup, op10_chat_format)}

ORACLES: dict[str, str] = {
    "op1_warc_index": warc.WARC_SQL,
    "op3_vector_links": vectors.LINKS_SQL,
    "op4_minhash": minhash.NEAR_SQL,
    "op5_source_mix": mixing.MIX_SQL,
    "op9_suffix_dedup": suffixes.REPEATS_SQL,
    "op10_chat_format": chat.CHAT_SQL,
}
