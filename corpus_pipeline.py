"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemframe.llm import byte_bpe, exact_dedup, language, mixing, near_dedup
from stemframe.llm.common import table
from stemframe.storage import new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the model is learned from the documents themselves.

    Rejected: texts that are null, empty or without letters, and those in which no language has half of the mixture
    (for a text of one language: half of the posterior). Repeated rows and rows without an id share the verdict of
    their text; without a known language to learn from every row goes; an empty table stays empty; other columns,
    whatever their names, stay as they are.
    """
    return language.with_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    A null text equals an empty one; a row without an id stays only where its text has no row with one; of rows that
    repeat the winning id one stays; an empty table stays empty; other columns go along with their row.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Null and empty texts and rows without an id are similar to nothing and stay; rows that repeat an id are one
    document and stay or go together; an empty table stays empty; other columns stay as they are.
    """
    return near_dedup.without_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: a document comes as often as the mix takes it, or not at all.

    Texts without a word are never taken; a null source is a source of its own, the last one; repeated rows are
    documents of their own, in an order by a seeded hash of the id (ties by size); an empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digests of every document in the mix, with the round trip's; a null text has no tokens.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256; one row for each input row.
    """
    import public_tokenizers

    return byte_bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte BPE", encode)]

#: Language ID and near-duplicates are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
