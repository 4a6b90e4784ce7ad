"""From raw documents to training tokens, in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import jaccard_join, line_dedup, mixing, pieces, quality_classifier
from assayline.llm.common import documents
from assayline.storage import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    return quality_classifier.accepted(docs, documents(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier one; those left without a word go."""
    return line_dedup.deduplicated(docs, line_dedup.PRODUCTION)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return jaccard_join.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    import public_tokenizers

    return pieces.tokenised(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", distinct_lines),
    ("jaccard_join", distinct_documents),
    ("mixing", mixed),
    ("pieces", tokens),
]

#: Learnt weights, MinHash and subword merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
