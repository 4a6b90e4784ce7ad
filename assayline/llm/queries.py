"""The queries of this subpackage, with production parameters, over whole tables; SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, license_scan, line_dedup, mixing, near_dedup, neighbours, personal_data, pieces, quality_classifier, quality_rules, suffix_dedup, survivorship, whitening
from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir), line_dedup.PRODUCTION)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply(docs, quality_rules.train(docs, documents(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.every_hundredth(documents(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, sf_dir)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(documents(spark, sf_dir, "embeddings"))


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden(documents(spark, sf_dir, "clients"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_pieces, op3_quality_rules, op4_quality_classifier, op5_suffix_dedup, op6_neighbours, op7_mixing, op8_license_scan, op9_personal_data, op10_jaccard_join, op11_near_dedup, op12_whitening, op13_golden_records)}
SQL: dict[str, str] = {"op7_mixing": mixing.SQL, "op10_jaccard_join": jaccard_join.SQL, "op11_near_dedup": near_dedup.SQL, "op13_golden_records": survivorship.SQL}
