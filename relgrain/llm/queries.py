"""Queries pN_... of the problems on texts, each over the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .encode import encode, vocabulary
from .mixing import mix, mix_report
from .truncation import truncated, truncation_by_source


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/mix_targets.parquet")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(_documents(spark, folder).select("doc_id", "text"), vocabulary())


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_documents(spark, folder), _targets(spark, folder), vocabulary())


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(_documents(spark, folder), _targets(spark, folder), vocabulary())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(_documents(spark, folder)).filter("truncated").select("doc_id")


def p8_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_by_source(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_by_source)}

#: None of these can be said in SQL: they are tested against another tokenizer, exact sums and made-up cuts.
SQL: dict[str, str] = {}
