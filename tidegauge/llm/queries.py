"""Queries p7 to p9 over the synthetic tables; SQL expresses none of them but the corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import leaks, subjects, tokens
from tidegauge.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), "doc_id", "text", tokens.load_vocabulary("byte_bpe_50k"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(
        table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")
    )


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    found = p9_found(spark, d)
    areas = table(spark, d, "subject_areas").select("subject")
    counted = found.groupBy("subject").agg(F.count("*").alias("documents"))
    return areas.join(counted, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_ids, p8_found, p9_found, p9_composition)}


def oracle_sql() -> dict:
    return {}
