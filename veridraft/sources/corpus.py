"""Views of the lake that several operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small_or_plain, table

INTAKE = "field-intake"

def intake_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that are not yet segmented."""
    return table(spark, sf_dir, "source_document").where(F.col("source") == INTAKE).select("doc_id").distinct()


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``sentence`` outside the intake documents."""
    return table(spark, sf_dir, "sentence").join(small_or_plain(intake_ids(spark, sf_dir)), "doc_id", "left_anti")


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``sentence`` of the intake documents."""
    return table(spark, sf_dir, "sentence").join(small_or_plain(intake_ids(spark, sf_dir)), "doc_id", "left_semi")
