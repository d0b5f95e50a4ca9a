"""Streams of documents: every detector works within a row, so a stream needs no state for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import sha256_hex
from ..operators.detect import detected
from ..operators.patterns import GATE
from ..operators.segment import sentences
from ..schema import DOCUMENT


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).parquet(path)


def finding_stream(docs: DataFrame, dialect: str = "re2") -> DataFrame:
    return detected(sentences(docs), names=GATE, dialect=dialect)


def unseen_texts(docs: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Texts whose content has not come within the delay."""
    keyed = docs.withColumn("sha256", sha256_hex(F.col("text")))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"])
