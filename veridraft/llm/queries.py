"""Queries of the text-pipeline operators, and the SQL to hold against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, spread, table
from ..sources.corpus import intake, segmented
from . import bpe, conduct, lookalike, mixing, pairs, records, repetition, sentences


def _records(spark: SparkSession, d: str) -> DataFrame:
    a = spread(segmented(spark, d)).select(F.lit("sentence").alias("rec_table"), F.col("sentence_id").alias("rec_id"), "text")
    b = spread(table(spark, d, "sentence_rewrite")).select(F.lit("sentence_rewrite").alias("rec_table"), F.col("rewrite_id").alias("rec_id"), F.col("rewritten_text").alias("text"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_form_pairs(cut(lookalike.form_keys(_records(spark, d))))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text that is not null."""
    rows = _records(spark, d).where("text is not null and rec_id is not null")
    return lookalike.consistent_forms(rows).select("rec_table", "rec_id", "form").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(spread(table(spark, d, "rewrite_pairs").select("pair_id", "source_text", "target_text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(spread(intake(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(spread(segmented(spark, d))).select("doc_id")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Repeated share and probability of repetition of every document."""
    return repetition.judged(spread(segmented(spark, d))).select("doc_id", "n_words", F.round("share", 6).alias("share"), F.round("probability", 6).alias("probability"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents, their size in tokens and how often each is used."""
    return _mixture(spark, d).rows


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def _conduct(spark: SparkSession, d: str) -> DataFrame:
    return conduct.scored(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "review_label"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return conduct.found(_conduct(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _conduct(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in conduct.CATEGORIES])


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return conduct.rates(_conduct(spark, d))


QUERIES = records.QUERIES | {f.__name__: f for f in (p2_found, p2_forms, p3_found, p4_found, p6_found, p6_shares, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

ORACLES: dict[str, str] = {**records.ORACLES}
