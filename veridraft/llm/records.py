"""Queries of cross-split overlaps, grouped splits and near-duplicates: p1, p5 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, spread, table
from ..sources.corpus import segmented
from .crosssplit import CrossSplitOverlap
from .grouping import GroupedSplit, document_groups
from .neardup import NearDuplicates

REALMS = ("sentence", "rewrite_pairs")


def _p1(spark: SparkSession, d: str) -> CrossSplitOverlap:
    split = table(spark, d, "classifier_split").select("sentence_id", F.lower(F.trim("split_name")).alias("split"))
    sentences = spread(segmented(spark, d).select("sentence_id", "doc_id", "text")).join(split, "sentence_id").dropDuplicates(["sentence_id"])
    pairs = spread(table(spark, d, "rewrite_pairs").select("pair_id", "source", "source_text", "split_name"))
    return CrossSplitOverlap(
        sentences.select(F.lit(0).alias("realm"), F.col("sentence_id").alias("rid"), "split", F.col("doc_id").alias("source"), "text").unionByName(
            pairs.select(F.lit(1).alias("realm"), F.col("pair_id").cast("string").alias("rid"), F.lower(F.trim("split_name")).alias("split"), "source", F.col("source_text").alias("text"))
        )
    )


def _realm():
    return F.when(F.col("realm") == 0, REALMS[0]).otherwise(REALMS[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).concerned().select(_realm().alias("rec_table"), F.col("rid").alias("rec_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out records with an overlap, and their mean coverage, per table, split and source; a sentence of several sources counts in each."""
    found = cut(_p1(spark, d).concerned())
    names = table(spark, d, "source_document").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.lower(F.trim("source"))).alias("named"))
    # A sentence stands in every source that has a document with it.
    stands = segmented(spark, d).select(F.col("sentence_id").alias("rid"), "doc_id").join(found.where("realm = 0").select("rid").distinct(), "rid", "left_semi").distinct()
    named = stands.join(names, "doc_id", "left").select("rid", F.col("named").alias("source")).distinct()
    sentences = found.where("realm = 0").drop("source").join(named, "rid")
    return (
        sentences.unionByName(found.where("realm = 1"))
        .groupBy(_realm().alias("rec_table"), "split", "source")
        .agg(F.countDistinct("rid").alias("records"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = document_groups(table(spark, d, "sentence"), "sentence_id", "doc_id")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("group_key"))


def _known_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of rules the taxonomy has (28 rows, fixed): unknown ids would only grow the number of labels to balance."""
    return table(spark, d, "sentence_trope_label").select("sentence_id", "trope_id").join(F.broadcast(table(spark, d, "trope").select("trope_id")), "trope_id", "left_semi")


def _p5(spark: SparkSession, d: str) -> GroupedSplit:
    return GroupedSplit(table(spark, d, "sentence"), _known_labels(spark, d), table(spark, d, "split_plan"))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).assignment()


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each split and their share beside the wanted one: of all (trope_id null) and of those with each label."""
    rows = cut(_p5(spark, d).assignment().select("sentence_id", "split_name").distinct())
    labelled = rows.join(_known_labels(spark, d).distinct(), "sentence_id").select("sentence_id", "split_name", "trope_id")
    every = rows.select("sentence_id", "split_name", F.lit(None).cast("string").alias("trope_id")).unionByName(labelled)
    counts = every.groupBy("trope_id", "split_name").agg(F.count(F.lit(1)).alias("sentences"))  # at most 29 x splits rows
    of_label = Window.partitionBy("trope_id")
    return (
        counts.withColumn("share", F.round(F.col("sentences") / F.sum("sentences").over(of_label), 4))
        .join(F.broadcast(table(spark, d, "split_plan")), "split_name")
        .select("trope_id", "split_name", "sentences", "share", "target_share")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = NearDuplicates(segmented(spark, d), "text", "sentence_id", "doc_id").row_pairs()
    return found.select(F.col("id_a").alias("sentence_id_a"), F.col("id_b").alias("sentence_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    found = NearDuplicates(segmented(spark, d), "text", "sentence_id", "doc_id").groups()
    return found.select(F.col("rid").alias("sentence_id"), F.col("owner").alias("doc_id"), "class_id", "links", "group_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p5_found, p5_assignment, p5_shares, p7_found, p7_groups)}

ORACLES: dict[str, str] = {
    "p5_found": """
WITH RECURSIVE m AS (SELECT DISTINCT sentence_id, doc_id FROM sentence WHERE sentence_id IS NOT NULL AND doc_id IS NOT NULL),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM m x JOIN m y ON x.sentence_id = y.sentence_id AND x.doc_id <> y.doc_id),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, least(a, min(b)) AS group_key FROM r GROUP BY a
""",
}
