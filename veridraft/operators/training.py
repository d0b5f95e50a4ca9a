"""Training tables: ingestion, label pivot, stratified split, rewrite pairs, sampling, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import NS_DOCUMENT, NS_SENTENCE, NS_SYNTHETIC_DOCUMENT, NS_SYNTHETIC_REWRITE, NS_SYNTHETIC_SENTENCE, sha256_hex, uuid5
from ..functions.text import strip
from ..runtime import cut
from ..sources.lake import write_table
from .ranking import first_rows, hex_bucket, ranked
from .segment import sentences


def ingest(raw: DataFrame, fetched_at: str, namespace: str = NS_DOCUMENT, sentence_namespace: str = NS_SENTENCE, split: bool = True, stripped: bool = True, synthetic: bool = False):
    """raw: text, source, url, is_ai_generated. Returns (source_document, sentence); equal texts once, blank ones never."""
    text = strip(F.col("text")) if stripped else F.col("text")
    docs = raw.withColumn("text", F.coalesce(text, F.lit(""))).where(F.col("text") != "").withColumn("sha256", sha256_hex(F.col("text"))).dropDuplicates(["sha256"])
    docs = docs.withColumn("doc_id", uuid5(namespace, F.col("sha256")))
    source = docs.select("doc_id", "source", "url", "sha256", F.lit(fetched_at).alias("fetched_at"), "is_ai_generated", F.lit(synthetic).alias("is_synthetic"))
    if split:
        parts = sentences(docs)
    else:
        parts = docs.select("doc_id", F.lit(0).alias("ordinal"), "text", F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    keyed = parts.withColumn("sentence_id", uuid5(sentence_namespace, F.concat_ws(":", "doc_id", F.col("ordinal").cast("string"))))
    return source, keyed.select("sentence_id", "doc_id", "ordinal", "char_start", "char_end", "text")


def ingest_pairs(pairs: DataFrame, trope: DataFrame, fetched_at: str, split: bool = True, label_source: str = "synthetic-gen"):
    """pairs: name, positive, rewrite. Returns (source_document, sentence, label, rewrite, unmatched names).

    Each sentence of a positive text is labelled; its first sentence gets the rewrite. With split
    the rewrite is a document too; without, whole texts are single sentences.
    """
    namespace, sentence_namespace = (NS_SYNTHETIC_DOCUMENT, NS_SYNTHETIC_SENTENCE) if split else (NS_DOCUMENT, NS_SENTENCE)
    known = pairs.join(F.broadcast(trope.select("trope_id", "name")), "name", "left")
    unmatched = known.where("trope_id is null").select("name").distinct()
    known = known.where("trope_id is not null")
    as_docs = lambda c, ai: known.select(F.col(c).alias("text"), F.lit("synthetic" if split else "ste-synth").alias("source"), F.lit(None).cast("string").alias("url"), F.lit(ai).alias("is_ai_generated"))
    raw = as_docs("positive", True).unionByName(as_docs("rewrite", False)) if split else as_docs("positive", True)
    source, sentence = ingest(raw, fetched_at, namespace, sentence_namespace, split, stripped=split, synthetic=True)
    body = strip(F.col("positive")) if split else F.col("positive")
    owner = known.withColumn("doc_id", uuid5(namespace, sha256_hex(body))).select("doc_id", "trope_id", "rewrite")
    labelled = sentence.join(owner, "doc_id")
    label = labelled.select("sentence_id", "trope_id", F.lit(label_source).alias("label_source"), F.lit(1.0).cast("float").alias("confidence")).distinct()
    rewrite = labelled.where("ordinal = 0").select(
        uuid5(NS_SYNTHETIC_REWRITE, F.col("sentence_id")).alias("rewrite_id"), "sentence_id", "trope_id", F.col("rewrite").alias("rewritten_text"), F.lit(label_source).alias("source")
    ).distinct()
    return source, sentence, label, rewrite, unmatched


def best_labels(label: DataFrame) -> DataFrame:
    """sentence_id, trope_id, confidence: the highest of each."""
    return label.groupBy("sentence_id", "trope_id").agg(F.max("confidence").alias("confidence"))


def wide_labels(sentence: DataFrame, label: DataFrame, trope: DataFrame, names: list, at_least: float = 0.5) -> DataFrame:
    """sentence_id, text and a boolean ``trope__<name>`` for each name; unknown labels and sentences do not count."""
    named = best_labels(label).join(F.broadcast(trope.select("trope_id", "name")), "trope_id")
    pivot = named.groupBy("sentence_id").pivot("name", names).agg(F.max("confidence"))
    one = sentence.select("sentence_id", "text").dropDuplicates(["sentence_id"])
    flag = lambda n: F.coalesce(F.col(f"`{n}`") >= at_least, F.lit(False)).alias(f"trope__{n}")
    return one.join(pivot, "sentence_id", "left").select("sentence_id", "text", *[flag(n) for n in names])


def first_label(names: list) -> Column:
    """Name of the first true label in taxonomy order, else 'none'."""
    return F.coalesce(*[F.when(F.col(f"`trope__{n}`"), F.lit(n)) for n in names], F.lit("none"))


def hash_order(key: str, seed: int = 42) -> Column:
    """An order any engine can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def stratified_split(rows: DataFrame, group: Column, key: str = "sentence_id", seed: int = 42) -> DataFrame:
    """Adds split_name: of each group of more than five rows a tenth (at least one) is val, as many test, the rest train."""
    keyed = rows.withColumn("_g", group).withColumn("_h", hash_order(key, seed))
    placed = ranked(keyed, ["_g"], hex_bucket(F.col("_h")), ["_h", key])
    share = F.when(F.col("_size") > 5, F.greatest(F.lit(1), F.floor(F.col("_size") / 10))).otherwise(F.lit(0))
    name = F.when(F.col("_rank") <= share, "val").when(F.col("_rank") <= 2 * share, "test").otherwise("train")
    return placed.withColumn("split_name", name).drop("_g", "_h", "_size", "_rank")


def rewrite_pairs(rewrite: DataFrame, sentence: DataFrame, trope: DataFrame) -> DataFrame:
    """source_text, trope_name, target_text of every rewrite whose sentence and rule are known."""
    one = sentence.select("sentence_id", F.col("text").alias("source_text")).dropDuplicates(["sentence_id"])
    named = F.broadcast(trope.select("trope_id", F.col("name").alias("trope_name")))
    return rewrite.distinct().join(named, "trope_id").join(one, "sentence_id").select("source_text", "trope_name", F.col("rewritten_text").alias("target_text"))


def pairs_by_name(rewrite: DataFrame, trope: DataFrame) -> DataFrame:
    return rewrite.distinct().join(F.broadcast(trope.select("trope_id", "name")), "trope_id").groupBy("name").agg(F.count(F.lit(1)).alias("pairs"))


def unmatched_labels(label: DataFrame, trope: DataFrame) -> DataFrame:
    """Labels of rules the taxonomy lacks, counted."""
    return label.join(F.broadcast(trope.select("trope_id")), "trope_id", "left_anti").groupBy("trope_id").agg(F.count(F.lit(1)).alias("labels"))


def negative_sample(rows: DataFrame, positive: Column, key: str = "sentence_id", ratio: int = 3, seed: int = 42) -> DataFrame:
    """All positives and at most ``ratio`` negatives for each (at least one), those of smallest hash."""
    flagged = rows.withColumn("_p", positive)
    n = flagged.agg(F.count_if("_p")).first()[0]
    negatives = flagged.where(~F.col("_p")).withColumn("_h", hash_order(key, seed))
    kept = first_rows(negatives, max(1, ratio * n), hex_bucket(F.col("_h")), ["_h", key]).drop("_h")
    return flagged.where("_p").unionByName(kept).drop("_p")


def holdout_split(rows: DataFrame, key: str, percent: int = 10, seed: int = 42) -> DataFrame:
    """Adds is_val: a fixed share of the rows by hash."""
    return rows.withColumn("is_val", F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint") % 100 < percent)


def threshold_counts(scores: DataFrame) -> DataFrame:
    """scores: name, score, truth. tp, fp, fn of every name at thresholds 0.10 to 0.94.

    A score is counted once in the step it falls in; running sums over the 85 steps of a name give
    the counts, so no row is multiplied by the grid.
    """
    step = F.when(F.col("score") >= 0.10, F.least(F.lit(94), F.floor(F.col("score") * 100 + 1e-6).cast("int"))).otherwise(F.lit(9))
    binned = scores.groupBy("name", step.alias("step")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    grid = scores.select("name").distinct().select("name", F.explode(F.sequence(F.lit(9), F.lit(94))).alias("step"))
    full = grid.join(binned, ["name", "step"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy("name").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pos").over(Window.partitionBy("name"))
    out = full.select("name", "step", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), total.alias("all_pos"))
    return out.where("step >= 10").select("name", (F.col("step") / 100).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))


def with_f1(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 9))


def best_thresholds(scores: DataFrame, names: DataFrame | None = None, floor: float = 0.75, default: float = 0.5) -> DataFrame:
    """name, threshold of best F1 among those of precision ``floor`` or more, ties to the lowest; else the default."""
    fit = with_f1(threshold_counts(scores)).where((F.col("precision") >= floor) & (F.col("f1") > 0))
    best = fit.groupBy("name").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"))
    names = scores.select("name").distinct() if names is None else names
    return names.join(best, "name", "left").select("name", F.round(F.coalesce("t", F.lit(default)), 2).alias("threshold"))


def build_training_tables(sentence: DataFrame, label: DataFrame, rewrite: DataFrame, trope: DataFrame, root: str, names: list) -> dict:
    """Writes the wide table as three split tables and the rewrite pairs, laid out by rule, under ``root``; the paths by name."""
    wide = wide_labels(sentence, label, trope, names)
    split = cut(stratified_split(wide.withColumn("_first", first_label(names)), F.col("_first")).drop("_first"))
    paths = {name: f"{root.rstrip('/')}/{name}" for name in ("train", "val", "test", "rewrite_pairs")}
    for name in ("train", "val", "test"):
        write_table(split.where(F.col("split_name") == name).drop("split_name"), paths[name])
    write_table(rewrite_pairs(rewrite, sentence, trope), paths["rewrite_pairs"], "trope_name")
    return paths


def label_names(*tables: DataFrame) -> list:
    """The rule names that any of the wide tables has, in order (a few dozen columns)."""
    return sorted({c[len("trope__") :] for t in tables for c in t.columns if c.startswith("trope__")})
