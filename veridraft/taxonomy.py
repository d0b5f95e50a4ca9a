"""The taxonomy of rules, in canonical order (the order of score vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import NS_TAXONOMY, uuid5

# Name and category of every rule.
RULES = [
    ("Passive Voice", "verb-form"),
    ("Sentence Too Long (procedural)", "sentence-structure"),
    ("Sentence Too Long (descriptive)", "sentence-structure"),
    ("Semicolon Used", "punctuation"),
    ("Contraction Used", "word-form"),
    ("Nominalization", "verb-form"),
    ("Marketing Adjective", "word-choice"),
    ("Phrasal Verb", "word-choice"),
    ("Banned Synonym", "word-choice"),
    ("Modal Hedge", "sentence-structure"),
    ("-ing Main Verb", "verb-form"),
    ("Stacked Auxiliaries", "verb-form"),
    ("Missing Article", "word-form"),
    ("Em-Dash Overuse", "formatting"),
    ("Long Paragraph", "paragraph-structure"),
    ("Unclear Instruction Order", "sentence-structure"),
    ("Three+ Nouns in a Row", "word-form"),
    ("Stacked Prepositional Phrases", "sentence-structure"),
    ("Content Duplication", "composition"),
    ("Historical Analogy Stacking", "composition"),
    ("Word Choice Appropriateness", "word-choice"),
    ("Safety-Critical Clarity", "tone"),
    ("Readability for Non-Native Speakers", "tone"),
    ("Technical Noun Consistency", "composition"),
    ("Sentence Logic (Makes Good Sense)", "composition"),
    ("Appropriate Technical Verb", "word-choice"),
    ("Unambiguous Reference", "tone"),
    ("Excessive Abstraction", "word-choice"),
]
NAMES = [n for n, _ in RULES]


def taxonomy(spark: SparkSession, described: dict | None = None) -> DataFrame:
    """trope_id, name, category, description, example_phrase; ``described``: name to (description, example)."""
    told = described or {}
    rows = [(n, c, *told.get(n, (f"Rule: {n}.", None))) for n, c in RULES]
    table = spark.createDataFrame(rows, "name string, category string, description string, example_phrase string").coalesce(1)
    return table.select(uuid5(NS_TAXONOMY, F.col("name")).alias("trope_id"), "name", "category", "description", "example_phrase")


def write_taxonomy(spark: SparkSession, path: str, described: dict | None = None) -> None:
    """The taxonomy as a table of its own."""
    from .sources.lake import write_table

    write_table(taxonomy(spark, described), path)
