"""Detectors by sentence and by document, and the findings of the gate and scan profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ellipsis, normalize_sentence, strip_front_matter, word_count
from ..runtime import cut, once
from .patterns import DETECTORS, GATE, first_match, hits
from .segment import paragraph_array, sentence_array

LONG_SENTENCE, LONG_PARAGRAPH, DUPLICATE_LENGTH = 25, 6, 25
CROSS = ("Content Duplication", "Historical Analogy Stacking", "Long Paragraph")
# Fixed value: the document form of the analogy rule (single spaces).
ANALOGY = "\\b[A-Z][\\w&' -]{1,40} (?:did not|didn'?t) (?:build|invent|create|start|make)\\b"


def detected(rows: DataFrame, text: str = "text", names: list | None = None, dialect: str = "re2") -> DataFrame:
    """One row for each sentence and detector that hits: the row's columns, name, match. No shuffle, no UDF."""
    names = names or list(DETECTORS)
    c = F.col(text)
    found = F.filter(
        F.array(*[F.when(hits(c, n, dialect), F.struct(F.lit(n).alias("name"), first_match(c, n, dialect).alias("match"))) for n in names]), lambda x: x.isNotNull()
    )
    return rows.select("*", F.explode(found).alias("_hit")).select(*rows.columns, "_hit.name", "_hit.match")


def score_vector(text: Column, order: list, dialect: str = "re2") -> Column:
    """array<float> of 1 and 0 in ``order``; 0 for names without a pattern."""
    return F.array(*[(hits(text, n, dialect).cast("float") if n in DETECTORS else F.lit(0.0).cast("float")) for n in order])


def weak_labels(sentence: DataFrame, trope: DataFrame, dialect: str = "re2", confidence: float = 0.6) -> DataFrame:
    """sentence_id, trope_id, label_source, confidence; names missing in the taxonomy are skipped."""
    found = detected(sentence.select("sentence_id", "text"), dialect=dialect).select("sentence_id", "name")
    return found.join(F.broadcast(trope.select("trope_id", "name")), "name").select("sentence_id", "trope_id", F.lit("seed-regex").alias("label_source"), F.lit(confidence).cast("float").alias("confidence"))


def long_sentences(rows: DataFrame, text: str = "text") -> DataFrame:
    """Sentences of more than 25 words, with n_words."""
    return rows.withColumn("n_words", word_count(F.col(text))).where(F.col("n_words") > LONG_SENTENCE)


def content_duplication(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every occurrence of a sentence (normalised, 25 characters or more) that stands twice in its document.

    Counted by (document, hash of the sentence), joined back only where a count exceeds one: no
    document is held in one task.
    """
    normal = rows.select("*", once(normalize_sentence(F.col(text)), "_n")).where(F.length("_n") >= DUPLICATE_LENGTH)
    keyed = normal.select(*rows.columns, F.xxhash64("_n").alias("_k"), F.xxhash64(F.lit(3), "_n").alias("_k2"))
    by = [doc, "_k", "_k2"]
    again = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*by)
    return keyed.join(again, by, "left_semi").select(*rows.columns)


def analogy_stacking(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All analogy sentences of documents that have two or more."""
    found = rows.where(F.col(text).rlike(ANALOGY))
    return found.join(found.groupBy(doc).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(doc), doc, "left_semi").select(*rows.columns)


def analysed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentences of the documents, with long: whether they stand in a paragraph of more than six. Made within the row.

    Sentences and starts of paragraphs are merged by place; the sentences between two starts are
    those of a paragraph.
    """
    merged = F.sort_array(
        F.concat(
            F.transform(paragraph_array(F.col(text)), lambda p: F.struct(p["start"].alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<text:string,char_start:int,char_end:int,line:int>").alias("x"))),
            F.transform(sentence_array(F.col(text)), lambda x: F.struct(x["char_start"].alias("at"), F.lit(1).alias("kind"), x.alias("x"))),
        )
    )
    told = docs.select(key, once(merged, "m"))
    starts = F.filter(F.transform("m", lambda x, i: F.when(x["kind"] == 0, i)), lambda i: i.isNotNull())
    marked = told.select(key, "m", once(F.concat(starts, F.array(F.size("m"))), "at")).where(F.size("at") > 1)

    def of_paragraph(j: Column) -> Column:
        n = F.get("at", j + 1) - F.get("at", j) - 1
        return F.transform(F.slice("m", F.get("at", j) + 2, n), lambda x: F.struct(x["x"].alias("x"), (n > LONG_PARAGRAPH).alias("long")))

    rows = marked.select(key, F.posexplode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - 2), of_paragraph))).alias("ordinal", "r"))
    return rows.select(key, "ordinal", "r.x.*", "r.long")


def long_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of paragraphs with more than six."""
    return analysed(docs, key, text).where("long").select(key, "text", "char_start", "char_end", "line")


def document_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """key, text, char_start, char_end, line, name of all findings that need the document. ``rows``: the documents as analysed already."""
    s = analysed(docs, key, text) if rows is None else rows
    parts = [content_duplication(s, key), analogy_stacking(s, key), s.where("long")]
    return reduce(DataFrame.unionByName, [p.select(key, "text", "char_start", "char_end", "line", F.lit(n).alias("name")) for p, n in zip(parts, CROSS)])


def gate_findings(docs: DataFrame, trope: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5, key: str = "doc_id", text: str = "text", dialect: str = "re2") -> DataFrame:
    """Findings of the gate: sentence detectors at or over their threshold, and document findings at 1.0."""
    rows = cut(analysed(docs, key, text))
    single = detected(rows, names=GATE, dialect=dialect).select(key, "line", "char_start", "char_end", "text", "name", F.lit(1.0).alias("confidence"))
    if thresholds is not None:
        single = single.join(F.broadcast(thresholds.select("name", "threshold")), "name", "left").where(F.col("confidence") >= F.coalesce("threshold", F.lit(default))).drop("threshold")
    cross = document_findings(docs, key, text, rows).select(key, "line", "char_start", "char_end", "text", "name", F.lit(1.0).alias("confidence"))
    named = single.unionByName(cross).join(F.broadcast(trope.select("name", "category", "description")), "name", "left")
    return named.select(
        F.col(key).alias("file"), "line", "char_start", "char_end", F.col("text").alias("sentence_text"), F.col("name").alias("violation_name"), "category", "confidence", "description",
        F.lit("(rewriter model unavailable)").alias("suggested_rewrite"),
    )


def scan_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", dialect: str = "python") -> DataFrame:
    """Findings of the scan profile: front matter left out; all patterns, length and document rules. file_line counts front matter."""
    body = docs.select(key, F.col(text).alias("_t"), strip_front_matter(F.col(text)).alias("body"))
    skipped = body.select(key, (F.length("_t") - F.length("body") - F.length(F.replace(F.substring(F.col("_t"), F.lit(1), F.length("_t") - F.length("body")), F.lit("\n"), F.lit("")))).alias("front_lines"))
    s = cut(analysed(body, key, "body"))
    single = detected(s, dialect=dialect).select(key, "line", F.col("text").alias("sentence"), "name", "match")
    length = long_sentences(s).select(key, "line", F.col("text").alias("sentence"), F.lit("Sentence Too Long (descriptive)").alias("name"), F.concat(F.col("n_words").cast("string"), F.lit(" words")).alias("match"))
    said = F.create_map(*[F.lit(x) for x in (CROSS[0], "verbatim repeat", CROSS[1], "historical analogy", CROSS[2], "paragraph >6 sentences")])
    cross = document_findings(body, key, "body", s).select(key, "line", F.col("text").alias("sentence"), "name", said[F.col("name")].alias("match"))
    return single.unionByName(length).unionByName(cross).join(skipped, key).select(key, "name", "line", (F.col("line") + F.col("front_lines")).cast("int").alias("file_line"), ellipsis(F.col("sentence")).alias("sentence"), "match")


def report_by_type(findings: DataFrame, key: str, name: str = "name") -> DataFrame:
    return findings.groupBy(name).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct(key).alias("files"))


def report_in_order(findings: DataFrame, key: str, name: str = "name") -> DataFrame:
    """The report by type, most findings first, equal ones by name (a row for each rule)."""
    return report_by_type(findings, key, name).orderBy(F.desc("findings"), name)


def top_hits(findings: DataFrame, key: str, name: str = "name", order: tuple = ("line", "sentence"), n: int = 8) -> DataFrame:
    """The first n findings of each file and type, and how many more there are."""
    w = Window.partitionBy(key, name)
    return (
        findings.withColumn("rank", F.row_number().over(w.orderBy(*order)))
        .withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - n, F.lit(0)))
        .where(F.col("rank") <= n)
    )


def gate_status(findings: DataFrame, max_findings: int = 0) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("findings")).select("findings", (F.col("findings") <= max_findings).alias("passed"))
