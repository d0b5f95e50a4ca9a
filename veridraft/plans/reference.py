"""Queries of the prose-quality operators over the tables of the lake, each with its SQL where there is one.

Texts that hardly show a rule are joined by a few literal fixture rows, in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import NS_DOCUMENT, NS_SENTENCE, sha256_hex, uuid5
from ..functions.text import ellipsis, extension, front_matter, json_array_slice, line_of, normalize_sentence, relative_path, report_line, rewriter_prompt, score_text, strip, strip_front_matter, word_count
from ..operators import detect, phrases, rewrite, scoring, segment, training
from ..operators.patterns import DETECTORS, GATE, re2_pattern
from ..operators.ranking import ranked
from ..runtime import once, spread, table
from ..sources import lake
from ..taxonomy import NAMES, RULES, taxonomy
from . import segment_sql

WS = segment_sql.WS
FIXTURES = [
    "The file is read by the parser.", "Open the panel; remove the fuse.", "Don't remove the screws.", "The mechanic performs an analysis of the log.", "Our robust, cutting-edge solution seamlessly integrates powerful features.",
    "Spin up the cluster before you dive into the configuration.", "We will utilize this framework to facilitate the process.", "It is important to note that the system may fail.", "The system is showing the error message.",
    "This may help to improve the stability of the system.", "Turn shaft assembly to access filter.", "The problem — and nobody says so — is scale.", "overhead panel battery section connector", "Apple didn't build Uber.", "Facebook did not build Spotify.",
    "You can leverage the cache. They leverage. We unlock the full potential and unlock it.", "The part is needed by them. The part is needed. I'm sure it's fine, isn't it?", "Please note that the tool is required to run prior to the test.", "Open door. Check Valve. Close the lid.",
    "They perform a review, conduct an assessment, provide a summary and carry out a scan.", "Note.\nTurn valve",
]
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_FIXTURE_SQL = " UNION ALL ".join(f"SELECT 'fx-{i:02d}' AS sentence_id, {_Q(t)} AS text" for i, t in enumerate(FIXTURES))
_SENTENCES_SQL = f"SELECT DISTINCT sentence_id, text FROM sentence WHERE text IS NOT NULL UNION ALL {_FIXTURE_SQL}"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "sentence").select("sentence_id", "text")).where("text is not null").distinct()
    return rows.unionByName(spark.createDataFrame([(f"fx-{i:02d}", t) for i, t in enumerate(FIXTURES)], "sentence_id string, text string"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- segmentation -------------------------------------------------------------------------------
_ABBR = "|".join(a.replace(".", "\\.") for a in segment.ABBREVIATIONS)


def _unmark(t: str) -> str:
    return f"regexp_replace({t}, '((?:^|[{WS}\\x01(\\[\"''])(?i:{_ABBR})\\.+[\"'')\\]]?[{WS}]+)\\x01', '\\1', 'g')"


_PLAIN_SQL = f"""
WITH m AS (SELECT doc_id, lang, regexp_replace(replace(text, chr(1), ''), '([.!?]["'')\\]]?[{WS}]+)(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, lang, {_unmark(_unmark('t'))} AS t FROM m),
e AS (SELECT doc_id, lang, unnest(string_split(t, chr(1))) AS raw FROM u),
s AS (SELECT doc_id, lang, regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS text FROM e)
"""


def _plain(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("text is not null").select("doc_id", "lang", F.replace("text", F.lit("\x01"), F.lit("")).alias("text"))
    return segment.plain_sentences(docs.select(F.struct("doc_id", "lang").alias("k"), "text"), "k").select("k.doc_id", "k.lang", "ordinal", "text")


@_query(
    _PLAIN_SQL
    + f"""SELECT lang, count(*) AS sentences, sum(CASE WHEN regexp_matches(text, {_Q(re2_pattern('Passive Voice'))}) THEN 1 ELSE 0 END)::BIGINT AS passive
FROM s WHERE text <> '' GROUP BY lang"""
)
def passive_by_lang(spark, d):
    s = _plain(spark, d).select("lang", detect.hits(F.col("text"), "Passive Voice").alias("p"))
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.count_if("p").alias("passive"))


@_query(_PLAIN_SQL + "SELECT doc_id, count(*) AS sentences, sum(length(text))::BIGINT AS chars FROM s WHERE text <> '' GROUP BY doc_id")
def sentences_punctuation(spark, d):
    return _plain(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("text")).cast("bigint").alias("chars"))


_DOCS_SQL = "SELECT doc_id, text FROM documents"
_SEGMENTS_SQL = "WITH " + segment_sql.sentences(_DOCS_SQL, segment.ABBREVIATIONS)
_PARAGRAPHS_SQL = segment_sql.paragraphs(_DOCS_SQL)


@_query(_SEGMENTS_SQL + " SELECT * FROM s")
def sentences_split(spark, d):
    """Markdown-aware sentences with offsets and lines."""
    return segment.sentences(_documents(spark, d))


@_query(
    _SEGMENTS_SQL + " SELECT doc_id, count(*) AS sentences, sum(CASE WHEN substr(d.text, s.char_start + 1, s.char_end - s.char_start) <> s.text THEN 1 ELSE 0 END)::BIGINT AS wrong FROM s JOIN d USING (doc_id) GROUP BY doc_id"
)
def offsets_round_trip(spark, d):
    """Sentences whose offsets do not give back their text (none)."""
    docs = _documents(spark, d)
    s = segment.sentences(docs).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.substring(F.col("whole"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text")).alias("wrong"))


@_query("WITH " + _PARAGRAPHS_SQL + ' SELECT doc_id, paragraph, start, stop AS "end" FROM p')
def paragraph_ranges(spark, d):
    return segment.paragraphs(_documents(spark, d))


@_query(_SEGMENTS_SQL + f" SELECT max(len([x FOR x IN regexp_split_to_array(text, '[{WS}]+') IF x <> '']))::INT AS most FROM s")
def max_words_per_sentence(spark, d):
    return segment.sentences(_documents(spark, d)).agg(F.max(word_count(F.col("text"))).alias("most"))


@_query("SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, sentence_id) - 1 AS place FROM (SELECT DISTINCT doc_id, ordinal, sentence_id FROM sentence)")
def sentence_ordinals(spark, d):
    """Place of every sentence in its document; a document of any length is ranked block by block."""
    rows = table(spark, d, "sentence").select("doc_id", "ordinal", "sentence_id").distinct()
    placed = ranked(rows, ["doc_id"], F.floor(F.col("ordinal") / 1024).cast("int"), ["ordinal", "sentence_id"])
    return placed.select("doc_id", "ordinal", (F.col("_rank") - 1).cast("bigint").alias("place"))


# ---- detectors ----------------------------------------------------------------------------------
def _hits_sql(name: str) -> str:
    return f"regexp_matches(text, {_Q(re2_pattern(name).replace('$', chr(92) + 'z') if name == 'Content Duplication' else re2_pattern(name))})"


def _detector(name: str) -> None:
    slug = "detect_" + "".join(c if c.isalnum() else "_" for c in name.lower().replace("+", " plus")).strip("_")

    def run(spark, d):
        rows = _sentences(spark, d)
        return rows.where(detect.hits(F.col("text"), name)).select("sentence_id")

    run.__name__, run.__doc__ = slug, f"Sentences that show {name}."
    QUERIES[slug] = run
    ORACLES[slug] = f"SELECT sentence_id FROM ({_SENTENCES_SQL}) WHERE {_hits_sql(name)}"


for _n in DETECTORS:
    _detector(_n)


_FIRST_MATCHES_SQL = (
    f"WITH s AS ({_SENTENCES_SQL}) SELECT sentence_id, name, match FROM ("
    + " UNION ALL ".join(f"SELECT sentence_id, {_Q(n)} AS name, left(regexp_extract(text, {_Q(re2_pattern(n))}), 60) AS match FROM s WHERE {_hits_sql(n)}" for n in GATE)
    + ")"
)


@_query(_FIRST_MATCHES_SQL)
def first_matches(spark, d):
    """Matched text of every gate detector."""
    return detect.detected(_sentences(spark, d), names=GATE).select("sentence_id", "name", "match")


@_query(f"SELECT sentence_id, concat_ws('', {', '.join('CASE WHEN ' + _hits_sql(n) + ' THEN 1 ELSE 0 END' if n in DETECTORS else '0' for n in NAMES)}) AS vector FROM ({_SENTENCES_SQL})")
def regex_score_vector(spark, d):
    v = detect.score_vector(F.col("text"), NAMES)
    return _sentences(spark, d).select("sentence_id", F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "").alias("vector"))


@_query(
    f"SELECT name, count(*) AS labels FROM (" + " UNION ALL ".join(f"SELECT {_Q(n)} AS name FROM ({_SENTENCES_SQL}) WHERE {_hits_sql(n)}" for n in DETECTORS) + ") GROUP BY name"
)
def weak_labels(spark, d):
    """Weak labels by rule, counted."""
    tax = taxonomy(spark)
    return detect.weak_labels(_sentences(spark, d), tax).join(F.broadcast(tax.select("trope_id", "name")), "trope_id").groupBy("name").agg(F.count(F.lit(1)).alias("labels"))


_WORDS_SQL = f"len([x FOR x IN regexp_split_to_array(text, '[{WS}]+') IF x <> ''])"


@_query(f"SELECT sentence_id, {_WORDS_SQL}::INT AS n_words FROM ({_SENTENCES_SQL}) WHERE {_WORDS_SQL} > 25")
def long_sentences(spark, d):
    return detect.long_sentences(_sentences(spark, d)).select("sentence_id", "n_words")


_NORM_SQL = f"regexp_replace(regexp_replace(lower(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')), '[{WS}]+', ' ', 'g'), '[.!?]+$', '')"
_ROWS_SQL = "SELECT DISTINCT sentence_id, doc_id, ordinal, text FROM sentence WHERE text IS NOT NULL"


@_query(
    f"WITH s AS (SELECT *, {_NORM_SQL} AS n FROM ({_ROWS_SQL})), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS c FROM s WHERE length(n) >= 25) SELECT sentence_id, doc_id, ordinal FROM k WHERE c > 1"
)
def content_duplication(spark, d):
    rows = spread(table(spark, d, "sentence").select("sentence_id", "doc_id", "ordinal", "text")).where("text is not null").distinct()
    return detect.content_duplication(rows).select("sentence_id", "doc_id", "ordinal")


@_query(
    "WITH s AS (SELECT 'a' AS doc_id, 'Apple didn''t build Uber.' AS text UNION ALL SELECT 'a', 'Facebook did not invent it.' UNION ALL SELECT 'b', 'Only One did not make it.' UNION ALL "
    "SELECT doc_id, text FROM (SELECT DISTINCT sentence_id, doc_id, text FROM sentence WHERE text IS NOT NULL)), "
    "h AS (SELECT * FROM s WHERE regexp_matches(text, '\\b[A-Z][\\w&'' -]{1,40} (?:did not|didn''?t) (?:build|invent|create|start|make)\\b')) "
    "SELECT doc_id, text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM h) WHERE c > 1"
)
def analogy_stacking(spark, d):
    fixture = spark.createDataFrame([("a", "Apple didn't build Uber."), ("a", "Facebook did not invent it."), ("b", "Only One did not make it.")], "doc_id string, text string")
    rows = table(spark, d, "sentence").where("text is not null").select("sentence_id", "doc_id", "text").distinct().select("doc_id", "text")
    return detect.analogy_stacking(rows.unionByName(fixture)).select("doc_id", "text")


_FRONT = f"regexp_extract(text, '^---[{WS}]*\\n(?s:.*?)\\n---[{WS}]*\\n')"
_LONG_SQL = "long AS (SELECT s.* FROM s JOIN p ON s.doc_id = p.doc_id AND s.char_start >= p.start AND s.char_start < p.stop JOIN (SELECT s.doc_id, p.paragraph FROM s JOIN p ON s.doc_id = p.doc_id AND s.char_start >= p.start AND s.char_start < p.stop GROUP BY 1, 2 HAVING count(*) > 6) b ON b.doc_id = p.doc_id AND b.paragraph = p.paragraph)"
_DOCUMENT_SQL = f"{_SEGMENTS_SQL}, {_PARAGRAPHS_SQL}, {_LONG_SQL}"


@_query(_DOCUMENT_SQL + " SELECT doc_id, text, char_start, char_end, line FROM long")
def long_paragraphs(spark, d):
    return detect.long_paragraphs(_documents(spark, d))


_CATEGORY_SQL = "(VALUES " + ", ".join(f"({_Q(n)}, {_Q(c)}, {_Q(f'Rule: {n}.')})" for n, c in RULES) + ") AS r(name, category, description)"
_ANALOGY_SQL = "regexp_matches(text, '\\b[A-Z][\\w&'' -]{1,40} (?:did not|didn''?t) (?:build|invent|create|start|make)\\b')"
_GATE_SQL = (
    _DOCUMENT_SQL
    + ", h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line, char_start, char_end, text, {_Q(n)} AS name FROM s WHERE {_hits_sql(n)}" for n in GATE)
    + f" UNION ALL SELECT doc_id, line, char_start, char_end, text, 'Content Duplication' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS c FROM (SELECT *, {_NORM_SQL} AS n FROM s) WHERE length(n) >= 25) WHERE c > 1"
    + f" UNION ALL SELECT doc_id, line, char_start, char_end, text, 'Historical Analogy Stacking' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM s WHERE {_ANALOGY_SQL}) WHERE c > 1"
    + " UNION ALL SELECT doc_id, line, char_start, char_end, text, 'Long Paragraph' FROM long), "
    + "found AS (SELECT doc_id AS file, line, char_start, char_end, text AS sentence_text, h.name AS violation_name, category, 1.0::DOUBLE AS confidence, description, '(rewriter model unavailable)' AS suggested_rewrite FROM h LEFT JOIN "
    + _CATEGORY_SQL
    + " ON r.name = h.name)"
)


@_query(_GATE_SQL + " SELECT * FROM found")
def gate_findings(spark, d):
    return detect.gate_findings(_documents(spark, d), taxonomy(spark))


@_query(
    _GATE_SQL + " SELECT doc_id, text, char_start, char_end, line, name FROM h WHERE name IN ('Content Duplication', 'Historical Analogy Stacking', 'Long Paragraph')"
)
def document_findings(spark, d):
    """Findings that need the whole document."""
    return detect.document_findings(_documents(spark, d))


@_query(_GATE_SQL + " SELECT violation_name AS name, count(*) AS findings, count(DISTINCT file) AS files FROM found GROUP BY 1")
def gate_report(spark, d):
    return detect.report_by_type(detect.gate_findings(_documents(spark, d), taxonomy(spark)), "file", "violation_name").withColumnRenamed("violation_name", "name")


@_query(
    _GATE_SQL
    + " SELECT file, violation_name, line, char_start, sentence_text, rank, greatest(n - 8, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY file, violation_name ORDER BY line, char_start) AS rank, count(*) OVER (PARTITION BY file, violation_name) AS n FROM found) WHERE rank <= 8"
)
def top_gate_hits(spark, d):
    """The first eight findings of each file and rule, and how many more there are."""
    found = detect.gate_findings(_documents(spark, d), taxonomy(spark))
    return detect.top_hits(found, "file", "violation_name", order=("line", "char_start")).select("file", "violation_name", "line", "char_start", "sentence_text", "rank", "more")


_THRESHOLDS = {"Contraction Used": 2.0, "Passive Voice": 0.9, "Semicolon Used": 1.5}


@_query(_GATE_SQL + " SELECT violation_name, count(*) AS findings FROM found WHERE violation_name NOT IN ('Contraction Used', 'Semicolon Used') GROUP BY 1")
def gate_with_thresholds(spark, d):
    """Findings at thresholds of their own for some rules, the default for the rest."""
    told = spark.createDataFrame(list(_THRESHOLDS.items()), "name string, threshold double")
    return detect.gate_findings(_documents(spark, d), taxonomy(spark), told).groupBy("violation_name").agg(F.count(F.lit(1)).alias("findings"))


_SCAN_SQL = (
    f"WITH bodies AS (SELECT doc_id, text AS whole, substr(text, length({_FRONT}) + 1) AS text, length({_FRONT}) - length(replace({_FRONT}, chr(10), '')) AS skipped FROM documents WHERE text IS NOT NULL), "
    + segment_sql.sentences("SELECT doc_id, text FROM bodies", segment.ABBREVIATIONS)
    + ", "
    + segment_sql.paragraphs("SELECT doc_id, text FROM bodies")
    + f", {_LONG_SQL}, hits AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line, text, {_Q(n)} AS name, left(regexp_extract(text, {_Q(re2_pattern(n))}), 60) AS match FROM s WHERE {_hits_sql(n)}" for n in DETECTORS)
    + f" UNION ALL SELECT doc_id, line, text, 'Sentence Too Long (descriptive)', {_WORDS_SQL} || ' words' FROM s WHERE {_WORDS_SQL} > 25"
    + f" UNION ALL SELECT doc_id, line, text, 'Content Duplication', 'verbatim repeat' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS c FROM (SELECT *, {_NORM_SQL} AS n FROM s) WHERE length(n) >= 25) WHERE c > 1"
    + f" UNION ALL SELECT doc_id, line, text, 'Historical Analogy Stacking', 'historical analogy' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM s WHERE {_ANALOGY_SQL}) WHERE c > 1"
    + " UNION ALL SELECT doc_id, line, text, 'Long Paragraph', 'paragraph >6 sentences' FROM long) "
    + "SELECT doc_id, name, line, (line + skipped)::INT AS file_line, CASE WHEN length(hits.text) > 120 THEN left(hits.text, 120) || '...' ELSE hits.text END AS sentence, match FROM hits JOIN bodies USING (doc_id)"
)


@_query(_SCAN_SQL)
def scan_findings_ascii(spark, d):
    """The scan profile with the patterns' classes in ASCII, as RE2 reads them."""
    return detect.scan_findings(_documents(spark, d), dialect="re2")


@_query()
def scan_findings(spark, d):
    return detect.scan_findings(_documents(spark, d))


@_query()
def scan_report(spark, d):
    return detect.report_by_type(detect.scan_findings(_documents(spark, d)), "doc_id")


@_query()
def top_hits_per_type(spark, d):
    return detect.top_hits(detect.scan_findings(_documents(spark, d)), "doc_id", order=("line", "sentence", "match"))


@_query(_GATE_SQL + " SELECT count(*) AS findings, count(*) <= 0 AS passed FROM found")
def gate_status(spark, d):
    return detect.gate_status(detect.gate_findings(_documents(spark, d), taxonomy(spark)))


# ---- scalar functions ---------------------------------------------------------------------------
_FRONT_SQL = _FRONT


@_query(
    f"SELECT sentence_id, {_NORM_SQL} AS norm, {_WORDS_SQL}::INT AS n_words, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS short, "
    f"'remove passive voice: ' || text AS prompt FROM ({_SENTENCES_SQL})"
)
def sentence_scalars(spark, d):
    c = F.col("text")
    return _sentences(spark, d).select(
        "sentence_id", normalize_sentence(c).alias("norm"), word_count(c).alias("n_words"), ellipsis(c).alias("short"), rewriter_prompt(F.lit("Passive Voice"), c).alias("prompt")
    )


@_query(
    f"SELECT doc_id, {_FRONT_SQL} AS front, substr(text, length({_FRONT_SQL}) + 1) AS body, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS stripped, "
    "(1 + length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')))::INT AS line_at_200, lower(regexp_extract(source || '.MD', '(\\.[^./]+)$', 1)) AS ext FROM documents WHERE text IS NOT NULL"
)
def document_scalars(spark, d):
    c = F.col("text")
    return (
        _documents(spark, d)
        .where("text is not null")
        .select(
            "doc_id", front_matter(c).alias("front"), strip_front_matter(c).alias("body"), strip(c).alias("stripped"), line_of(c, F.lit(200)).cast("int").alias("line_at_200"),
            extension(F.concat("source", F.lit(".MD"))).alias("ext"),
        )
    )


@_query(
    "SELECT sentence_id, left(text, 1800) AS scored, len(regexp_extract_all(text, '[.!?](?:[" + WS + "]|$)'))::INT AS rough, 'lake/' || doc_id AS path, "
    "printf('%s:%d: [%s, %.2f] %s', 'lake/' || doc_id, ordinal, 'x', 0.5::DOUBLE, text) AS report FROM (SELECT DISTINCT sentence_id, doc_id, ordinal, text FROM sentence WHERE text IS NOT NULL AND ordinal IS NOT NULL AND doc_id IS NOT NULL)"
)
def report_scalars(spark, d):
    """What a model scores, a rough count of sentences, a path below a root and a line of a report."""
    rows = spread(table(spark, d, "sentence").select("sentence_id", "doc_id", "ordinal", "text")).where("text is not null and ordinal is not null and doc_id is not null").distinct()
    path = relative_path(F.concat(F.lit("/data/lake/"), "doc_id"), "/data")
    return rows.select("sentence_id", score_text(F.col("text")).alias("scored"), segment.rough_sentence_count(F.col("text")).alias("rough"), path.alias("path"), report_line(path, F.col("ordinal"), F.lit("x"), F.lit(0.5), F.col("text")).alias("report"))


_JSON = "'Sure: [{\"positive\": \"' || doc_id || '\", \"rewrite\": \"b\"}, {\"positive\": \"c\", \"rewrite\": \"d\"}] done'"


@_query(f"SELECT DISTINCT doc_id, x->>'positive' AS positive, x->>'rewrite' AS rewrite FROM (SELECT doc_id, unnest(from_json(regexp_extract({_JSON}, '(?s)(\\[.*\\])', 1), '[\"JSON\"]')) AS x FROM source_document WHERE doc_id IS NOT NULL)")
def json_slices(spark, d):
    """Pairs out of the JSON array within an answer."""
    answer = F.concat(F.lit('Sure: [{"positive": "'), "doc_id", F.lit('", "rewrite": "b"}, {"positive": "c", "rewrite": "d"}] done'))
    rows = table(spark, d, "source_document").where("doc_id is not null").select("doc_id").distinct()
    return rows.select("doc_id", F.explode(json_array_slice(answer)).alias("x")).select("doc_id", "x.*")


_UUID_SQL = (
    "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12)"
)


@_query(f"WITH t AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, sha, sha1(unhex('{NS_DOCUMENT}') || encode(sha)) AS h FROM t) SELECT doc_id, sha, {_UUID_SQL} AS id FROM g")
def doc_ids_uuid5(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", sha256_hex(F.col("text")).alias("sha")).withColumn("id", uuid5(NS_DOCUMENT, F.col("sha")))


# ---- lake ---------------------------------------------------------------------------------------
@_query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sha_dedup(spark, d):
    docs = _documents(spark, d).where("text is not null").select("doc_id", sha256_hex(F.col("text")).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@_query("SELECT DISTINCT * FROM (SELECT * FROM source_document UNION ALL SELECT doc_id, source, url, sha256, 'later' AS fetched_at, is_ai_generated, is_synthetic FROM source_document)")
def append_distinct(spark, d):
    t = table(spark, d, "source_document")
    return lake.with_rows(t, t.withColumn("fetched_at", F.lit("later")))


@_query(
    "SELECT DISTINCT sentence_id, trope_id, label_source, confidence::DOUBLE AS confidence FROM (SELECT * FROM sentence_trope_label WHERE label_source IS DISTINCT FROM 'seed-regex' "
    "UNION ALL SELECT sentence_id, 'x' AS trope_id, 'seed-regex' AS label_source, 0.5::FLOAT AS confidence FROM sentence_trope_label WHERE label_source = 'seed-regex')"
)
def replace_rows(spark, d):
    t = table(spark, d, "sentence_trope_label")
    new = t.where("label_source = 'seed-regex'").select("sentence_id", F.lit("x").alias("trope_id"), "label_source", F.lit(0.5).cast("float").alias("confidence"))
    return lake.replaced_rows(t, "label_source", "seed-regex", new).withColumn("confidence", F.col("confidence").cast("double"))


@_query("SELECT s.doc_id, s.sha256 FROM (SELECT sha256, min(doc_id) AS doc_id FROM source_document WHERE NOT is_synthetic GROUP BY sha256) s WHERE s.sha256 NOT IN (SELECT sha256 FROM source_document WHERE is_synthetic AND sha256 IS NOT NULL)")
def new_documents(spark, d):
    t = table(spark, d, "source_document")
    batch = t.where(~F.col("is_synthetic")).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return lake.new_documents(batch, t.where("is_synthetic")).select("doc_id", "sha256")


# ---- training tables ----------------------------------------------------------------------------
_BEST_SQL = "SELECT sentence_id, trope_id, max(confidence) AS confidence FROM sentence_trope_label GROUP BY 1, 2"
_FIRST_SQL = f"SELECT s.sentence_id, coalesce(min(t.name), 'none') AS first FROM (SELECT DISTINCT sentence_id FROM sentence) s LEFT JOIN ({_BEST_SQL}) b ON s.sentence_id = b.sentence_id AND b.confidence >= 0.5 LEFT JOIN trope t ON t.trope_id = b.trope_id GROUP BY s.sentence_id"


def _trope_names(spark, d) -> list:
    return [r.name for r in table(spark, d, "trope").select("name").orderBy("name").collect()]  # the taxonomy: a few dozen rows


def _firsts(spark, d) -> DataFrame:
    names = _trope_names(spark, d)
    wide = training.wide_labels(table(spark, d, "sentence"), table(spark, d, "sentence_trope_label"), table(spark, d, "trope"), names)
    return wide.select("sentence_id", once(training.first_label(names), "first"))


@_query(f"SELECT sentence_id, trope_id, confidence::DOUBLE AS confidence FROM ({_BEST_SQL})")
def best_label(spark, d):
    return training.best_labels(table(spark, d, "sentence_trope_label")).withColumn("confidence", F.col("confidence").cast("double"))


@_query(f"SELECT t.name, count(DISTINCT b.sentence_id) AS positives FROM trope t LEFT JOIN ({_BEST_SQL}) b ON t.trope_id = b.trope_id AND b.confidence >= 0.5 AND b.sentence_id IN (SELECT sentence_id FROM sentence) GROUP BY t.name")
def label_pivot(spark, d):
    """The wide table of labels, summed up by rule."""
    names = _trope_names(spark, d)
    wide = training.wide_labels(table(spark, d, "sentence"), table(spark, d, "sentence_trope_label"), table(spark, d, "trope"), names)
    sums = wide.agg(*[F.count_if(F.col(f"`trope__{n}`")).alias(n) for n in names])
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))).alias("name", "positives"))


@_query(_FIRST_SQL)
def first_true_label(spark, d):
    return _firsts(spark, d)


@_query(
    f"WITH f AS ({_FIRST_SQL}), r AS (SELECT sentence_id, first, count(*) OVER (PARTITION BY first) AS n, row_number() OVER (PARTITION BY first ORDER BY sha256('42:' || sentence_id), sentence_id) AS k FROM f), "
    "q AS (SELECT *, CASE WHEN n > 5 THEN greatest(1, n // 10) ELSE 0 END AS v FROM r) SELECT sentence_id, first, CASE WHEN k <= v THEN 'val' WHEN k <= 2 * v THEN 'test' ELSE 'train' END AS split_name FROM q"
)
def stratified_split(spark, d):
    return training.stratified_split(_firsts(spark, d), F.col("first")).select("sentence_id", "first", "split_name")


_REWRITE_SQL = "SELECT DISTINCT * FROM sentence_rewrite"


@_query(f"SELECT s.text AS source_text, t.name AS trope_name, r.rewritten_text AS target_text FROM ({_REWRITE_SQL}) r JOIN trope t ON r.trope_id = t.trope_id JOIN (SELECT sentence_id, min(text) AS text FROM sentence GROUP BY 1) s ON s.sentence_id = r.sentence_id")
def rewrite_pairs_join(spark, d):
    return training.rewrite_pairs(table(spark, d, "sentence_rewrite"), table(spark, d, "sentence").groupBy("sentence_id").agg(F.min("text").alias("text")), table(spark, d, "trope"))


@_query(f"SELECT t.name, count(*) AS pairs FROM ({_REWRITE_SQL}) r JOIN trope t ON r.trope_id = t.trope_id GROUP BY t.name")
def pairs_by_name(spark, d):
    return training.pairs_by_name(table(spark, d, "sentence_rewrite"), table(spark, d, "trope"))


@_query("SELECT trope_id, count(*) AS labels FROM sentence_trope_label WHERE trope_id NOT IN (SELECT trope_id FROM trope) GROUP BY trope_id")
def unmatched_names(spark, d):
    return training.unmatched_labels(table(spark, d, "sentence_trope_label"), table(spark, d, "trope"))


_IS_POS = "first = 'Hidden Actor'"


@_query(
    f"WITH f AS ({_FIRST_SQL}), n AS (SELECT greatest(1, 3 * count(*)) AS k FROM f WHERE {_IS_POS}) SELECT sentence_id, first FROM f WHERE {_IS_POS} UNION ALL "
    f"SELECT sentence_id, first FROM (SELECT *, row_number() OVER (ORDER BY sha256('42:' || sentence_id), sentence_id) AS r FROM f WHERE NOT ({_IS_POS})) WHERE r <= (SELECT k FROM n)"
)
def negative_sample(spark, d):
    return training.negative_sample(_firsts(spark, d), F.expr(_IS_POS)).select("sentence_id", "first")


@_query("SELECT pair_id, (('0x' || substr(sha256('42:' || pair_id::VARCHAR), 1, 8))::BIGINT % 100) < 10 AS is_val FROM rewrite_pairs WHERE source_text IS NOT NULL AND target_text IS NOT NULL AND trope_name IS NOT NULL")
def holdout_split(spark, d):
    rows = table(spark, d, "rewrite_pairs").dropna(subset=["source_text", "target_text", "trope_name"])
    return training.holdout_split(rows, "pair_id").select("pair_id", "is_val")


_SCORES_SQL = "SELECT o_orderpriority AS name, (o_orderkey % 97) / 96.0 AS score, ((o_orderkey % 97) * 7 + o_custkey % 300) > 600 AS truth FROM orders"


@_query(
    f"WITH s AS ({_SCORES_SQL}), g AS (SELECT unnest(range(10, 95)) AS i), c AS (SELECT name, i, sum(CASE WHEN floor(score * 100 + 1e-6) >= i AND truth THEN 1 ELSE 0 END) AS tp, "
    "sum(CASE WHEN floor(score * 100 + 1e-6) >= i AND NOT truth THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN floor(score * 100 + 1e-6) < i AND truth THEN 1 ELSE 0 END) AS fn FROM s, g GROUP BY name, i), "
    "q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c), "
    "f AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM q WHERE p >= 0.75), "
    "b AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY f1 DESC, i) AS k FROM f WHERE f1 > 0) "
    "SELECT n.name, round(coalesce(b.i / 100.0, 0.5), 2)::DOUBLE AS threshold FROM (SELECT DISTINCT name FROM s) n LEFT JOIN b ON n.name = b.name AND b.k = 1"
)
def threshold_search(spark, d):
    scores = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("name"), ((F.col("o_orderkey") % 97) / 96.0).alias("score"), (((F.col("o_orderkey") % 97) * 7 + F.col("o_custkey") % 300) > 600).alias("truth")
    )
    return training.best_thresholds(scores)


# ---- model stages -------------------------------------------------------------------------------
@_query(
    "WITH n AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), l AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM n) "
    "SELECT vec_id, round(list_sum([x / norm FOR x IN v]), 4) AS total, round(1 / (1 + exp(-list_sum([x / norm FOR x IN v]))), 4) AS p FROM l"
)
def normalized_head(spark, d):
    """Vectors of length one, their sum (a head of equal weights) and its sigmoid."""
    v = table(spark, d, "embeddings").select("vec_id", scoring.l2_normalized(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.round(total, 4).alias("total"), F.round(scoring.sigmoid(total), 4).alias("p"))


@_query(f"SELECT sentence_id, (CASE WHEN {_hits_sql('Passive Voice')} THEN 1 ELSE 0 END)::DOUBLE AS first, 0.25::DOUBLE AS second FROM ({_SENTENCES_SQL})")
def padded_and_added(spark, d):
    regex = detect.score_vector(F.col("text"), ["Passive Voice", "Unambiguous Reference"])
    model = scoring.padded({"Unambiguous Reference": F.lit(0.25)}, ["Passive Voice", "Unambiguous Reference"])
    return _sentences(spark, d).select("sentence_id", scoring.added(regex, model).alias("v")).select("sentence_id", F.col("v")[0].cast("double").alias("first"), F.col("v")[1].cast("double").alias("second"))


@_query("SELECT sentence_id, 28::INT AS size, 0::DOUBLE AS total FROM (SELECT DISTINCT sentence_id FROM sentence)")
def model_score_fallback(spark, d):
    rows = scoring.model_scores(table(spark, d, "sentence").select("sentence_id").distinct(), None, NAMES)
    return rows.select("sentence_id", F.size("scores").alias("size"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


@_query()
def phrase_table(spark, d):
    """The rewriter fitted on the pairs: phrases and their rewrites by rule."""
    return phrases.fit_phrases(table(spark, d, "rewrite_pairs"))


# ---- rewriter -----------------------------------------------------------------------------------
def _pass_sql(kind: str, t: str) -> str:
    """A pass as nested RE2 replacements; look-ahead rules first set a guard into protected places."""
    for p, v, _ in rewrite.PASSES[kind]:
        if kind == "contraction":
            p = "\\b" + p[len("(?<!\\w)") : -len("(?!\\w)")] + "\\b"
        if "(?!" in p:
            word, guard = p.split("(?!", 1)
            word, guard = word.replace("\\b", ""), guard[:-1]
            t = f"regexp_replace({t}, {_Q(f'(?i)(' + chr(92) + f'b{word[:-1]})({word[-1]}' + chr(92) + f'b{guard})')}, '\\1' || chr(2) || '\\2', 'g')"
            t = f"replace(regexp_replace({t}, {_Q('(?i)' + chr(92) + 'b' + word + chr(92) + 'b')}, {_Q(v)}, 'g'), chr(2), '')"
            continue
        flag = "" if kind == "missing-article" else "(?i)"
        p = p.replace("\\s", f"[{WS}]")
        t = f"regexp_replace({t}, {_Q(flag + p)}, {_Q(v.replace('$', chr(92)))}, 'g')"
    return t


def _rewriter(kind: str) -> None:
    slug = "rewrite_" + kind.replace("-", "_")

    def run(spark, d):
        return rewrite.apply_pass(_sentences(spark, d), kind)

    run.__name__, run.__doc__ = slug, f"Texts after the pass {kind}."
    QUERIES[slug] = run
    ORACLES[slug] = f"SELECT sentence_id, {_pass_sql(kind, 'text')} AS text FROM ({_SENTENCES_SQL})"


for _k in rewrite.PASSES:
    _rewriter(_k)


def _rewritten_sql() -> str:
    t = "body"
    for kind in rewrite.PASSES:
        t = _pass_sql(kind, t)
    return f"WITH f AS (SELECT doc_id, text, {_FRONT_SQL} AS front FROM documents), b AS (SELECT doc_id, text, front, substr(text, length(front) + 1) AS body FROM f), n AS (SELECT doc_id, text, front, body, {t} AS new FROM b) SELECT doc_id, CASE WHEN new = body THEN text ELSE front || new END AS new_text, new <> body AS changed FROM n"


@_query(_rewritten_sql())
def rewritten_texts(spark, d):
    """The documents after all passes."""
    return rewrite.rewrite_documents(_documents(spark, d)).select("doc_id", "new_text", "changed")


@_query()
def rewrite_documents(spark, d):
    return rewrite.rewrite_documents(_documents(spark, d)).select("doc_id", "new_text", "changed", rewrite.change_lines(F.col("changes")).alias("changes"))


def _summary_sql() -> str:
    """The passes rule by rule, each a step that counts the places on the text as the rule finds it."""
    steps, parts, n = ["r0 AS (SELECT doc_id, substr(text, length(" + _FRONT_SQL + ") + 1) AS t FROM documents WHERE text IS NOT NULL)"], [], 0
    for kind, rules in rewrite.PASSES.items():
        for p, v, _ in rules:
            flag = "" if kind == "missing-article" else "(?i)"
            guarded = "t"
            if kind == "contraction":
                p = "\\b" + p[len("(?<!\\w)") : -len("(?!\\w)")] + "\\b"
            if "(?!" in p:
                word, guard = p.split("(?!", 1)
                word, guard = word.replace("\\b", ""), guard[:-1]
                guarded = f"regexp_replace(t, {_Q(f'(?i)(' + chr(92) + f'b{word[:-1]})({word[-1]}' + chr(92) + f'b{guard})')}, '\\1' || chr(2) || '\\2', 'g')"
                p = f"\\b{word}\\b"
            p, v = _Q(flag + p.replace("\\s", f"[{WS}]")), _Q(v.replace("$", chr(92)))
            n += 1
            steps.append(f"r{n} AS MATERIALIZED (SELECT doc_id, replace(regexp_replace(g, {p}, {v}, 'g'), chr(2), '') AS t, len(regexp_extract_all(g, {p})) AS n FROM (SELECT doc_id, {guarded} AS g FROM r{n - 1}))")
            parts.append(f"SELECT {_Q(kind)} AS type, n FROM r{n} WHERE n > 0")
    return "WITH " + ", ".join(steps) + " SELECT type, count(*) AS entries, sum(n)::BIGINT AS hits FROM (" + " UNION ALL ".join(parts) + ") GROUP BY type"


@_query(_summary_sql())
def rewrite_summary(spark, d):
    return rewrite.rewrite_summary(rewrite.rewrite_documents(_documents(spark, d)))


_INGEST_SQL = (
    "WITH t AS (SELECT regexp_replace(text, '^[" + WS + "]+|[" + WS + "]+$', '', 'g') AS text FROM documents), "
    "u AS (SELECT text, sha256(text) AS sha FROM (SELECT DISTINCT text FROM t WHERE text <> '')), "
    f"g AS (SELECT text, sha1(unhex('{NS_DOCUMENT}') || encode(sha)) AS h FROM u), "
    f"i AS (SELECT {_UUID_SQL} AS doc_id, text FROM g), "
    + segment_sql.sentences("SELECT doc_id, text FROM i", segment.ABBREVIATIONS, "y_")
    + f", z AS (SELECT *, sha1(unhex('{NS_SENTENCE}') || encode(doc_id || ':' || ordinal)) AS h FROM y_s) SELECT {_UUID_SQL} AS sentence_id, doc_id, ordinal, char_start, char_end FROM z"
)


@_query(_INGEST_SQL)
def ingest_documents(spark, d):
    """Documents taken into the lake: ids of their sentences, and places."""
    raw = _documents(spark, d).select("text", "source", F.lit(None).cast("string").alias("url"), F.lit(False).alias("is_ai_generated"))
    return training.ingest(raw, "2025-01-06T00:00:00+00:00")[1].select("sentence_id", "doc_id", "ordinal", "char_start", "char_end")
