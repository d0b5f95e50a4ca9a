"""Detectors in both dialects, the rewriter, ids, and the scan and gate profiles."""

import uuid

import pytest
from pyspark.sql import functions as F

from veridraft.functions.ids import NS_DOCUMENT, uuid5
from veridraft.functions.text import json_array_slice, normalize_sentence, strip_front_matter
from veridraft.operators import detect, rewrite
from veridraft.operators.patterns import DETECTORS, register_detector
from veridraft.taxonomy import NAMES, taxonomy

EXAMPLES = {
    "Passive Voice": "The file is read by the parser.",
    "Semicolon Used": "Open the panel; remove the fuse.",
    "Contraction Used": "Don't remove the screws.",
    "Nominalization": "The mechanic performs an analysis of the log.",
    "Marketing Adjective": "Our robust solution seamlessly integrates.",
    "Phrasal Verb": "Spin up the cluster.",
    "Banned Synonym": "We will utilize this framework.",
    "Modal Hedge": "It is important to note that this may fail.",
    "-ing Main Verb": "The system is showing the error message.",
    "Stacked Auxiliaries": "This may help to improve it.",
    "Missing Article": "Turn shaft assembly to access filter.",
    "Em-Dash Overuse": "The problem — and this is it — is scale.",
    "Three+ Nouns in a Row": "overhead panel battery section connector",
    "Historical Analogy Stacking": "Apple didn't build Uber.",
    "Content Duplication": "Short.",
}


@pytest.mark.parametrize("dialect", ["re2", "python"])
def test_examples(spark, dialect):
    df = spark.createDataFrame(list(EXAMPLES.items()), "rule string, text string")
    rows = df.select("rule", *[detect.hits(F.col("text"), n, dialect).alias(f"h{i}") for i, n in enumerate(DETECTORS)]).collect()
    for r in rows:
        assert r[f"h{list(DETECTORS).index(r.rule)}"], r.rule


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,name,python,re2", [("Note.\nTurn valve", "Missing Article", True, False), ("it is éaing", "-ing Main Verb", True, False), ("isé done", "Passive Voice", False, False)])
def test_dialects(spark, text, name, python, re2):
    assert one(spark, detect.hits(F.lit(text), name, "python")) is python
    assert one(spark, detect.hits(F.lit(text), name, "re2")) is re2


def test_registered_detector(spark):
    register_detector("Shouting", "<b>[A-Z]{4,}<b>")
    try:
        assert one(spark, detect.hits(F.lit("Do it NOWW"), "Shouting"))
    finally:
        del DETECTORS["Shouting"]


def run(spark, text, **kw):
    return rewrite.rewrite_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), **kw).first()


@pytest.mark.parametrize(
    "text,want",
    [
        ("Open the door", "Open the the door"),
        ("Open a door", "Open a door"),
        ("We can leverage the cache. They leverage.", "We can leverage the cache. They use."),
        ("It's important to note that x", " x"),
        ("I'm here. Utilize it.", "I am here. use it."),
        ("---\na: Don't\n---\nDon't go.", "---\na: Don't\n---\ndo not go."),
        ("They perform a review and perform an analysis.", "They review and analyze."),
        ("It is needed by them, it is needed.", "It is needed by them, it needs."),
        ("Nothing here.", "Nothing here."),
    ],
)
def test_rewrites(spark, text, want):
    r = run(spark, text)
    assert r.new_text == want and r.changed == (text != want) and bool(r.changes) == r.changed


def test_rewrite_log_and_modes(spark):
    r = run(spark, "Don't stop, don't. Open door.")
    assert [(c.type, c.hits) for c in r.changes] == [("contraction", 2), ("missing-article", 1)]
    assert run(spark, "Open the door", skip_existing_article=True).new_text == "Open the door"
    df = spark.createDataFrame([(1, "Don't and can't."), (2, None), (3, "")], "doc_id int, text string")
    out = rewrite.rewrite_documents(df)
    assert {(s.type, s.entries, s.hits) for s in rewrite.rewrite_summary(out).collect()} == {("contraction", 2, 2)}


def test_ids_and_scalars(spark):
    assert one(spark, uuid5(NS_DOCUMENT, F.lit("é:1"))) == str(uuid.uuid5(uuid.UUID(NS_DOCUMENT), "é:1"))
    assert one(spark, normalize_sentence(F.lit("  A  b.\n!? "))) == "a b."[:3] + ".\n!?".replace("\n", " ").rstrip(".!?")
    assert one(spark, strip_front_matter(F.lit("---\na: 1\n---\nBody"))) == "Body"
    got = one(spark, json_array_slice(F.lit('x [{"positive":"a","rewrite":"b"}] y')))
    assert [(g.positive, g.rewrite) for g in got] == [("a", "b")]


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "---\nt: x\n---\n# T\n\nThe file is read. " + "word " * 26 + "end."), (2, ""), (3, None)], "doc_id int, text string")
    scan = {(r.name, r.line, r.file_line) for r in detect.scan_findings(docs).collect()}
    assert ("Passive Voice", 3, 6) in scan and ("Sentence Too Long (descriptive)", 3, 6) in scan and ("Content Duplication", 1, 4) in scan
    gate = detect.gate_findings(docs, taxonomy(spark))
    assert "Content Duplication" not in {r.violation_name for r in gate.collect()}
    assert gate.where("violation_name = 'Passive Voice'").first().category == "verb-form"
    assert not detect.gate_status(gate).first().passed
    limits = spark.createDataFrame([("Passive Voice", 1.5)], "name string, threshold double")
    assert "Passive Voice" not in {r.violation_name for r in detect.gate_findings(docs, taxonomy(spark), limits).collect()}


def test_score_vector(spark):
    v = one(spark, detect.score_vector(F.lit("The file is read; don't."), NAMES))
    assert len(v) == 28 and v[0] == 1.0 and v[3] == 1.0 and v[27] == 0.0


def test_first_matches_against_brute_force(spark, tmp_path):
    import re

    from veridraft.operators.patterns import GATE, re2_pattern
    from veridraft.plans.reference import FIXTURES, QUERIES

    texts = [*EXAMPLES.values(), "one two three", "alpha " * 30, "", None]
    spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sentence_id string, text string").write.parquet(str(tmp_path / "sentence.parquet"))
    got = sorted(tuple(r) for r in QUERIES["first_matches"](spark, str(tmp_path)).collect())
    rows = [*((f"s{i}", t) for i, t in enumerate(texts) if t is not None), *((f"fx-{i:02d}", t) for i, t in enumerate(FIXTURES))]
    want = sorted((k, n, m.group()[:60]) for k, t in rows for n in GATE if (m := re.search(re2_pattern(n), t, re.ASCII)))
    assert got == want and {n for _, n, _ in got} == set(GATE)
