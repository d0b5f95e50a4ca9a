"""Sentences, paragraphs and document detectors on small texts."""

import pytest
from pyspark.sql import functions as F

from veridraft.operators import detect
from veridraft.operators.segment import paragraphs, sentences

SF = "/root/testdata/sf0.001"


def split(spark, text):
    rows = sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("ordinal").collect()
    for r in rows:
        assert text[r.char_start : r.char_end] == r.text
        assert r.line == text[: r.char_start].count("\n") + 1
    return rows


@pytest.mark.parametrize(
    "text,want",
    [
        ("The pump hums. Does it leak? Shut it off!", ["The pump hums.", "Does it leak?", "Shut it off!"]),
        ("Prof. Ada and Mrs. Byron left at 6 a.m. on Monday. Nobody waved.", ["Prof. Ada and Mrs. Byron left at 6 a.m. on Monday.", "Nobody waved."]),
        ("Oil the hinge.\nGrease the pin.\n\nWipe both.", ["Oil the hinge.", "Grease the pin.", "Wipe both."]),
        ("", []),
        (" \t\n\n ", []),
        ("## Valve care\n\nRinse the seat weekly", ["## Valve care", "Rinse the seat weekly"]),
        ("* rinse the seat\n* dry the stem", ["* rinse the seat", "* dry the stem"]),
        ("Before it.\n\n~~~\nmake all\nmake test\n~~~\n\nAfter it.", ["Before it.", "After it."]),
        ("# Tools\n\n1. a wrench\n2) a file\n\nReturn them clean.", ["# Tools", "1. a wrench", "2) a file", "Return them clean."]),
        ("Text.\n```\nnever closed\nMore. Text.", ["Text."]),
        ("The answer is no. Next one.", ["The answer is no. Next one."]),
        ('He said "Stop." Then he left.', ['He said "Stop."', "Then he left."]),
        ("😀 One. Two — three. 4 five.", ["😀 One.", "Two — three.", "4 five."]),
        ("a\r\n\r\nB c.\r\n# H\r\nd", ["a", "B c.", "# H", "d"]),
    ],
)
def test_sentences(spark, text, want):
    assert [r.text for r in split(spark, text)] == want


def test_no_run_on_units(spark):
    text = "# Start up\n\nOpen the main cock and wait\n\n" + "".join(f"+ turn handle {i} to the left\n" for i in range(12)) + "\n```\nrun --all\n```\n\nThat is all."
    assert max(len(r.text.split()) for r in split(spark, text)) == 7


def test_a_long_document_takes_linear_time(spark):
    text = " ".join(f"Bolt {i} is tight." for i in range(60_000)) + "\n\n" + "\n\n".join(f"Nut {i}." for i in range(3_000))
    rows = sentences(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.max("char_end").alias("end"), F.max("line").alias("line"), F.max("ordinal").alias("o")).first()
    assert (got.n, got.end, got.line, got.o) == (63_000, len(text), text.count("\n") + 1, 62_999)
    assert detect.long_paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 60_000


def test_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "One. Two.", "y")], "doc_id int, text string, s string")
    assert sentences(df).count() == 2
    assert sentences(df.limit(0)).count() == 0


def doc(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


LONG = "Never stand below the hook while the hoist is moving a load."


def test_duplication(spark):
    rows = lambda ts: spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "doc_id int, ordinal int, text string")
    assert {r.ordinal for r in detect.content_duplication(rows([LONG, "Look up.", LONG.upper() + "  "])).collect()} == {0, 2}
    assert detect.content_duplication(rows(["The hoist lifts four tonnes at a time.", "The crane lifts nine tonnes at a time."])).count() == 0
    assert detect.content_duplication(rows(["Look up.", "Look up."])).count() == 0
    assert detect.content_duplication(rows([None, None, ""])).count() == 0


def test_analogies(spark):
    rows = lambda ts: spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "doc_id int, ordinal int, text string")
    assert detect.analogy_stacking(rows(["Kodak didn't start Flickr."])).count() == 0
    assert {r.ordinal for r in detect.analogy_stacking(rows(["Kodak didn't start Flickr.", "Plain.", "Sears did not make Etsy."])).collect()} == {0, 2}


@pytest.mark.parametrize(
    "text,least", [("Drain it.\n\nFill it.", 2), ("# Pump\n\nIt moves oil.\n\n## Seal\n\nIt keeps oil in.", 4), ("You need:\n\n- a rag\n- a brush\n\nThen begin.", 4), ("  \n ", 0)]
)
def test_paragraphs(spark, text, least):
    rows = paragraphs(doc(spark, text)).orderBy("start").collect()
    assert len(rows) >= least and (least or not rows)
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:]))


def test_long_paragraph(spark):
    seven = " ".join(f"Screw {i} goes in." for i in range(7))
    assert detect.long_paragraphs(doc(spark, seven)).count() == 7
    assert detect.long_paragraphs(doc(spark, "Lift it. Turn it.\n\nDrop it.")).count() == 0
    found = detect.long_paragraphs(doc(spark, seven + "\n\nLift it. Turn it.")).collect()
    assert len(found) == 7 and all(r.char_end <= len(seven) for r in found)


def test_combined(spark):
    text = f"Kodak didn't start Flickr. Sears didn't create Etsy.\n\n{LONG} {LONG}"
    names = sorted((r.char_start, r.name) for r in detect.document_findings(doc(spark, text)).collect())
    assert [n for _, n in names] == ["Historical Analogy Stacking"] * 2 + ["Content Duplication"] * 2


def test_round_trip_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sentences(docs).collect()
    assert rows
    for r in rows:
        assert texts[r.doc_id][r.char_start : r.char_end] == r.text
        assert r.line == texts[r.doc_id][: r.char_start].count("\n") + 1


def test_paragraph_texts(spark):
    from veridraft.functions.text import paragraph_texts

    rows = doc(spark, " Drain it.\n\n# Pump\nIt moves oil.\n- a rag\n\n  \n").select(paragraph_texts(F.col("text")).alias("p"))
    assert rows.first().p == ["Drain it.", "Pump\nIt moves oil.", "a rag"]
