"""Markdown-aware segmentation of documents into sentences, without leaving the JVM or shuffling.

Marks are put into the text where blocks and sentences end, the text is split at the marks, and
offsets and lines are running sums over the lengths of the pieces; every step is an expression on
the row of the document. Fenced code is cut out first, line by line as it opens and closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip
from ..runtime import once

MARK, CODE = "﷐", "﷑"  # noncharacters of Unicode
_NL = "\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029"
_H = f"[{WS}&&[^{_NL}]]*"
_EOL = f"(?:\\r\\n|[{_NL}]|\\z)"
_LS = f"(?<![^{_NL}])(?<!\\r(?=\\n))"
_FENCE = f"{_H}(?:```|~~~)[^{_NL}]*"

# Abbreviations after which a period ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr vs etc e.g i.e fig no vol approx inc corp co ltd st u.s u.k a.m p.m".split()
_ABBR = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)

SENTENCE_END = f"(?<=[.!?])(?<!(?:\\A|[{WS}(\\[\"'])(?i:{_ABBR})\\.{{1,8}})([\"')\\]]?[{WS}]+)(?=[\"'(\\[]?[A-Z0-9])"
_PARAGRAPH_GAP = f"\\r?\\n[{WS}]*\\r?\\n+"
_STRUCTURE = f"(?m:^)(?:#{{1,6}}[{WS}]|[-*+][{WS}]|\\d+[.)][{WS}])"


def mark_sentences(block: Column) -> Column:
    return F.regexp_replace(block, SENTENCE_END, f"$1{MARK}")


def mark_blocks(text: Column) -> Column:
    """Marks around headings and list items and before blank lines (text without fences)."""
    # A first look at one character spares the look back at most places.
    single = f"(?=[#\\-*+0-9{WS}]){_LS}(?=#{{1,6}}[{WS}]|{_H}(?:[-*+]|[0-9]+[.)])[{WS}])([^{_NL}]+{_EOL})"
    blank = f"(?=[{WS}]){_LS}({_H}(?:\\r\\n|[{_NL}]))"
    return F.regexp_replace(F.regexp_replace(text, single, f"{MARK}$1{MARK}"), blank, f"{MARK}$1")


def mark_code(text: Column) -> Column:
    """Fenced regions as pieces of their own that begin with CODE; an open fence runs to the end."""
    region = f"{_LS}({_FENCE}(?:\\r\\n|[{_NL}])(?s:.*?){_LS}{_FENCE}{_EOL}|{_FENCE}(?s:.*)\\z)"
    return F.when(text.contains("```") | text.contains("~~~"), F.regexp_replace(text, region, f"{MARK}{CODE}$1{MARK}")).otherwise(text)


def _split(text: Column) -> Column:
    return F.split(text, MARK)


def pieces(text: Column) -> Column:
    """Array of the pieces of a text, in order, nothing lost; code pieces begin with CODE."""
    blocks = F.flatten(F.transform(_split(mark_code(text)), lambda p: F.when(p.startswith(CODE), F.array(p)).otherwise(_split(mark_blocks(p)))))
    return F.flatten(F.transform(blocks, lambda p: F.when(p.startswith(CODE), F.array(p)).otherwise(_split(mark_sentences(p)))))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_PIECE = "array<struct<raw:string,at:int,line:int>>"


def _body(p: Column) -> Column:
    return F.when(p.startswith(CODE), F.substring(p, 2, 1 << 30)).otherwise(p)


def _breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _placed(parts: Column) -> Column:
    """Pieces with the offset and line of their first character.

    The pieces are taken in blocks of about the root of their number: the blocks' starts are one
    running sum, the starts within a block another, so no array of the whole document is appended to
    piece by piece.
    """

    def blocks_of(p: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(p))).cast("int"))
        return _let(size, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / b).cast("int")), lambda i: F.slice(p, i * b + 1, b)))

    cut_up = F.transform(
        _let(parts, blocks_of),
        lambda ps: F.struct(
            ps.alias("ps"),
            F.aggregate(ps, F.lit(0), lambda n, p: n + F.length(_body(p))).alias("chars"),
            F.aggregate(ps, F.lit(0), lambda n, p: n + _breaks(p)).alias("breaks"),
        ),
    )
    entry = "array<struct<ps:array<string>,at:int,line:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.array().cast(entry).alias("out"))

    def next_block(acc: Column, b: Column) -> Column:
        return F.struct(
            (acc["at"] + b["chars"]).alias("at"),
            (acc["line"] + b["breaks"]).alias("line"),
            F.concat(acc["out"], F.array(F.struct(b["ps"].alias("ps"), acc["at"].alias("at"), acc["line"].alias("line")))).alias("out"),
        )

    def next_piece(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["at"] + F.length(_body(p))).alias("at"),
            (acc["line"] + _breaks(p)).alias("line"),
            F.concat(acc["out"], F.array(F.struct(p.alias("raw"), acc["at"].alias("at"), acc["line"].alias("line")))).alias("out"),
        )

    def within(b: Column) -> Column:
        return F.aggregate(b["ps"], F.struct(b["at"].alias("at"), b["line"].alias("line"), F.array().cast(_PIECE).alias("out")), next_piece)["out"]

    return F.flatten(F.transform(F.aggregate(cut_up, start, next_block)["out"], within))


def sentence_array(text: Column) -> Column:
    """Array of (text, char_start, char_end, line) of the sentences of a document."""
    kept = F.filter(_placed(pieces(text)), lambda x: ~x["raw"].startswith(CODE) & x["raw"].rlike(f"[^{WS}]"))

    def trimmed(x: Column) -> Column:
        lead = F.regexp_extract(x["raw"], f"\\A([{WS}]*)", 1)
        body = strip(x["raw"])
        start = x["at"] + F.length(lead)
        breaks = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
        return F.struct(body.alias("text"), start.cast("int").alias("char_start"), (start + F.length(body)).cast("int").alias("char_end"), (x["line"] + breaks).cast("int").alias("line"))

    return F.transform(kept, trimmed)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ordinal, text, char_start, char_end, line of every sentence. Null and blank texts have none."""
    array = docs.select(key, once(sentence_array(F.col(text)), "s"))
    return array.select(key, F.posexplode("s").alias("ordinal", "s")).select(key, "ordinal", "s.*")


def plain_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ordinal, text by punctuation alone (no blocks): the rule within one block."""
    array = docs.select(key, F.filter(F.transform(_split(mark_sentences(F.col(text))), strip), lambda t: t != "").alias("s"))
    return array.select(key, F.posexplode("s").alias("ordinal", "text"))


def paragraph_array(text: Column) -> Column:
    """Array of (start, end) of the paragraphs: cut at blank lines, and before headings and list items."""
    gap, cut = "﷒", "﷓"
    marked = F.regexp_replace(text, f"({_PARAGRAPH_GAP})", f"{MARK}{gap}$1{MARK}")
    parts = F.flatten(
        F.transform(
            _split(marked), lambda p: F.when(p.startswith(gap), F.array(p)).otherwise(F.filter(F.split(F.regexp_replace(p, f"({_STRUCTURE})", f"{cut}$1"), cut), lambda q: q != ""))
        )
    )
    # A gap is placed like any other piece; its mark counts as no character.
    placed = F.filter(_placed(F.transform(parts, lambda p: F.when(p.startswith(gap), F.concat(F.lit(CODE), F.substring(p, 2, 1 << 30))).otherwise(p))), lambda x: ~x["raw"].startswith(CODE) & (x["raw"] != ""))
    ranges = F.transform(placed, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["raw"])).alias("end")))
    return F.when(text.rlike(f"[^{WS}]"), ranges).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph, start, end."""
    array = docs.select(key, once(paragraph_array(F.col(text)), "p"))
    return array.select(key, F.posexplode("p").alias("paragraph", "p")).select(key, "paragraph", "p.start", "p.end")


def rough_sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[.!?](?:[{WS}]|\\z)"))
