"""Sentence units of unsegmented blocks, across languages and scripts.

Document-centred disambiguation. A period before a word in upper case or a number is ambiguous
where the word before it may be an abbreviation. Every row first gives evidence: for a word before
such a period, how often it stands before a period that surely ends nothing (a lower-case word or a
comma follows: an abbreviation) and how often without one; for the word after it, how often it is
capitalised in mid-sentence (a proper name or noun) and how often in lower case. The evidence of
the document decides; where it is silent or torn, that of the corpus; where that is silent too, the
lists of known abbreviations. After an abbreviation a common word begins a sentence and a name
does not; where nothing is known of that word, the kind of the abbreviation decides. Then each
block is cut, with terminator rules for each script.

Edge cases: null and blank texts give no unit; rows repeated whole count once; a text of any
length is one row of one task; null offsets count from 0; no rows: an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# Abbreviations without their last period, lower case; only kinds that evidence can hardly settle:
# titles (names follow, seen once), "no." (also a word), those before capitalised words, and those that may close a sentence.
TITLES = frozenset("dr mr mrs ms prof rev st sr sra srta hr fr mme κ δρ г-н г-жа डॉ श्री د".split())
REFERENCES = frozenset(["no"])
JOINING = frozenset("bzw lt vs z".split())
CLOSING = frozenset("etc usw a.m p.m inc corp ltd co llc plc jr bros".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", '"': '"', "‹": "›", "‘": "’"}
CLOSERS = set("".join(OPEN.values()))
STOPS = ".!?…。！？।॥؟．｡"
WIDE_STOPS = "。！？｡"
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+\S")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?=\S)")
_WORD_STARTS = frozenset("([{«„“「『（\"'‘")
_WORD = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*")
_SHAPE = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_FOLLOWS = re.compile(r"[^\s.,;:!?]+")
_DIGIT = re.compile(r"\d")
LISTED = TITLES | REFERENCES | JOINING | CLOSING
_THAI = re.compile(r"[฀-๿]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
# Japanese particles and connectives that carry a sentence on after a quotation.
_CARRY_ON = re.compile(r"(?:と|って|という|など|の|を|は|が|に|で)")


def _lower_start(text: str, at: int) -> bool:
    """The word at ``at`` begins in lower case (and is not written like pH)."""
    ch = text[at : at + 1]
    return ch.islower() and not text[at + 1 : at + 2].isupper()


def _word_before(text: str, start: int, end: int) -> str:
    k = end
    while k > start and not text[k - 1].isspace() and text[k - 1] not in _WORD_STARTS:
        k -= 1
    return text[k:end]


def _capitalised(word: str) -> bool:
    return word[:1].isupper() and not word[1:].isupper()


def evidence(text: str) -> list:
    """(is_name, word, yes, no, asked) of each word of a text.

    For abbreviations (is_name false) yes counts periods after the word that surely end nothing (a
    lower-case word or a comma follows) or hardly do (a number follows), no its occurrences without
    one, asked the ambiguous ones. For the words after those, yes counts
    capitals in mid-sentence, no the occurrences in lower case.
    """
    seen: dict = {}

    def add(is_name: bool, word: str, what: int) -> None:
        seen.setdefault((is_name, word), [0, 0, 0])[what] += 1

    for m in _WORD.finditer(text):
        word, at, end = m.group(), m.start(), m.end()
        low = word.lower()
        if word[0].islower():
            add(True, low, 1)
        elif at > 1 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2] == ","):
            add(True, low, 0)
        if at and text[at - 1] == ".":
            continue
        if text[end : end + 1] != ".":
            if text[end : end + 1] in ("", ",") or text[end].isspace():
                add(False, low, 1)
            continue
        k = end + 1
        while k < len(text) and text[k].isspace():
            k += 1
        if k == len(text) or (at > 1 and text[at - 1].isspace() and text[at - 2].isdigit()):
            continue  # a unit after its number may well end a sentence
        if text[end + 1] == "," or (k > end + 1 and _lower_start(text, k)):
            add(False, low, 0)
        elif k > end + 1:
            after = _FOLLOWS.match(text, k)
            add(False, low, 2)
            if after and after.group()[0].isdigit():
                add(False, low, 0)
            elif after and _capitalised(after.group()):
                add(True, after.group().lower(), 2)
    return [(n, w, *counts) for (n, w), counts in seen.items()]


SHORT = 3


class Known:
    """What the evidence says in a document: words that are abbreviations or plain, words that are names or common."""

    __slots__ = ("abbreviations", "plain", "names", "common")

    def __init__(self, told=()):
        self.abbreviations, self.plain, self.names, self.common = set(), set(), set(), set()
        for is_name, word, yes in told:
            (self.names if is_name and yes else self.common if is_name else self.abbreviations if yes else self.plain).add(word)


NOTHING = Known()


def _matching(text: str, start: int, end: int) -> dict:
    """Place of each opening quote or bracket of the paragraph, to that of its closing one."""
    pairs, stack = {}, []
    for i in range(start, end):
        ch = text[i]
        if stack and ch in OPEN[text[stack[-1]]]:
            pairs[stack.pop()] = i
        elif ch in OPEN:
            if ch in "‘" or (ch == '"' and i > start and text[i - 1].isalnum()):
                continue
            stack.append(i)
        elif ch in CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if ch in OPEN[text[stack[k]]]:
                    pairs[stack[k]] = i
                    del stack[k:]
                    break
    return pairs


def _period_breaks(text: str, start: int, i: int, nxt: int, known: Known) -> bool:
    """Whether the period at ``i``, followed by blanks and a non-lower-case word at ``nxt``, ends a sentence."""
    word = _word_before(text, start, i)
    low = word.lower()
    if len(word) == 1 and word.isalpha() and word.isupper():
        return False  # an initial
    follows = _FOLLOWS.match(text, nxt)
    after = follows.group() if follows else ""
    if word.isdigit():
        return after.lower() not in MONTHS
    listed = low if low in LISTED else ""
    numeric = bool(_DIGIT.search(after))
    if low in known.plain and not numeric:
        return True
    if low not in known.abbreviations and not listed and not _SHAPE.fullmatch(word):
        return True
    # An abbreviation. What follows decides, by evidence first, then by the kind of abbreviation.
    if _capitalised(after) and after.lower() in known.common and low not in TITLES:
        return True
    if _capitalised(after) and after.lower() in known.names and low not in CLOSING:
        return False
    if listed in CLOSING:
        return not (low == "co" and after in ("KG", "KGaA", "OHG"))
    if listed in REFERENCES:
        return not numeric
    if listed or _SHAPE.fullmatch(word):
        return False
    return after[:1].isupper() and not numeric


def cut_paragraph(text: str, start: int, end: int, known: Known) -> list:
    """(start, end) of the sentences within one paragraph."""
    units = []
    pairs = _matching(text, start, end)
    opened_at = {v: k for k, v in pairs.items()}
    thai = bool(_THAI.search(text, start, end))
    greek = bool(_GREEK.search(text, start, end))
    begin, i = start, start

    def skip(k):
        while k < end and text[k].isspace():
            k += 1
        return k

    def push(a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            units.append((a, b))

    begin = i = skip(start)
    while i < end:
        ch = text[i]
        if i in pairs and pairs[i] < end:
            close = pairs[i]
            inner = close - 1
            while inner > i and text[inner].isspace():
                inner -= 1
            at_start = skip(begin) == i
            ended = text[inner] in STOPS
            i = close + 1
            if not (at_start and ended):
                if ended and i < end and text[i : i + 1].isspace() and not at_start:
                    # a quotation at the end of its sentence closes it too
                    nxt = skip(i)
                    if nxt < end and not _lower_start(text, nxt) and text[nxt] not in ",;:—–-" and (text[nxt].isupper() or text[nxt] in OPEN):
                        push(begin, i)
                        begin = i = nxt
                continue
            while i < end and text[i] in CLOSERS and i not in pairs:
                i += 1
            nxt = skip(i)
            if nxt >= end:
                break
            nc = text[nxt]
            if nxt == i:
                if nc in STOPS or nc in ",，、;；:：" or _CARRY_ON.match(text, nxt) or nc.islower():
                    continue
                if ord(nc) < 0x2E80 and nc not in OPEN and text[inner] not in WIDE_STOPS:
                    continue
            elif _lower_start(text, nxt) or nc in ",;:—–-،":
                continue
            push(begin, i)
            begin = i = nxt
            continue
        stop = ch in STOPS or (ch in ";;" and greek)
        if thai and ch.isspace():
            push(begin, i)
            begin = i = skip(i)
            continue
        if not stop:
            i += 1
            continue
        j = i + 1
        while j < end and (text[j] in STOPS or (text[j] in CLOSERS and j not in pairs and j not in opened_at)):
            j += 1
        nxt = skip(j)
        if nxt >= end:
            break
        run = text[i:j]
        if nxt == j:
            # no blank follows: only full-width stops and the danda end a sentence here
            if ch in WIDE_STOPS or ch in "।॥؟":
                if text[nxt] not in ",，、)）]】」』”":
                    push(begin, j)
                    begin = nxt
            i = j
            continue
        if _lower_start(text, nxt) or text[nxt] in ",;:،":
            ends = False
        elif text[nxt] in "—–" and not (nxt + 1 < end and text[nxt + 1].isupper()):
            ends = False
        elif run == ".":
            ends = _period_breaks(text, begin, i, nxt, known)
        else:
            ends = True
        if ends:
            push(begin, j)
            begin = i = nxt
        else:
            i = j
    push(begin, end)
    return units


def cut_block(text: str, known: Known = NOTHING) -> list:
    """(start, end) of the sentence units of a block; headings and list items begin units of their own."""
    units, para, at = [], None, 0

    def flush(end):
        nonlocal para
        if para is not None:
            units.extend(cut_item(para, end))
            para = None

    def cut_item(a, b):
        m = _ITEM.match(text, a, b)
        if not m:
            return cut_paragraph(text, a, b, known)
        rest = cut_paragraph(text, m.end(), b, known)
        lead = a + len(text[a:b]) - len(text[a:b].lstrip())
        return [(lead, rest[0][1]), *rest[1:]] if rest else [(lead, m.end())]

    for line in re.split(r"(?<=\n)", text):
        body = line.rstrip("\r\n")
        if not body.strip():
            flush(at)
        elif _HEADING.match(body):
            flush(at)
            lead = len(body) - len(body.lstrip())
            units.append((at + lead, at + len(body.rstrip())))
        elif _ITEM.match(body):
            flush(at)
            para = at
        elif para is None:
            para = at
        at += len(line)
    flush(at)
    return [(a, b) for a, b in units if b > a]


_EVIDENCE = ArrayType(StructType([StructField("is_name", BooleanType()), StructField("word", StringType()), *[StructField(c, IntegerType()) for c in ("yes", "no", "asked")]]))
_UNITS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


@F.pandas_udf(_EVIDENCE)
def _evidence_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: evidence(t) if t else [])


@F.pandas_udf(_UNITS)
def _units_udf(s: pd.Series, told: pd.Series) -> pd.Series:
    return pd.Series([cut_block(t, Known((e["is_name"], e["word"], e["yes"]) for e in k) if k is not None else NOTHING) if t else [] for t, k in zip(s, told)])


def _told(yes: Column, no: Column, least_no: int) -> Column:
    """True, false or null (silent or torn) of the evidence of one document."""
    return F.when((yes > 0) & (yes >= 2 * no), True).when((no >= least_no) & (no >= 2 * yes), False)


def decisions(rows: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, told: (is_name, word, yes) of the words asked about in a document that its own evidence or that of the corpus decides.

    A document speaks against an abbreviation with two plain occurrences; the corpus speaks with
    ``least`` occurrences of one kind to one of the other, and against an abbreviation with four
    times as many; a word of up to SHORT letters that never stands without a period is one too.
    """
    seen = (
        rows.select("doc_id", F.explode(_evidence_udf("text")).alias("e"))
        .groupBy("doc_id", F.col("e.is_name").alias("is_name"), F.col("e.word").alias("word"))
        .agg(*[F.sum(F.col(f"e.{c}")).cast(LongType()).alias(c) for c in ("yes", "no", "asked")])
    )
    yes, no = F.col("all_yes"), F.col("all_no")
    enough = F.when(F.col("is_name"), least).otherwise(4 * least)
    always_dotted = ~F.col("is_name") & (no == 0) & (F.col("all_asked") >= 2 * least) & (F.length("word") <= SHORT)
    corpus = (
        seen.groupBy("is_name", "word")
        .agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"), F.sum("asked").alias("all_asked"))
        .where("all_asked > 0")
        .select("is_name", "word", F.when(((yes >= least) & (yes >= least * no)) | always_dotted, True).when((no >= enough) & (no >= least * yes), False).alias("corpus"))
        .where("corpus is not null")
    )
    own = F.when(F.col("is_name"), _told(F.col("yes"), F.col("no"), 1)).otherwise(_told(F.col("yes"), F.col("no"), 2))
    asked = seen.where("asked > 0").select("doc_id", "is_name", "word", own.alias("own")).join(corpus, ["is_name", "word"], "left")
    decided = asked.select("doc_id", "is_name", "word", F.coalesce("own", "corpus").alias("yes")).where("yes is not null")
    return decided.groupBy("doc_id").agg(F.collect_list(F.struct("is_name", "word", "yes")).alias("told"))


def sentence_units(rows: DataFrame) -> DataFrame:
    """rows: sentence_id, doc_id, char_start, text. Returns sentence_id, char_start, char_end of every unit."""
    rows = rows.select("sentence_id", "doc_id", "char_start", "text").where(F.col("text").rlike("\\S")).distinct()
    units = rows.join(decisions(rows), "doc_id", "left").select("sentence_id", F.coalesce("char_start", F.lit(0)).alias("s"), F.explode(_units_udf("text", "told")).alias("u"))
    return units.select("sentence_id", (F.col("s") + F.col("u.a")).cast("int").alias("char_start"), (F.col("s") + F.col("u.b")).cast("int").alias("char_end")).distinct()
