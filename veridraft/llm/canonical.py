"""The consistent form of a text: one spelling for everything that looks the same.

Every character becomes the plain one that looks the same (in the script of the word around
it), unseen characters are dropped, runs of blanks become one space and blanks at the ends go.
Case, accents, raised or lowered digits and visibly different punctuation are kept.

``consistent_form`` is the column expression. Most rows never leave the JVM: only rows holding a
character outside a plain set are sent, as Arrow batches, to the Python rule.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of two scripts that look the same, first the Cyrillic or Greek letter,
# then the Latin one.
CYRILLIC_LATIN = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw".split()
)
GREEK_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo νv ρp".split()

# Characters that take no ink beyond those of category Cf and Cc.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
# Hyphens that look like the ASCII one.
HYPHENS = "‐‑"

TO_LATIN = {p[0]: p[1] for p in CYRILLIC_LATIN + GREEK_LATIN}
FROM_LATIN = {
    "C": {p[1]: p[0] for p in CYRILLIC_LATIN},
    "G": {p[1]: p[0] for p in GREEK_LATIN},
}
_SAME_SHAPE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")
_BLANKS = re.compile(r" +")

# A character that may have another consistent form, alone or beside others. The rest is its own.
_ODD = re.compile(
    "[^\x20-\x7E¡-§©«¬®°-³¶·¹»¿-ıĴ-ľŁ-ňŊ-ž"
    "‒-―‘-„•…‰€₀-₉™、。「-』ぁ-ゖァ-ー一-鿿]|  |^ | $"
)
#: Java pattern: ASCII characters without ink that are no blank.
_CONTROL = "[\\x00-\\x08\\x0E-\\x1B\\x7F]"
_NO_INK = re.compile(_CONTROL)
BLANK_RUN = "[\\t\\n\\u000B\\f\\r\\u001C-\\u001F\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def script_of(ch: str) -> str:
    """``L``, ``C`` or ``G`` for Latin, Cyrillic and Greek letters, else an empty string."""
    o = ord(ch)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C" if ch.isalpha() else ""
    return "L" if (o < 0x250 or 0x1E00 <= o < 0x1F00) and ch.isalpha() else ""


def plain_char(ch: str) -> str:
    """What one character becomes without looking at its neighbours (may be several, or none)."""
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\x0b\x0c\r\x85\x1c\x1d\x1e\x1f":
        return " "
    if cat in ("Cf", "Cc") or 0xFE00 <= ord(ch) <= 0xFE0F or ch in UNSEEN:
        return ""
    if ch in HYPHENS:
        return "-"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in _SAME_SHAPE_TAGS and ch != "…" and not rest.startswith("0020"):
        return "".join(plain_char(chr(int(x, 16))) for x in rest.split())
    return ch


class _PlainChars(dict):
    """Table for str.translate: :func:`plain_char`, worked out where a character is first met."""

    def __missing__(self, o: int) -> str:
        self[o] = plain_char(chr(o))
        return self[o]


_PLAIN = _PlainChars()
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")


def is_anchor(ch: str, script: str) -> bool:
    """Whether a letter has a shape only its own script has."""
    if script == "L":
        return ch not in FROM_LATIN["C"] and ch not in FROM_LATIN["G"]
    return ch not in TO_LATIN


def in_script(ch: str, script: str, target: str) -> str:
    """The letter of ``target`` that looks like ``ch``; ``ch`` where there is none."""
    if not script or script == target:
        return ch
    latin = ch if script == "L" else TO_LATIN.get(ch)
    if latin is None:
        return ch
    return latin if target == "L" else FROM_LATIN[target].get(latin, ch)


@functools.lru_cache(maxsize=50_000)
def _letters(word: str) -> tuple:
    """Of a word: the scripts of its characters, its letters and its anchors by script."""
    scripts = tuple(map(script_of, word))
    return scripts, Counter(s for s in scripts if s), Counter(s for c, s in zip(word, scripts) if s and is_anchor(c, s))


@functools.lru_cache(maxsize=50_000)
def _in_one_script(word: str, main: str) -> str:
    """A word in the script that fits it; ``main`` is the script of the text around it."""
    scripts, letters, own = _letters(word)
    if not letters or (len(letters) == 1 and own):
        return word
    fits = [s for s in "LCG" if all(not a or script_of(in_script(c, a, s)) == s for c, a in zip(word, scripts))]
    to = max(fits, key=lambda s: (s == main, letters[s])) if fits else max("LCG", key=lambda s: (own[s], letters[s], s == main))
    return "".join(in_script(c, s, to) for c, s in zip(word, scripts))


def canonical_text(text: str) -> str:
    """The consistent form of one text, in plain Python."""
    if text.isascii():
        return " ".join((text if text.isprintable() else _NO_INK.sub("", text)).split())
    if not _ODD.search(text):
        return text
    t = unicodedata.normalize("NFD", text.translate(_PLAIN))
    t = _BLANKS.sub(" ", t).strip(" ")
    if not _OTHER_SCRIPT.search(t):
        return unicodedata.normalize("NFC", t)
    anchors = dict.fromkeys("LCG", 0)
    for w in _WORD.findall(t):
        for s, n in _letters(w)[2].items():
            anchors[s] += n
    main = max("LCG", key=anchors.__getitem__)
    return unicodedata.normalize("NFC", _WORD.sub(lambda m: _in_one_script(m.group(), main), t))


@F.pandas_udf(StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_text, na_action="ignore")


def blanks_collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def is_suspect(text: Column) -> Column:
    """Rows that the blank rule alone may not bring to their form."""
    return (F.octet_length(text) > F.length(text)) | text.rlike(_CONTROL)


def consistent_form(text: Column) -> Column:
    """Column expression of :func:`canonical_text`; null stays null."""
    odd = is_suspect(text)
    return F.when(odd, _canonical_udf(F.when(odd, text))).otherwise(blanks_collapsed(text))


def words(form: Column) -> Column:
    """The words of a consistent form, in order: runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(form), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
