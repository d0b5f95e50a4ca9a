"""Scalar text functions as column expressions (all within the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters in the sense of Python's str.
WS = "\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode blanks at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def normalize_sentence(c: Column) -> Column:
    """Stripped, lower case, blanks collapsed, without final ``.!?``."""
    flat = F.regexp_replace(F.lower(strip(c)), f"[{WS}]+", " ")
    return F.regexp_replace(flat, "[.!?]+\\z", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != ""))


_FRONT = f"\\A---[{WS}]*\\n(?s:.*?)\\n---[{WS}]*\\n"


def front_matter(c: Column) -> Column:
    """The front matter of a text, its fences included ('' without one)."""
    return F.regexp_extract(c, f"({_FRONT})", 1)


def strip_front_matter(c: Column) -> Column:
    return F.substring(c, F.length(front_matter(c)) + 1, F.length(c))


def ellipsis(c: Column, size: int = 120) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def score_text(c: Column, size: int = 1800) -> Column:
    """What a model scores: the first ``size`` characters (the rule of the gate, not a shortcut)."""
    return F.substring(c, 1, size)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def rewriter_prompt(name: Column, text: Column) -> Column:
    return F.concat(F.lit("remove "), F.lower(name), F.lit(": "), text)


def json_array_slice(c: Column) -> Column:
    """From the first ``[`` to the last ``]``, parsed to (positive, rewrite) pairs; null where it is no such array."""
    return F.from_json(F.regexp_extract(c, "(?s)(\\[.*\\])", 1), "array<struct<positive:string,rewrite:string>>")


def report_line(file: Column, line: Column, name: Column, confidence: Column, text: Column) -> Column:
    return F.format_string("%s:%d: [%s, %.2f] %s", file, line, name, confidence, text)


def paragraph_texts(c: Column) -> Column:
    """The paragraphs of a text as strings: cut at blank lines and before headings and list items, whose markers go with the cut."""
    chunks = F.transform(F.split(c, f"\\r?\\n[{WS}]*\\r?\\n+"), strip)
    parts = F.flatten(F.transform(chunks, lambda p: F.split(p, f"(?m:^)(?:#{{1,6}}[{WS}]|[-*+][{WS}]|\\d+[.)][{WS}])")))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def now_iso() -> Column:
    """The time of the query in UTC, ISO 8601 (one value for all rows)."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def change_count(line: Column) -> Column:
    """Number of places in a line of a change log: the last word within its last parenthesis, 1 without one."""
    told = F.element_at(F.split(F.regexp_extract(line, "\\(([^(]*?)\\)*\\z", 1), f"[{WS}]+"), -1)
    return F.when(line.contains("("), told.cast("int")).when(line.isNotNull(), F.lit(1))
