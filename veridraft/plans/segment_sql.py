"""Markdown segmentation as SQL, line by line with window functions: an independent second way to the same sentences and paragraphs."""

from __future__ import annotations

WS = "\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_H = "[\\t\\x1f \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]*"
_NL = "\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}"
_MARK, _GAP = "chr(64976)", "chr(64978)"


def _unmark(t: str, abbreviations: list) -> str:
    words = "|".join(a.replace(".", "\\.") for a in abbreviations)
    return f"regexp_replace({t}, '((?:^|[{WS}\\x{{FDD0}}(\\[\"''])(?i:{words})\\.+[\"'')\\]]?[{WS}]+)\\x{{FDD0}}', '\\1', 'g')"


def sentences(source: str, abbreviations: list, prefix: str = "") -> str:
    """Common table expressions, from ``source`` (a query of doc_id, text) to {prefix}s: doc_id, ordinal, text, char_start, char_end, line."""
    p = prefix
    marked = f"regexp_replace(t, '([.!?][\"'')\\]]?[{WS}]+)([\"''(\\[]?[A-Z0-9])', '\\1' || {_MARK} || '\\2', 'g')"
    return f"""
{p}d AS ({source}),
{p}l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^{_NL}]*(?:\\r\\n|[{_NL}])|[^{_NL}]+') AS ls FROM {p}d WHERE text IS NOT NULL)),
{p}f AS (SELECT *, regexp_matches(line, '^{_H}(?:```|~~~)') AS fence, regexp_matches(line, '^(?:#{{1,6}}[{WS}]|{_H}(?:[-*+]|[0-9]+[.)])[{WS}])') AS single,
  regexp_full_match(line, '{_H}(?:\\r\\n|[{_NL}])') AS blank FROM {p}l),
{p}g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM {p}f),
{p}c AS (SELECT *, fence OR n % 2 = 1 AS code FROM {p}g),
{p}w AS (SELECT *, lag(code) OVER (PARTITION BY doc_id ORDER BY i) AS was_code, lag(single) OVER (PARTITION BY doc_id ORDER BY i) AS was_single FROM {p}c),
{p}b AS (SELECT *, sum(CASE WHEN was_code IS NULL OR code <> was_code OR single OR blank OR (was_single AND NOT was_code) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM {p}w),
{p}k AS (SELECT doc_id, block, min(ofs) AS ofs, string_agg(line, '' ORDER BY i) AS t FROM {p}b WHERE NOT code GROUP BY doc_id, block),
{p}m AS (SELECT doc_id, block, ofs, string_split({_unmark(_unmark(marked, abbreviations), abbreviations)}, {_MARK}) AS ps FROM {p}k),
{p}e AS (SELECT doc_id, block, ofs, unnest(ps) AS raw, generate_subscripts(ps, 1) AS j FROM {p}m),
{p}o AS (SELECT *, ofs + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, block ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(regexp_extract(raw, '^[{WS}]*')) AS start,
  regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS body FROM {p}e),
{p}s AS (SELECT x.doc_id, (row_number() OVER (PARTITION BY x.doc_id ORDER BY start) - 1)::INT AS ordinal, body AS text, start::INT AS char_start, (start + length(body))::INT AS char_end,
  (1 + length(left(d.text, start::BIGINT)) - length(replace(left(d.text, start::BIGINT), chr(10), '')))::INT AS line FROM {p}o x JOIN {p}d d USING (doc_id) WHERE body <> '')"""


def paragraphs(source: str, prefix: str = "") -> str:
    """Common table expressions from ``source`` (a query of doc_id, text) to {prefix}p: doc_id, start, stop."""
    p = prefix
    line_start = f"(^|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])(#{{1,6}}[{WS}]|[-*+][{WS}]|[0-9]+[.)][{WS}])"
    split = f"regexp_replace(regexp_replace(raw, '{line_start}', '\\1' || {_MARK} || '\\2', 'g'), '{line_start.replace('(^|', '(').replace('])(', '])(', 1)}', '\\1' || {_MARK} || '\\2', 'g')"
    return f"""
{p}q AS (SELECT doc_id, string_split(regexp_replace(text, '(\\r?\\n[{WS}]*\\r?\\n+)', {_MARK} || {_GAP} || '\\1' || {_MARK}, 'g'), {_MARK}) AS cs FROM ({source}) WHERE regexp_matches(text, '[^{WS}]')),
{p}r AS (SELECT doc_id, unnest(cs) AS raw, generate_subscripts(cs, 1) AS i FROM {p}q),
{p}t AS (SELECT doc_id, i, CASE WHEN starts_with(raw, {_GAP}) THEN [raw] ELSE string_split({split}, {_MARK}) END AS ps FROM {p}r),
{p}u AS (SELECT doc_id, i, unnest(ps) AS raw, generate_subscripts(ps, 1) AS j FROM {p}t),
{p}v AS (SELECT *, starts_with(raw, {_GAP}) AS gap, length(raw) - starts_with(raw, {_GAP})::INT AS n FROM {p}u),
{p}x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {p}v),
{p}p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS paragraph, start::INT AS start, (start + n)::INT AS stop FROM {p}x WHERE NOT gap AND raw <> '')"""
