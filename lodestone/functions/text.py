"""Column functions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and patterns that results depend on.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if",
    "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this",
    "to", "was", "will", "with",
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"
REDACTED = "<redacted>"

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def redact_pii(text: Column) -> Column:
    """E-mail addresses, then phone numbers."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, REDACTED), PHONE, REDACTED)


def slug(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_links(text: Column) -> Column:
    """Markdown images and links to their texts; images first."""
    plain = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(plain, r"\[([^\]]+)\]\([^)]*\)", "$1")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def escape_xml(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return F.coalesce(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, strip_ansi(text)), F.lit(""))


def sanitize_term(term: Column) -> Column:
    return F.translate(term, "\"':?*^~", "")


def clean_header(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part, r"^\s*#+\s*", ""), r"^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def highlight(text: Column, terms: list[str], before: str = "<m>", after: str = "</m>") -> Column:
    """Marks the terms, longest first, whatever their case."""
    quoted = "|".join(f"\\Q{t}\\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)({quoted})", f"{before}$1{after}") if quoted else text


def contains_literal(column: Column, part: str) -> Column:
    """Case-insensitive substring test; percent and underscore are ordinary characters."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def markdown_table(rows: Column) -> Column:
    """An array of string arrays as a Markdown table; the first row is the header. Ragged rows are padded."""
    width = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.concat_ws(" | ", F.array_repeat(F.lit("---"), width)), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.concat_ws("\n", F.slice(lines, 1, 1), rule, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
