"""Identifier terms, token estimates, clipping and redaction, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import folded

IDENTIFIER = r"[A-Za-z_$][\p{L}\p{N}_$]*"


def _parts(word: Column) -> Column:
    """Snake, camel and acronym parts, folded; only ASCII letters tell where a part starts."""
    spaced = F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(folded(spaced), r"[ _$]+"), lambda p: p != "")


def identifier_terms(text: Column) -> Column:
    """Distinct identifiers as they are spelt, then their snake, camel and acronym parts, in order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.concat(F.array(w), _own_parts(w)))))


def _own_parts(word: Column) -> Column:
    """_parts(), by a shorter way for a word without a mark or a capital inside: it is one part."""
    plain = F.when(word.rlike("^[A-Za-z][a-z0-9]*$"), F.array(F.lower(word)))
    return plain.when(word.rlike("^[^_$][^A-Z_$]*$"), F.array(folded(word))).otherwise(_parts(word))


def identifiers(text: Column) -> Column:
    """Every occurrence of an identifier, as it is spelt."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def search_terms(identifier: Column) -> Column:
    """The distinct folded terms of one identifier: itself and its parts. One without a mark or a capital inside has
    no other part than itself, and ASCII letters fold to their lower case."""
    several = F.array_distinct(F.concat(F.array(folded(identifier)), _parts(identifier)))
    plain = F.when(identifier.rlike("^[A-Za-z][a-z0-9]*$"), F.array(F.lower(identifier)))
    return plain.when(identifier.rlike("^[^_$][^A-Z_$]*$"), F.array(folded(identifier))).otherwise(several)


def word_set(text: Column) -> Column:
    """Distinct folded ASCII words of three letters or more, camel case split."""
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z][A-Za-z0-9]{2,}"), F.lit(0)), F.lower))


def quoted_literals(text: Column) -> Column:
    """Distinct strings of 1 to 96 characters between two quotes of one kind, in order."""
    found = F.regexp_extract_all(text, F.lit("'[^'\"\\n]{1,96}'|\"[^'\"\\n]{1,96}\""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.substring(m, 2, 96).substr(F.lit(1), F.length(m) - 2)))


def rough_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def safe_tokens(text: Column) -> Column:
    return F.greatest(rough_tokens(text), F.octet_length(text))


def clipped(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last line end inside if there is one."""
    head = F.substring(text, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.length(text) <= limit, text).when(head.contains("\n"), whole).otherwise(head)


def redacted(text: Column) -> Column:
    """Long hex ids, UUIDs, URLs and secrets replaced; control characters as one space."""
    out = F.regexp_replace(text, r"https?://[^\s]+", "[link]")
    out = F.regexp_replace(out, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[id]")
    out = F.regexp_replace(out, r"[0-9a-fA-F]{32,}", "[id]")
    out = F.regexp_replace(out, r"(?i)(token|password|secret|key) ?[=:] ?\"?[^\s\"]+\"?", "$1=[secret]")
    return F.regexp_replace(out, r"[\x00-\x1f\x7f]+", " ")


# How published prose names revisions, ids and links.
REVISIONS = {"PR_HEAD": "This PR", "TARGET_BASE": "the base revision", "MERGE_BASE": "the merge base"}
LONG_ID = r"\b[0-9a-fA-F]{32,}\b|\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
LINK = r"(?i)\b(?:https?|ftp|file|data|javascript):\S+|\bwww\.\S+"
CONTROL = "[\\x00-\\x1f\\x7f\u202a-\u202e\u2066-\u2069]"
MARKUP = r"([\\`*_{}\[\]()#+.!|~:/-])"


def prose(text: Column, limit: int = 240) -> Column:
    """Model or source prose as literal Markdown: ids and links replaced, white space collapsed, cut after the
    last whole word that fits, then escaped."""
    out = F.replace(text, F.lit("`"), F.lit(""))
    for name, shown in REVISIONS.items():
        out = F.replace(out, F.lit(name), F.lit(shown))
    out = F.regexp_replace(out, LONG_ID, "internal reference")
    out = F.regexp_replace(out, LINK, "unverified link omitted")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, CONTROL, " "), r"[\s\x{85}\p{Z}]+", " "))
    head = F.substring(out, 1, limit)
    cut = F.regexp_replace(F.regexp_replace(head, r"^(.*) [^ ]*$", "$1"), "[.,;:]+$", "")
    out = F.when(F.length(out) > limit, F.concat(cut, F.lit("\u2026"))).otherwise(out)
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("@", "\uff20")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return F.regexp_replace(out, MARKUP, r"\\$1")


def occurrences(text: Column, needle: Column) -> Column:
    """How often a needle occurs without overlap; an empty needle never does."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


# Content types by suffix.
MIME = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def title_of(file_name: Column) -> Column:
    """A readable title from a file name: the stem with spaces, in title case where it has only one case."""
    stem = F.regexp_extract(F.regexp_extract(file_name, r"([^/]*)$", 1), r"^(.+?)(?:\.[^.]*)?$", 1)
    plain = F.trim(F.regexp_replace(stem, r"[-_\s]+", " "))
    one_case = ((plain == F.lower(plain)) | (plain == F.upper(plain))) & plain.rlike(r"\p{L}")
    return F.when(plain == "", "Untitled ADR").when(one_case, F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda w: F.initcap(F.lower(w))), "")).otherwise(plain)


def safe_file_name(file_name: Column) -> Column:
    """The last part of a path without control characters and slashes."""
    plain = F.trim(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)/*$", 1), r"[\x00-\x1f\x7f/\\]", ""))
    return F.when(plain == "", "document.txt").otherwise(plain)


def mime_type(suffix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(suffix)), F.lit("application/octet-stream"))


def fenced_json(text: Column) -> Column:
    """What stands in the first code fence of a model's answer, or the whole answer."""
    plain = F.trim(text)
    fence = r"```(?:json)?\s*([\s\S]*?)\s*```"
    return F.when(plain.rlike(fence), F.trim(F.regexp_extract(plain, fence, 1))).otherwise(plain)


def code_link(base: Column, repository: Column, sha: Column, path: Column, first: Column, last: Column) -> Column:
    """Link to lines of a file at a revision; null where repository, revision, path or lines are not valid."""
    good = repository.rlike("^[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+$") & ~F.substring_index(repository, "/", -1).isin(".", "..") & sha.rlike("^[0-9a-f]{40}$") & (F.length(path).between(1, 1000)) & ~path.rlike(r"^[/\\]|\\|(^|/)\.\.?(/|$)") & (first >= 1) & (last >= first)
    return F.when(good, F.concat(base, F.lit("/"), repository, F.lit("/blob/"), sha, F.lit("/"), path, F.lit("#L"), first, F.lit("-L"), last))


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; a last line end starts no further line."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\n"))


def numbered(text: Column) -> Column:
    """Every line with its number before it."""
    return F.array_join(F.transform(lines_of(text), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)), "\n")


def span_place(text: Column, start: Column, end: Column) -> Column:
    """(start_line, end_line, start_column, end_column) of the characters from start to before end; lines
    count from 1, columns from 0, and an end at a line's end has no column. Null for a span outside."""
    before = F.substring(text, F.lit(1), start)
    inside = F.substring(text, F.lit(1), end - 1)
    line = lambda part: (F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).cast("int")
    column = lambda part: F.length(F.substring_index(part, "\n", -1))
    whole = (F.substring(text, end, F.lit(1)) == "\n") | (end == F.length(text))
    place = F.struct((line(before) + 1).alias("start_line"), (line(inside) + 1).alias("end_line"), column(before).alias("start_column"), F.when(~whole, column(inside) + 1).alias("end_column"))
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), place)


def quote_place(excerpt: Column, quote: Column) -> Column:
    """(state, start, end): where a quote stands; FOUND only if it does once, even with itself overlapping."""
    start = F.call_function("instr", excerpt, quote)
    again = F.call_function("instr", F.substring(excerpt, start + 1, F.length(excerpt)), quote) > 0
    state = F.when(F.length(quote) == 0, "QUOTE_NOT_FOUND").when(start == 0, "QUOTE_NOT_FOUND").when(again, "QUOTE_AMBIGUOUS").otherwise("FOUND")
    return F.struct(state.alias("state"), F.when(state == "FOUND", start - 1).alias("start"), F.when(state == "FOUND", start - 1 + F.length(quote)).alias("end"))


def trimmed_change(old: Column, new: Column, around: int = 2, most: int = 16) -> Column:
    """(prefix, suffix, old, new) of two arrays of lines: how many lines both begin and end with, and what
    lies between on each side, with `around` lines of context and at most `most` lines in all."""
    least = F.least(F.size(old), F.size(new))
    same = lambda a, b: F.array_position(F.transform(F.slice(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), 1, least), lambda v: ~v), True)
    ahead = lambda a, b: F.when(same(a, b) == 0, least).otherwise(same(a, b) - 1).cast("int")
    prefix = ahead(old, new)
    suffix = F.least(ahead(F.reverse(old), F.reverse(new)), least - prefix)
    start = F.greatest(prefix - around, F.lit(0))
    part = lambda a: F.slice(a, start + 1, F.least(F.lit(most), F.least(F.size(a), F.size(a) - suffix + around) - start))
    return F.struct(prefix.alias("prefix"), suffix.cast("int").alias("suffix"), part(old).alias("old"), part(new).alias("new"))
