"""Files to chunks by a splitter that the file's plan names: a table function, joined laterally.

A plan names a strategy and a language. Markdown is cut at its headings, outside of fenced code; source code at the
declarations that start a line, with the comments and decorators right above them; everything else is one chunk. What
stands before the first heading or declaration is a chunk too, and a source without any is one chunk under the
strategy FALLBACK. A chunk above the bound is cut into windows that end after lines where they can. Chunks are the file
from its first character to its last, in order, so no text is lost; a file of white space alone has none.

Defined cases: a null or empty text has no chunks, an unknown or missing strategy is taken whole under its own name or
FALLBACK, a missing or unknown language is split by the declarations of all languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import cut_windows

MOST_BYTES = 24_000
CHUNK = "nth int, strategy string, kind string, start long, end long, start_line int, end_line int, part int"

_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_BLOCK = re.compile(r" {0,3}(?:[>*+-][ \t]|\d+[.)][ \t]|(?:[*_-][ \t]*){3,}$)| {4}|\t")
#: How a declaration begins at the start of a line, by language.
_DECLARES = {
    "python": r"(?:async\s+)?def\s|class\s",
    "js": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|class\s|interface\s|enum\s|type\s+\w+\s*=|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function\b|\(|\w+\s*=>))",
    "go": r"func\s|type\s+\w+\s+(?:struct|interface)\b",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|impl|mod)\b",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|partial|internal)\s+)*(?:class|interface|enum|record|struct|namespace)\s",
    "c": r"(?:struct|class|enum|union|namespace|template)\b|[A-Za-z_][\w\s*&:<>,]*\([^;]*$",
    "ruby": r"(?:def|class|module)\s",
}
_LIKE = {"py": "python", "ts": "js", "tsx": "js", "jsx": "js", "javascript": "js", "typescript": "js", "rs": "rust", "cs": "java", "cpp": "c", "h": "c", "hpp": "c", "rb": "ruby"}
_ABOVE = re.compile(r"\s*(?:@|#|//|/\*|\*|\*/|--)")


def markdown_starts(lines: list[str]) -> list[int]:
    """The lines at which a section starts."""
    out, fence, open_text = [], None, False
    for i, line in enumerate(lines):
        found = _FENCE.match(line)
        if fence:
            if found and found.group(1)[0] == fence[0] and len(found.group(1)) >= len(fence) and not line.strip(" \t\r\n`~"):
                fence = None
            open_text = False
        elif found:
            fence, open_text = found.group(1), False
        elif _HEADING.match(line):
            out.append(i)
            open_text = False
        elif open_text and _UNDERLINE.match(line):
            out.append(paragraph)
            open_text = False
        elif not line.strip() or _BLOCK.match(line):
            open_text = False
        elif not open_text:
            open_text, paragraph = True, i
    return out


def symbol_starts(lines: list[str], language: str | None) -> list[int]:
    """The lines at which a declaration starts, with what belongs to it right above."""
    name = _LIKE.get(language or "", language)
    declares = re.compile("(?:" + (_DECLARES[name] if name in _DECLARES else "|".join(_DECLARES.values())) + ")")
    out = []
    for i, line in enumerate(lines):
        if declares.match(line):
            first = i
            while first and (not out or first - 1 > out[-1]) and _ABOVE.match(lines[first - 1]):
                first -= 1
            out.append(first)
    return out


def split(text: str | None, strategy: str | None, language: str | None, most: int) -> Iterator[tuple]:
    """The chunks of a text as rows of CHUNK; `part` counts the windows of one that was too long."""
    if not text or not text.strip():
        return
    lines = re.split(r"(?<=\n)", text)
    lines = lines[:-1] if lines[-1] == "" else lines
    starts = markdown_starts(lines) if strategy == "MARKDOWN_SECTION" else symbol_starts(lines, language) if strategy == "SYMBOL" else []
    named, kind = strategy or "FALLBACK", "whole"
    if strategy == "SYMBOL" and not starts:
        named = "FALLBACK"
    edges = sorted({0, *starts})
    nth = at = 0
    for edge, after in zip(edges, [*edges[1:], len(lines)], strict=True):
        body = "".join(lines[edge:after])
        if starts:
            kind = ("section" if strategy == "MARKDOWN_SECTION" else "symbol") if edge in starts else "preamble"
        for part, (offset, window) in enumerate(cut_windows(body, most)):
            line = edge + 1 + body.count("\n", 0, offset)
            yield nth, named, kind, at + offset, at + offset + len(window), line, line + window.count("\n") - window.endswith("\n"), part
            nth += 1
        at += len(body)


class _Splitter:
    def eval(self, text: str, strategy: str, language: str, most: int) -> Iterator[tuple]:
        yield from split(text, strategy, language, most)


def chunks(files: DataFrame, text: str, strategy: Column, language: Column, most: int = MOST_BYTES) -> DataFrame:
    """files with one row for each chunk and the columns of CHUNK; positions are characters, `end` is the one after the
    last, lines count from 1. Files without chunks have no row."""
    splitter = F.udtf(_Splitter, returnType=CHUNK)
    rows = files.withColumn("_strategy", strategy).withColumn("_language", language)
    args = [F.col(c).outer() for c in (text, "_strategy", "_language")]
    return rows.lateralJoin(splitter(*args, F.lit(most))).drop("_strategy", "_language")
