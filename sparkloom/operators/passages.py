"""Passages of texts: sections, windows, line differences, hunks and declarations."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import innermost

MARKDOWN_HEADING = r"(?m)^(?=#{1,6} )"


def sections(text: Column, before: str = MARKDOWN_HEADING) -> Column:
    """The parts of a text that start where the pattern matches; what stands before the first is kept."""
    return F.filter(F.split(text, before), lambda s: s != "")


def cut_windows(text: str, most: int) -> list[tuple[int, str]]:
    """(start, window) pieces of at most `most` UTF-8 bytes, ending after a line end where the second half
    of the piece has one. The windows end to end are the text; start counts characters."""
    out, start = [], 0
    while start < len(text):
        piece = text[start : start + most].encode()[:most].decode("utf-8", "ignore")
        if start + len(piece) < len(text):
            line = piece.rfind("\n")
            piece = piece[: line + 1] if line + 1 > len(piece) // 2 else piece
        out.append((start, piece))
        start += len(piece)
    return out


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 8192) -> DataFrame:
    """(key, nth, start, window) of every text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(k, i, s, w) for k, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True) for i, (s, w) in enumerate(cut_windows(t or "", max(4, most)))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [key, "nth", "start", "window"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, nth int, start long, window string")


def line_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, nth, tag, old_from, old_to, new_from, new_to): how the old lines become the new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in (key, old, new)), strict=True):
                codes = difflib.SequenceMatcher(None, (a or "").splitlines(), (b or "").splitlines(), autojunk=False).get_opcodes()
                rows += [(k, i, *c) for i, c in enumerate(codes)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [key, "nth", "tag", "old_from", "old_to", "new_from", "new_to"])

    return pairs.select(key, old, new).mapInArrow(run, f"{key} long, nth int, tag string, old_from int, old_to int, new_from int, new_to int")


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: Lines with which a patch without hunks may begin.
NO_HUNKS = ("diff --git", "index ", "old mode", "new mode", "similarity index")


def patch_hunks(patch: Column) -> Column:
    """The hunks of a unified diff as (old_start, old_count, new_start, new_count, before, after, error). A
    hunk with another header, a line that is none of a hunk's, or counts that don't match its lines has an
    error; so has one row alone for a text that is no patch."""
    parts = F.split(patch, r"(?m)^(?=@@)")

    def hunk(part: Column) -> Column:
        lines = F.split(F.regexp_replace(part, "\n$", ""), "\n")
        body = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith("\\ No newline"))
        side = lambda sign: F.transform(F.filter(body, lambda x: F.substring(x, 1, 1).isin(" ", sign)), lambda x: F.substring(x, 2, 1 << 30))
        number = lambda i: F.regexp_extract(part, HUNK, i)
        count = lambda i: F.when(number(i) == "", 1).otherwise(number(i).try_cast("int"))
        odd = F.exists(body, lambda x: ~F.substring(x, 1, 1).isin(" ", "+", "-"))
        error = F.when(~part.rlike(HUNK), "UNSUPPORTED_FORMAT").when(odd, "UNEXPECTED_LINE").when((F.size(side("-")) != count(2)) | (F.size(side("+")) != count(4)), "COUNT_MISMATCH")
        return F.struct(number(1).try_cast("int").alias("old_start"), count(2).alias("old_count"), number(3).try_cast("int").alias("new_start"), count(4).alias("new_count"), F.array_join(side("-"), "\n").alias("before"), F.array_join(side("+"), "\n").alias("after"), error.alias("error"))

    found = F.transform(F.filter(parts, lambda p: p.startswith("@@")), hunk)
    known = patch.rlike("(?m)^(?:" + "|".join(NO_HUNKS) + ")")
    none = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("old_start", "old_count", "new_start", "new_count")], *[F.lit(None).cast("string").alias(c) for c in ("before", "after")], F.lit("UNRECOGNIZED").alias("error"))
    return F.when((F.size(found) == 0) & (F.trim(patch) != "") & ~known, F.array(none)).otherwise(found)


def packed_paragraphs(text: Column, most: int = 2500) -> Column:
    """Paragraphs packed into blocks of at most `most` characters, in order, an empty line between two; one
    that is longer is cut into slices first, at the last sentence end of its second half where there is one."""
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), bare), lambda p: p != "")
    start = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("out"))

    def slices(p: Column) -> Column:
        pieces = F.regexp_extract_all(p, F.lit(rf"(?s).{{{most // 2},{most - 1}}}[.!?](?=\s)|.{{1,{most}}}"), F.lit(0))
        return F.when(F.length(p) <= most, F.array(p)).otherwise(F.filter(F.transform(pieces, bare), lambda x: x != ""))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["rest"] == "", p).otherwise(F.concat(acc["rest"], F.lit("\n\n"), p))
        fits = F.length(joined) <= most
        return F.struct(F.when(fits, joined).otherwise(p).alias("rest"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["rest"]))).alias("out"))

    return F.aggregate(F.flatten(F.transform(parts, slices)), start, step, lambda acc: F.when(acc["rest"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["rest"]))))


def declarations(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, qualified name, first line, last line) of a Python module's classes and functions; none
    where it cannot be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node: ast.AST, path: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append(("class" if isinstance(child, ast.ClassDef) else "function", ".".join((*path, child.name)), first, child.end_lineno))
                walk(child, (*path, child.name))
            else:
                walk(child, path)

    walk(tree, ())
    return out


def declared(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, name, first, last): the classes and functions of each Python module, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *d) for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True) for d in declarations(t or "")]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [key, "kind", "name", "first", "last"])

    return sources.select(key, text).mapInArrow(run, f"{key} long, kind string, name string, first int, last int")


def outermost(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (key, first, last) that lie strictly in no other range of their key."""
    one = ranges.select(key, "first", "last").distinct().withColumn("at", F.struct("first", "last"))
    found = innermost(one, one, key, "at", "first", "last", strictly=True).where("inner IS NULL").select(key, "at.first", "at.last")
    return ranges.join(found, [key, "first", "last"], "left_semi").select(*ranges.columns)
