"""Readers and writers: documents, candidate logs, upserts, deletions and immutable snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.ledger import latest

MOST_BYTES = 2 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str | None:
    """Paragraphs of a word-processor file as lines; headings get their marks. None if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            tree = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in tree.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        lines.append("#" * min(level, 6) + " " * (level > 0) + text)
    return "\n".join(lines)


def documents(spark: SparkSession, path: str, glob: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """(path, length, text) of the files below a folder that are no larger than `most` bytes. Text and
    Markdown as UTF-8 with one kind of line end, word-processor files as their paragraphs; others null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = []
            for name, raw in zip(part["path"], part["content"], strict=True):
                if name.lower().endswith(".docx"):
                    texts.append(docx_text(raw))
                elif name.lower().endswith((".md", ".markdown", ".txt", ".rst")):
                    texts.append(raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
                else:
                    texts.append(None)
            yield pd.DataFrame({"path": part["path"], "length": part["length"], "text": texts})

    return files.where(F.col("length") <= most).select("path", "length", "content").mapInPandas(run, "path string, length long, text string")


def last_records(spark: SparkSession, path: str, schema: str, key: str, seq: str) -> DataFrame:
    """An append-only log of JSON lines: the last record of each key wins."""
    return latest(spark.read.schema(schema).json(path), key, seq)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; of several new ones the last by seq."""
    order = Window.partitionBy(*key).orderBy(F.desc("seq"))
    newest = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*old.columns)
    return old.join(newest, key, "left_anti").select(*old.columns).unionByName(newest)


def without(rows: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key is not among the deleted ones."""
    return rows.join(deleted.select(*key).distinct(), key, "left_anti")


def without_orphans(nodes: DataFrame, edges: DataFrame, key: str, *ends: str) -> DataFrame:
    """nodes that an end of some edge still names."""
    used = None
    for end in ends:
        found = edges.select(F.col(end).alias(key))
        used = found if used is None else used.union(found)
    return nodes.join(used.distinct(), key, "left_semi")


def save_snapshot(rows: DataFrame, folder: str, index_id: str) -> str:
    """Write an immutable snapshot; one of the same id is an error, never an overwrite."""
    path = f"{folder}/index_id={index_id}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def load_snapshot(spark: SparkSession, folder: str, index_id: str) -> DataFrame:
    return spark.read.parquet(folder).where(F.col("index_id") == index_id).drop("index_id")


def replaced(old: DataFrame, new: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    """A table after a write that first deletes all rows of its scope (key) and then adds the new ones."""
    return old.join(scope.select(*key).distinct(), key, "left_anti").unionByName(new)


def save_audit(rows: DataFrame, folder: str, run: str) -> None:
    """The audit of a run as JSON lines in a folder of its own; a run is written once, whole or not at all."""
    rows.write.mode("errorifexists").json(f"{folder}/run={run}")
