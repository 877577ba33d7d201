"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a short vector of statistics (shares of character kinds, word and line shape,
repetition), each squashed to a comparable range. Class means and covariances come from sums that the
tasks add up over all labelled rows, so fitting has no sample and no bound on rows. Covariances are
shrunk towards their own diagonal; a score is the logistic of the difference of the two log densities,
computed from Mahalanobis distances with cached Cholesky factors, plus the log ratio of the classes.

Defined cases: a null text counts as empty; an empty text has all statistics zero and gets a score like
any other. With no labelled row of a class the score is the smoothed share of label 1. A document with
several label rows counts once with the largest label. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, filtered, fold, hash_spans, pick, pieces, utf8, word_spans

#: Statistics, in the order of the vector.
NAMES = ("log_words", "letters", "upper", "digits", "symbols", "commas", "white", "high_bytes", "word_length", "word_spread", "distinct_words", "top_word", "repeats", "pair_distinct", "line_words", "entropy", "symbol_words", "upper_words", "distinct_lines")
D = len(NAMES)

_KIND = np.zeros(256, np.uint8)  # 0 other symbols, then as named below
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:'\"-?"]] = 4
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 5
_KIND[128:] = 6


def _per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _distinct(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys and count of the commonest key of each text."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    mixed = np.sort((keys >> np.uint64(24)) | (owner << np.uint64(40)))  # 40 bits tell a text's keys apart
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(mixed)))
    who = (mixed[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(len(at) - 1)
    np.maximum.at(most, who, runs)
    return np.bincount(who, minlength=len(at) - 1).astype(float), most


#: Short texts are noisy: shares start from so many typical characters, words or lines.
_CHARS, _WORDS = 60, 12
_TYPICAL = {"letters": 0.8, "upper": 0.03, "digits": 0.0, "symbols": 0.0, "marks": 0.03, "white": 0.16, "high": 0.03, "length": 5.0, "square": 32.0, "line": 12.0}


def statistics(column: pa.Array) -> np.ndarray:
    """One row of D transformed statistics per text."""
    data, offs = utf8(column)
    kind = np.take(_KIND, data)
    size = np.diff(offs) + float(_CHARS)
    start_with = lambda x, name: x + _TYPICAL[name] * _CHARS
    counts = [_per_text(kind == k, offs) for k in range(7)]
    symbols, lower, upper, digits, marks, white, high = counts
    letters = lower + upper + high
    start, end, at = word_spans(data, offs)
    words = np.diff(at).astype(float)
    some = words + _WORDS
    length = (end - start).astype(float)
    mean = (_per_text(length, at) + _TYPICAL["length"] * _WORDS) / some
    spread = np.sqrt(np.maximum((_per_text(length**2, at) + _TYPICAL["square"] * _WORDS) / some - mean**2, 0))
    keys = hash_spans(np.take(LOWER, data), start, end)
    distinct, top = _distinct(keys, at)
    has = np.diff(at) > 0
    pairs = keys.copy()  # a text's last word stands for itself
    pairs[:-1] = keys[:-1] * np.uint64(3) + keys[1:]
    pairs[at[1:][has] - 1] = keys[at[1:][has] - 1]
    pair_distinct, _ = _distinct(pairs, at)
    again = np.zeros(len(keys))
    again[1:] = keys[1:] == keys[:-1]
    again[at[:-1][has]] = 0
    bad = np.zeros(len(data) + 1)
    np.cumsum(kind == 0, out=bad[1:])
    caps = np.zeros(len(data) + 1)
    np.cumsum(kind == 2, out=caps[1:])
    symbol_words = _per_text(bad[end] > bad[start], at) / some
    upper_words = _per_text((caps[end] - caps[start] >= 2), at) / some
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_at = np.searchsorted(line_start, offs)
    lines = np.diff(line_at) + 1.0
    line_distinct, _ = _distinct(hash_spans(data, line_start, line_end), line_at)
    names = ("symbols", "lower", "upper", "digits", "marks", "white", "high")
    typical = _TYPICAL | {"lower": _TYPICAL["letters"] - _TYPICAL["upper"] - _TYPICAL["high"]}
    share = np.stack([(c + typical[k] * _CHARS) / size for c, k in zip(counts, names, strict=True)], axis=1)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    shares = [start_with(x, k) / size for x, k in ((letters, "letters"), (upper, "upper"), (digits, "digits"), (symbols, "symbols"), (marks, "marks"), (white, "white"), (high, "high"))]
    fewer = lambda x: np.log((x + _WORDS) / some)
    out = np.stack([np.log1p(words), shares[0], *map(root, shares[1:5]), shares[5], shares[6], np.log1p(mean), np.log1p(spread), fewer(distinct), root(np.maximum(top - 1, 0) / some), root(_per_text(again, at) / some), fewer(pair_distinct), np.log((words + _TYPICAL["line"]) / lines), entropy, root(symbol_words), root(upper_words), np.log((line_distinct + 2) / (lines + 1))], axis=1)
    out[np.diff(offs) == 0] = 0
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row of docs: its statistics, far smaller than its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = statistics(batch.column("text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * D)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], ["doc_id", "x"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, D)


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (n, sum, sum of outer products), added up in the tasks: rows needs x and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _rows(batch.column("x"))
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column("label").to_pylist())
            for label in (0, 1):
                sums[label] = sums.get(label, 0) + x[y == label].T @ x[y == label]
        for label, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * s.size), pa.array(range(s.size)), pa.array(s.reshape(-1))], ["label", "at", "v"])

    parts = pick(rows, "x", "label").mapInArrow(run, "label long, at long, v double")
    out = {}
    for label, cells in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("c")).collect():
        m = np.array([c.v for c in cells]).reshape(D + 1, D + 1)  # at most 2 * (D + 1) ** 2 numbers
        out[int(label)] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return {k: v for k, v in out.items() if v[0] > 0}


class Discriminant:
    """Two shrunk normal densities; `shrink` is the weight of the diagonal, `floor` the least variance
    as a share of the pooled one."""

    def __init__(self, sums: dict, shrink: float = 0.1, floor: float = 0.02):
        n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
        self.share = (n[1] + 1) / (n[0] + n[1] + 2)
        self.parts = []
        if min(n.values()) < 2:
            return
        total = sum(n.values())
        centre = sum(sums[k][1] for k in (0, 1)) / total
        scale = np.sqrt(np.maximum(np.diag(sum(sums[k][2] for k in (0, 1))) / total - centre**2, 1e-6))
        for k in (0, 1):
            mean = sums[k][1] / n[k]
            cov = (sums[k][2] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
            weight = min(1.0, shrink + D / n[k])
            cov = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + floor * np.eye(D)
            low = np.linalg.cholesky(cov)
            self.parts.append((mean, np.linalg.inv(low) / scale, np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - mean) @ whiten.T) ** 2).sum(axis=1) - half for mean, whiten, half in self.parts]
        gap = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def fit(found: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, **how) -> Discriminant:
    """The model of all labelled rows outside the held-out fold; found comes from measured()."""
    marks = pick(labels, "doc_id", "quality").where(fold(F.col("doc_id"), folds) != held).where("quality IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    return Discriminant(moments(found.join(marks, "doc_id")), **how)


def scores(found: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row of measured()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_rows(batch.column("x"))))], ["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, **how) -> DataFrame:
    """The documents that score at least `least`, with all their columns. Texts are not shuffled: they
    are measured once for the fit and again where they are filtered."""
    model = fit(measured(docs), labels, **how)
    return filtered(docs, lambda batch: model.score(statistics(batch.column("text"))) >= least)
