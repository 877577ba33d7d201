"""A neighbour index: vectors in cells around centres, searched by probing the nearest cells.

Centres are fitted on a bounded sample: at most `SAMPLE` rows, those whose ids have the smallest hashes, by a few
rounds of spherical means on the driver; how many cells a search probes is chosen on the same sample, as the fewest
that find `AIM` of its true neighbours. Every row is assigned to its cell by Spark and kept in blocks of at most
`BLOCK` vectors, so a cell that holds a third of all rows is many rows of work. A search sends blocks of questions to
the blocks of the cells they probe.

A question may ask for one value of the metadata. `search` keeps only rows with that value, inside the cells; where
the probed cells hold fewer of them than asked for, the question goes on to all other cells, so a rare value costs
recall nothing. `searched_then_filtered` is the way for an index that holds no metadata: the best rows of any value
are found first, and those of another value are dropped from them. `exact` compares a question with all rows.

Defined cases: vectors that are null, zero or hold a null or non-finite component are in no cell and ask nothing;
vectors of another length than the index meets nothing. A row without the metadata matches no value. Equal scores go
to the smaller id. Scores are cosines, rounded to 9 digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import materialise

#: Rows of the sample that centres are fitted on, rounds of fitting, cells at most, vectors in a block.
SAMPLE, ROUNDS, CELLS, BLOCK = 16_384, 10, 1024, 4096
#: The share of true neighbours that the probes must find on the sample, and questions asked of it.
AIM, ASKED = 0.97, 256
DIGITS = 9


@dataclass(frozen=True)
class NeighbourIndex:
    """blocks (cell, ids, vs, labels) of unit vectors, the centres, and how many cells a search probes."""

    blocks: DataFrame
    centres: np.ndarray
    probes: int


def _units(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of those that have a direction, of one length."""
    kept, out = [], []
    for i, v in enumerate(vectors):
        x = np.array(v, np.float64) if v is not None and len(v) and None not in v else None
        if x is not None and (dim is None or len(x) == dim):
            size = np.linalg.norm(x)
            if np.isfinite(size) and size > 0:
                kept.append(i)
                out.append(x / size)
    return np.array(kept, np.int64), np.array(out).reshape(len(kept), -1 if out else dim or 0)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors: each round takes the directions of what is nearest to each; an empty one stays."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, aim: float = AIM, asked: int = ASKED) -> int:
    """The fewest cells in which questions from the sample find `aim` of their k nearest others of it."""
    asked = min(asked, len(sample))
    at = np.linspace(0, len(sample) - 1, asked).astype(int)
    score = sample[at] @ sample.T
    score[np.arange(asked), at] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(sample[at] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(asked, 0), axis=1)
    found = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(aim * len(found))) - 1)]) + 1


def built(rows: DataFrame, k: int = 10, cells: int | None = None) -> NeighbourIndex:
    """The index of rows (id long, v array, label string); label is the metadata."""
    first = rows.where("v IS NOT NULL AND size(v) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    dim = len(first[0].v) if first else 0
    _, sample = _units([r.v for r in first], dim)
    count = rows.count()
    cells = cells or int(min(CELLS, max(1, round(count**0.5)), max(1, len(sample) // 8)))
    centres = fitted(sample, cells) if len(sample) else np.zeros((0, dim))
    probes = probes_needed(sample, centres, k) if len(sample) else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch.column("v").to_pylist(), dim)
            near = (x @ centres.T).argmax(axis=1) if len(at) else at
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(places), batch.column("label").take(places), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "cell", "v"])

    placed = materialise(rows.select("id", "v", "label").mapInArrow(assign, "id long, label string, cell int, v binary"), "cells")
    sizes = materialise(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")), "sizes")
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return NeighbourIndex(materialise(_packed(dealt, ["cell", "part"]), "blocks"), centres, probes)


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: (keys, ids, vs, labels) of rows (keys, id, v, label), in order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            ids, vs, labels = zip(*held, strict=True)
            columns = [pa.array([x], pa.int32()) for x in at]
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(vs)], pa.binary()), pa.array([list(labels)], pa.list_(pa.string()))], [*key, "ids", "vs", "labels"])

        for batch in batches:
            for *own, i, v, label in zip(*(batch.column(c).to_pylist() for c in (*key, "id", "v", "label")), strict=True):
                if own != at:
                    if held:
                        yield out()
                    at, held = own, []
                held.append((i, v, label))
        if held:
            yield out()

    dealt = rows.select(*key, "id", "v", "label").repartition(*key).sortWithinPartitions(*key, "id")
    return dealt.mapInArrow(run, ", ".join(f"{k} int" for k in key) + ", ids binary, vs binary, labels array<string>")


def _met(q: tuple, c: tuple, k: int, filtered: bool) -> Iterator[tuple[int, int, float]]:
    """(query, item, score) of the k best of a block of candidates for each question of a block."""
    (qi, qv, ql), (ci, cv, cl) = q, c
    classes = {label: np.flatnonzero(np.array([x == label for x in cl])) for label in set(ql)} if filtered else {}
    for a in range(0, len(qi), 256):
        score = np.round(qv[a : a + 256] @ cv.T, DIGITS) + 0.0
        score[qi[a : a + 256, None] == ci[None, :]] = -2
        for row, (i, label) in enumerate(zip(qi[a : a + 256].tolist(), ql[a : a + 256], strict=True)):
            at = classes[label] if filtered else np.arange(len(ci))
            at = at[score[row, at] > -2]
            if filtered and label is None:
                continue
            best = at[np.lexsort((ci[at], -score[row, at]))[:k]]
            yield from ((i, int(ci[j]), float(score[row, j])) for j in best)


def _searched(index: NeighbourIndex, asked: DataFrame, k: int, filtered: bool) -> DataFrame:
    """(query_id, item, score): the k best of each block for asked (cell, id, v, label)."""
    questions = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // BLOCK)))).cast("int"))
    blocks = materialise(_packed(questions, ["cell", "part"]), "questions")
    blocks = blocks.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vs", "labels")])
    dim = index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                side = lambda p, i=i, batch=batch: (np.frombuffer(batch.column(f"{p}ids")[i].as_py(), "<i8"), np.frombuffer(batch.column(f"{p}vs")[i].as_py()).reshape(-1, dim), batch.column(f"{p}labels")[i].as_py())
                found = list(zip(*_met(side("q_"), side(""), k, filtered), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "item", "score"])

    met = blocks.join(index.blocks, "cell").select("q_ids", "q_vs", "q_labels", "ids", "vs", "labels")
    return met.mapInArrow(run, "query_id long, item long, score double")


def _probing(index: NeighbourIndex, asked: DataFrame, low: int, high: int) -> DataFrame:
    """(cell, id, v, label): each question of (id, v, label) and its cells from the low-th nearest on, below the high-th."""
    centres = index.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _units(batch.column("v").to_pylist(), centres.shape[1])
            cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, low:high] if len(at) else np.zeros((0, 0), np.int64)
            n = pa.array(np.repeat(at, cells.shape[1]))
            blobs = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), cells.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column("id").take(n), blobs, batch.column("label").take(n)], ["cell", "id", "v", "label"])

    return materialise(asked.select("id", "v", "label").mapInArrow(run, "cell int, id long, v binary, label string"), "probes")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def search(index: NeighbourIndex, asked: DataFrame, k: int = 10, filtered: bool = False) -> DataFrame:
    """(query_id, item, score, position): for each question (id, v, label) the k best other rows of the probed cells;
    with filtered only rows of the question's label, for which a question goes on to all cells where it must."""
    asked = materialise(asked.select("id", "v", "label"), "asked")
    found = _searched(index, _probing(index, asked, 0, index.probes), k, filtered)
    if not filtered or index.probes >= len(index.centres):
        return _best(found, k)
    found = materialise(found, "found")
    have = materialise(_best(found, k).groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k), "have")
    rest = asked.join(have, "id", "left_anti")
    return _best(found.union(_searched(index, _probing(index, rest, index.probes, len(index.centres)), k, True)), k)


def searched_then_filtered(index: NeighbourIndex, asked: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """search() without the metadata, and of its rows only those whose label in rows (id, label) is the question's:
    fewer than k where others came first."""
    found = search(index, asked, k)
    want = asked.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    have = rows.select(F.col("id").alias("item"), F.col("label").alias("has"))
    return found.join(want, "query_id").join(have, "item").where("want = has").select("query_id", "item", "score", "position")


def exact(index: NeighbourIndex, asked: DataFrame, k: int = 10, filtered: bool = False) -> DataFrame:
    """search() in all cells: what brute force finds."""
    return _best(_searched(index, _probing(index, asked, 0, len(index.centres)), k, filtered), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true (query_id, item) that is found."""
    wanted = true.select("query_id", "item").distinct()
    n, hit = wanted.join(found.select("query_id", "item", F.lit(1).alias("hit")).distinct(), ["query_id", "item"], "left").agg(F.count("*"), F.count("hit")).first()
    return hit / n if n else 1.0
