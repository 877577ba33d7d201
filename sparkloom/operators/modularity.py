"""Communities by modularity: local moving and coarsening, level by level, as joins and sums.

In a sweep each node finds the neighbouring community whose joining gains most. All moves of a sweep happen at once, so
a seeded half of the communities gives nodes away and the other half takes them: no node follows another that leaves in
the same sweep. After the sweeps of a level its communities become the nodes of the next, with the weights between them
summed, as long as the modularity rises. What then has at most `FINISHED` links is finished by one task, whose
memory this number bounds. In the end the nodes themselves move once more among the communities found, half of them
at a time while the modularity rises, and communities that are not connected fall apart into their parts, which never
lowers it.

Weights are whole numbers, so all sums are exact and a run gives the same communities on any cluster; equal gains
are decided by a seeded hash. Nodes go by 64-bit hashes, of which no two may be equal. Nothing but numbers of rows and the
modularity reaches the driver. A node with very many links meets its neighbours in joins of written tables, which can be
split, and in sums that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import communities
from .steps import growing, materialise

#: Sweeps of a level, levels, sweeps of the nodes in the end, and the gain below which these end.
SWEEPS, LEVELS, FINE, LEAST_GAIN = 6, 40, 5, 1e-4
#: Links of a graph that one task finishes.
FINISHED = 1 << 17
SEED = 42


def _pairs(edges: DataFrame) -> DataFrame:
    """(a, b, w): each pair of ends once, the smaller first, with the number of its edges."""
    good = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return materialise(good.groupBy("a", "b").agg(F.count("*").alias("w")), "weighted")


def weighted(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions with the number of parallel edges (src, dst); loops and missing ends are left out."""
    once = _pairs(edges)
    return once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _half(key: Column | str, seed: int, side: int = 0) -> Column:
    """Whether a key is on a side of the two that a seed deals keys to."""
    return F.pmod(F.xxhash64(key, F.lit(SEED + seed)), F.lit(2)) == side


def _square(total: Column | str) -> Column:
    return F.col(total).cast("decimal(19,0)") * F.col(total).cast("decimal(19,0)")


def _measured(inside: int | None, squares: int | None, whole: int) -> float:
    """The modularity: the share of weight inside communities, less the share that chance would put there."""
    return int(inside or 0) / whole - int(squares or 0) / whole**2


def _looked_up(labels: DataFrame) -> DataFrame:
    """labels as the side of a join that a task holds as a hash table: many links meet few rows and needn't be sorted."""
    return labels.hint("shuffle_hash")


def _ends(pairs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns of both ends' labels (node and others), named after the column and the end."""
    for end in ("a", "b"):
        pairs = pairs.join(_looked_up(labels.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])), end)
    return pairs


def _placed(labels: DataFrame) -> DataFrame:
    """labels (node, c, k, loop) with the total of each one's community."""
    totals = materialise(labels.groupBy("c").agg(F.sum("k").alias("total")), "totals")
    return materialise(labels.join(growing(totals), "c").select("node", "c", "k", "loop", "total"), "placed")


def _swept(pairs: DataFrame, placed: DataFrame, whole: int, turn: int, fine: bool) -> DataFrame:
    """labels (node, c, k, loop) after one sweep, with the weight `inside` between a node and its community before it.
    Half of the nodes move if `fine`, else those in half of the communities, and only to the other half."""
    mover = lambda node, own: _half(node, 0, turn % 2) if fine else _half(own, turn, 1)
    # Each link twice, from one end and from the other.
    met = _ends(pairs, placed, "c", "k", "total").withColumn("forth", F.explode(F.array(F.lit(True), F.lit(False))))
    of = lambda x, y, name: F.when(F.col("forth"), F.col(x)).otherwise(F.col(y)).alias(name)
    rows = met.select(of("a", "b", "node"), of("c_a", "c_b", "from"), of("c_b", "c_a", "c"), "w", of("k_a", "k_b", "k"), of("total_b", "total_a", "total"))
    own = F.col("from") == F.col("c")
    rows = rows.where(mover(F.col("node"), F.col("from")) | own).select("node", "c", "w", "k", "total", own.alias("own"))
    rows = rows.union(placed.select("node", "c", F.lit(0).cast("long"), "k", "total", F.lit(True)))
    sums = rows.groupBy("node", "c", "k", "total", "own").agg(F.sum("w").alias("w"))
    # The gain of being in c rather than alone, times the whole weight; exact longs turned into doubles.
    rest = F.col("total") - F.when(F.col("own"), F.col("k")).otherwise(F.lit(0))
    gain = F.col("w").cast("double") * F.lit(float(whole)) - F.col("k").cast("double") * rest.cast("double")
    best = sums.withColumn("gain", gain).groupBy("node").agg(
        F.max(F.struct("gain", F.xxhash64("c", F.lit(turn)).alias("h"), "c")).alias("best"),
        F.max(F.when(F.col("own"), F.col("gain"))).alias("stay"),
        F.max(F.when(F.col("own"), F.col("w"))).alias("inside"),
    )
    moves = mover(F.col("node"), F.col("c")) & (F.col("best.gain") > F.col("stay"))
    moves = moves if fine else moves & _half(F.col("best.c"), turn)
    return placed.join(growing(best.withColumnRenamed("node", "n")), F.col("node") == F.col("n")).select("node", F.when(moves, F.col("best.c")).otherwise(F.col("c")).alias("c"), "k", "loop", (F.col("inside") + F.col("loop")).alias("inside"), moves.alias("moved"))


def _levelled(pairs: DataFrame, placed: DataFrame, whole: int, turn: int) -> DataFrame:
    """labels after the sweeps of a level, or after the one that moves less than a hundredth of the nodes."""
    for n in range(SWEEPS):
        labels = materialise(_swept(pairs, placed, whole, turn + n, False), "labels")
        moved, nodes = labels.agg(F.count_if("moved"), F.count("*")).first()
        if n == SWEEPS - 1 or moved * 100 < nodes:
            return labels
        placed = _placed(labels)


def _merged(pairs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, nodes) of the next level: communities as nodes (node, c, k, loop, total)."""
    ends = _ends(pairs, labels, "c")
    joined = ends.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("w").alias("w"))
    joined = materialise(joined, "level")
    inner = joined.where("a = b").select(F.col("a").alias("c"), (2 * F.col("w")).alias("inner"))
    sums = labels.groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("old")).join(growing(inner), "c", "left")
    nodes = sums.select(F.col("c").alias("node"), "c", "k", (F.col("old") + F.coalesce("inner", F.lit(0))).alias("loop"), F.col("k").alias("total"))
    return joined.where("a <> b"), materialise(nodes, "placed")


def _moved_one_by_one(near: list[dict], k: list[int], whole: int, c: list[int]) -> bool:
    """Nodes move one by one to the neighbouring community of the largest gain until none gains; whether one moved."""
    total, ever, moved = [0] * len(near), False, True
    for v, own in enumerate(c):
        total[own] += k[v]
    while moved:
        moved = False
        for v, own in enumerate(c):
            total[own] -= k[v]
            to = {own: 0}
            for other, w in near[v].items():
                to[c[other]] = to.get(c[other], 0) + w
            best, most = own, to[own] * whole - k[v] * total[own]
            for x, w in to.items():
                if (gain := w * whole - k[v] * total[x]) > most:
                    best, most = x, gain
            total[best] += k[v]
            if best != own:
                c[v], moved, ever = best, True, True
    return ever


def best_labels(n: int, links: list[tuple[int, int, int]], loops: list[int]) -> list[int]:
    """The community of each of n nodes of a small graph with links (a, b, w): local moving and coarsening, and again from what was
    found, until no node gains."""
    whole = 2 * sum(w for *_, w in links) + sum(loops)
    found = list(range(n))
    while True:
        level, own, c, path, rose = links, loops, found, None, False
        while True:
            near, k = [{} for _ in own], list(own)
            for a, b, w in level:
                near[a][b], near[b][a] = w, w
                k[a], k[b] = k[a] + w, k[b] + w
            moved = _moved_one_by_one(near, k, whole, c)
            rose = rose or moved
            if path is not None and not moved:
                break
            names = {x: i for i, x in enumerate(dict.fromkeys(c))}
            c = [names[x] for x in c]
            path = c if path is None else [c[x] for x in path]
            summed, inner = {}, [0] * len(names)
            for v, x in enumerate(c):
                inner[x] += own[v]
            for a, b, w in level:
                x, y = sorted((c[a], c[b]))
                if x == y:
                    inner[x] += 2 * w
                else:
                    summed[x, y] = summed.get((x, y), 0) + w
            level, own, c = [(*ends, w) for ends, w in summed.items()], inner, list(range(len(names)))
        found = path
        if not rose:
            return found


def _finished(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """labels (node, c) of a graph of at most FINISHED links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches], strict=True))
        order = np.lexsort((b, a))
        names, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
        links, loops = [], [0] * len(names)
        for x, y, n in zip(*np.split(ends, 2), w[order].tolist(), strict=True):
            if x == y:
                loops[x] = n
            else:
                links.append((int(x), int(y), n))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[best_labels(len(names), links, loops)])], ["node", "c"])

    rows = pairs.select("a", "b", "w").union(nodes.select("node", "node", "loop"))
    return rows.coalesce(1).mapInArrow(run, "node long, c long")


def _refined(pairs: DataFrame, labels: DataFrame, whole: int) -> DataFrame:
    """labels (node, c) after the nodes' own sweeps, as far as these raise the modularity."""
    kept, before = labels, None
    for turn in range(FINE):
        placed = _placed(labels)
        found = materialise(_swept(pairs, placed, whole, turn, True), "labels")
        inside, moved = found.agg(F.sum("inside"), F.count_if("moved")).first()
        squares = placed.select((F.col("k").cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)")).alias("s")).agg(F.sum("s")).first()[0]
        now = _measured(inside, squares, whole)
        if before is not None and now <= before:
            return kept
        gained = now - before if before is not None else 1.0
        kept, before = labels, now
        if gained < LEAST_GAIN or not moved and turn:
            return kept
        labels = found.select("node", "c", "k", "loop")
    return kept


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """The modularity of labels (node, c) on the edges of weighted()."""
    whole = edges.agg(F.sum("w")).first()[0]
    if not whole:
        return 0.0
    inside = _ends(edges.where("a < b"), labels, "c").where("c_a = c_b").agg(F.sum("w")).first()[0] or 0
    sums = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    totals = sums.join(growing(labels), "node").groupBy("c").agg(F.sum("k").alias("total"))
    return _measured(2 * inside, totals.agg(F.sum(_square("total"))).first()[0], whole)


def _named(once: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of the ends of pairs, with hashes that are all different, and their seed."""
    names = once.select(F.col("a").alias("node")).union(once.select("b")).distinct()
    for seed in range(SEED, SEED + 9):
        nodes = materialise(names.select("node", F.xxhash64("node", F.lit(seed)).alias("id")), "nodes")
        if nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return nodes, seed
    raise ValueError("hashes of nodes are equal at nine seeds")


def by_modularity(edges: DataFrame) -> DataFrame:
    """(node, community) for every end of edges (src, dst): community is the smallest node of its own."""
    once = _pairs(edges)
    nodes, seed = _named(once)
    id_ = lambda end: F.xxhash64(end, F.lit(seed)).alias(end)
    links = materialise(once.select(id_("a"), id_("b"), "w"), "level")
    ends = links.select(F.col("a").alias("node"), "w").union(links.select("b", "w"))
    sums = ends.groupBy("node").agg(F.sum("w").alias("k"))
    first = materialise(sums.select("node", F.col("node").alias("c"), "k", F.lit(0).cast("long").alias("loop"), F.col("k").alias("total")), "placed")
    whole = 2 * (links.agg(F.sum("w")).first()[0] or 0)
    if not whole:
        return nodes.select("node", F.col("node").alias("community"))
    level, placed, path, last = links, first, None, None
    for n in range(LEVELS):
        alone = level.count() <= FINISHED
        labels = materialise(_finished(level, placed), "labels") if alone else _levelled(level, placed, whole, n * SWEEPS)
        places = labels.select(F.col("node").alias("c"), F.col("c").alias("to"))
        further = labels.select("node", "c") if path is None else path.join(growing(places), "c").select("node", F.col("to").alias("c"))
        if alone:
            path = materialise(further, "path")
            break
        level, placed = _merged(level, labels)
        now = _measured(*placed.agg(F.sum("loop"), F.sum(_square("k"))).first(), whole)
        if last is not None and now < last:
            break
        path = materialise(further, "path")
        if last is not None and now - last < LEAST_GAIN:
            break
        last = now
    if not (alone and n == 0):
        path = _refined(links, path.join(growing(first.drop("c", "total")), "node").select("node", "c", "k", "loop"), whole)
    return _connected(links, path.select("node", "c"), nodes)


def _connected(links: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, community) by the names of nodes (node, id): the connected parts of each community."""
    ends = _ends(links, labels, "c").where("c_a = c_b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = communities(ends).select(F.col("node").alias("id"), F.col("community").alias("part"))
    named = materialise(nodes.join(growing(parts), "id", "left").select("node", F.coalesce("part", "id").alias("part")), "named")
    smallest = materialise(named.groupBy("part").agg(F.min("node").alias("community")), "smallest")
    return named.join(growing(smallest), "part").select("node", "community")
