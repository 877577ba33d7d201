"""Walks over typed edges: what relates to a set of subjects, the most telling edges first.

Edges come in one order everywhere: observed ones before those a decision record asserts, calls before reads and
writes before all others, then by id. In a hop a subject takes its first `per_subject` edges in that order; an edge
whose two ends are both subjects is taken if it is among the first of either. Asserted edges show what they lead to,
but a walk does not go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import growing, materialise

#: The classes of relationships, the rest come last.
CALLS, DATA = "CALLS", ("READS_FROM", "WRITES_TO")


def priority(adr: Column, rel: Column, edge: Column) -> list[Column]:
    """The order of edges; a missing relationship is one of the rest."""
    return [F.coalesce(adr, F.lit(False)).cast("int"), F.when(rel == CALLS, 0).when(rel.isin(*DATA), 1).otherwise(2), edge]


def either_end(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst and others) with `subject`, one row for each end that is among nodes (node): an OR of two
    conditions as two equal joins."""
    ends = [edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi").withColumn("subject", F.col(end)) for end in ("src", "dst")]
    return ends[0].unionByName(ends[1].where("src <> dst"))


def walked(seeds: DataFrame, edges: DataFrame, hops: int, per_subject: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(edge, hop, place) of at most `most` edges and (node, distance) of what they lead to, from seeds (node) over
    edges (edge, src, dst, rel, adr). Edges without a relationship are counted against their subjects and then left
    out. Tables of each hop are written."""
    order = priority(F.col("adr"), F.col("rel"), F.col("edge"))
    found = materialise(seeds.where("node IS NOT NULL").select("node").distinct().withColumn("distance", F.lit(0)), "walk")
    taken, frontier, left = None, found.select("node"), most
    for hop in range(1, hops + 1):
        met = either_end(edges, frontier)
        first = met.withColumn("_nth", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where(F.col("_nth") <= per_subject)
        chosen = first.select("edge", "src", "dst", "rel", "adr").dropDuplicates(["edge"]).where("rel IS NOT NULL")
        if taken is not None:
            chosen = chosen.join(taken.select("edge"), "edge", "left_anti")
        chosen = chosen.orderBy(*order).limit(left)  # bounded before it is numbered
        place = F.row_number().over(Window.orderBy(*order)) + (most - left)
        chosen = materialise(chosen.withColumn("hop", F.lit(hop)).withColumn("place", place), "walk")
        taken = chosen if taken is None else materialise(taken.unionByName(chosen), "walk")
        reached = chosen.select(F.col("src").alias("node")).union(chosen.select("dst")).distinct().join(found, "node", "left_anti")
        reached = materialise(reached.withColumn("distance", F.lit(hop)), "walk")
        found = materialise(found.union(reached), "walk")
        left -= chosen.count()
        observed = taken.where("NOT coalesce(adr, false)")
        ends = observed.select(F.col("src").alias("node")).union(observed.select("dst"))
        frontier = materialise(reached.select("node").join(ends, "node", "left_semi"), "walk")
        if left <= 0 or not frontier.limit(1).count():
            break
    return taken, found


def inventory(asked: DataFrame, asserted: DataFrame, supports: DataFrame, direct: DataFrame, most: int | None = None) -> DataFrame:
    """(kind, edge, src, rel, dst, adr, support) of the relationships with an end in asked (node): asserted ones (edge,
    src, rel, dst, adr) with the number of chunks that support them (edge, chunk), and direct ones (src, rel, dst) that no
    assertion of the same type stands for. With `most`, only so many of each: the first in the order of a walk and by ends."""
    order = priority(F.col("adr"), F.col("rel"), F.col("edge"))
    mine = either_end(asserted, asked).drop("subject").dropDuplicates(["edge"])
    mine = materialise(mine if most is None else mine.orderBy(*order).limit(most), "asserted")
    shown = mine.select("edge")
    kept = supports.where("chunk IS NOT NULL").join(growing(shown) if most is None else F.broadcast(shown), "edge", "left_semi")  # `most` edges
    held = kept.groupBy("edge").agg(F.countDistinct("chunk").alias("support"))
    first = mine.join(held, "edge", "left").select(F.lit("assertion").alias("kind"), "edge", "src", "rel", "dst", "adr", F.coalesce("support", F.lit(0)).alias("support"))
    bare = either_end(direct, asked).drop("subject").distinct().join(asserted.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")
    bare = bare if most is None else bare.orderBy("src", "rel", "dst").limit(most)
    edge = F.concat_ws("|", "src", "rel", "dst").alias("edge")
    return first.unionByName(bare.select(F.lit("direct").alias("kind"), edge, "src", "rel", "dst", F.lit(False).alias("adr"), F.lit(0).cast("long").alias("support")))
