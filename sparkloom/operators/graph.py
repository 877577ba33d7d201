"""Edge tables: inventories, merging, neighbourhoods, entity resolution and communities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.identity import GENERIC

from .steps import discard, growing, materialise


def bounded(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows and whether more were there: one row beyond is read, no count of all."""
    head = rows.orderBy(*order).limit(most + 1)
    nth = F.row_number().over(Window.orderBy(*order))  # over most + 1 rows
    return head.withColumn("nth", nth).withColumn("truncated", F.max("nth").over(Window.partitionBy()) > most).where(F.col("nth") <= most)


def uncovered_direct(direct: DataFrame, asserted: DataFrame) -> DataFrame:
    """Direct edges for which no assertion has the same ends and type."""
    return direct.join(asserted.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, rel, dst): largest confidence, first rationale by seq, distinct sources."""
    good = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return good.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("rationale", F.when(F.col("rationale").isNotNull(), F.col("seq"))).alias("rationale"), F.array_sort(F.collect_set("source")).alias("sources"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, without loops."""
    pair = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pair.union(pair.select("b", "a")).distinct()


def neighbourhood(seeds: DataFrame, both: DataFrame, hops: int, per_subject: int) -> DataFrame:
    """(node, distance) within `hops` of the seeds (node); each subject follows at most `per_subject`
    neighbours, smallest ids first."""
    limited = both.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("nth") <= per_subject)
    found = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    edge = found
    for d in range(1, hops + 1):
        edge = edge.join(limited, edge.node == limited.a).select(F.col("b").alias("node")).distinct().withColumn("distance", F.lit(d))
        found = found.union(edge)
    return found.groupBy("node").agg(F.min("distance").alias("distance"))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are in nodes (id)."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out


def canonical(mentions: DataFrame, key: Column) -> DataFrame:
    """Mentions with one key are one entity: first spelling by seq, spellings, evidence in order."""
    rows = mentions.withColumn("key", key)
    return rows.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.count("*").alias("mentions"), F.array_sort(F.collect_set("name")).alias("spellings"))


def resolve_tiered(mentions: DataFrame, entities: DataFrame, folded, squeezed) -> DataFrame:
    """(mention_id, entity_id, tier, ambiguous) of mentions (mention_id, name, label) among entities
    (entity_id, name, label, aliases). Tiers: the label and the name; the label and the name or an alias; a
    compatible label and the name or an alias; the same by names without white space, hyphens and
    underscores. The first tier with a hit decides, and only a single entity is a match. A mention without a
    label is a component; labels are compatible if equal, or if one is missing or generic."""
    clean = lambda c: folded(F.trim(c))
    m = mentions.select("mention_id", clean(F.coalesce("label", F.lit("Component"))).alias("want"), clean(F.col("name")).alias("f"), squeezed(F.col("name")).alias("q")).where("f <> ''")
    labelled = entities.select("entity_id", clean(F.coalesce("label", F.lit(""))).alias("label"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    own = labelled.select("entity_id", "label", F.col("name").alias("n"), F.lit(True).alias("own"))
    names = own.unionByName(labelled.select("entity_id", "label", F.explode("aliases").alias("n"), F.lit(False).alias("own"))).where("n <> ''")
    keyed = lambda key: names.select("entity_id", "label", "own", key.alias("key")).groupBy("key", "label", "entity_id").agg(F.max("own").alias("own")).groupBy("key", "label")
    count = lambda test, n: [F.count(F.when(test, 1)).alias(f"n{n}"), F.min(F.when(test, F.col("entity_id"))).alias(f"e{n}")]
    plain = keyed(clean(F.col("n"))).agg(*count(F.col("own"), 1), *count(F.lit(True), 2))
    bare = keyed(squeezed(F.col("n"))).agg(*count(F.lit(True), 4))
    same = F.col("label") == F.col("want")
    fits = same | (F.col("label") == "") | F.col("label").isin(*GENERIC) | F.col("want").isin(*GENERIC)
    total = lambda test, n, source: [F.coalesce(F.sum(F.when(test, F.col(f"n{source}"))), F.lit(0)).alias(f"t{n}"), F.min(F.when(test, F.col(f"e{source}"))).alias(f"x{n}")]
    one = m.join(plain.withColumnRenamed("key", "f"), "f", "left").groupBy("mention_id").agg(*total(same, 1, 1), *total(same, 2, 2), *total(fits, 3, 2))
    two = m.join(bare.withColumnRenamed("key", "q"), "q", "left").groupBy("mention_id").agg(*total(fits, 4, 4))
    hit = None
    for n in (1, 2, 3, 4):
        found = F.struct(F.lit(n).alias("tier"), F.col(f"x{n}").alias("e"), F.col(f"t{n}").alias("n"))
        hit = F.when(F.col("t1") > 0, found) if n == 1 else hit.when(F.col(f"t{n}") > 0, found)
    out = mentions.select("mention_id").join(one.join(two, "mention_id"), "mention_id", "left").withColumn("hit", hit)
    return out.select("mention_id", F.when(F.col("hit.n") == 1, F.col("hit.e")).alias("entity_id"), F.coalesce("hit.tier", F.lit(0)).alias("tier"), (F.coalesce("hit.n", F.lit(0)) > 1).alias("ambiguous"))


def communities(both: DataFrame) -> DataFrame:
    """(node, community): the smallest id a node can reach over edges (a, b). Alternating large-star and
    small-star rounds until no edge moves, so their number grows with the logarithm of a path's length;
    each round is written to the shared folder, so a lost executor re-reads it. The smallest neighbours
    are written before the edges meet them: Spark splits a node's many edges only between plain tables."""
    kept = lambda df, name: materialise(df, name)
    edges = kept(both.where("a > b").select("a", "b").distinct(), "edges")
    nodes = kept(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node")), "nodes")
    before = None
    while True:
        ways = edges.union(edges.select("b", "a"))
        least = kept(ways.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = kept(ways.join(growing(least), ways.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = kept(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "low")
        small = large.join(growing(low), large.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = kept(small.union(low.select("u", "m")).distinct(), "small")
        discard(edges, least, large, low)
        edges = small
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if state == before:
            return nodes.join(growing(edges.select(F.col("a").alias("node"), "b")), "node", "left").select("node", F.coalesce("b", "node").alias("community"))
        before = state


#: Members of a community that one digest covers; a larger community's id is the digest of its blocks' digests.
DIGESTED = 100_000


def _digests(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys with `digest`, the sha256 of the group's members in order, joined by bars. Rows pass sorted, so that a
    task holds one digest's state and no list of members."""
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([x], batch.column(k).type) for x, k in zip(at, keys, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([digest.hexdigest()])], [*keys, "digest"])

        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*keys, member)), strict=True):
                if key != at:
                    if digest is not None:
                        yield out(batch)
                    at, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"|" + text.encode())
        if digest is not None:
            yield out(batch)

    sorted_ = rows.select(*keys, member).repartition(*keys).sortWithinPartitions(*keys, member)
    return sorted_.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", digest string")


def sectioned_digests(rows: DataFrame, key: str, heads: tuple[str, ...], between: str) -> DataFrame:
    """(key, digest): for every key the sha256 of its text, which has the sections in order, each with its head and its
    lines in order of (first, second), `between` standing between two. rows (key, section, first, second, line). Lines pass sorted, and
    a task holds the state of one digest. A section without lines is its head."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, section, digest, started = None, -1, None, False

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            for head in heads[section + 1 :]:
                digest.update(head.encode())
            return pa.RecordBatch.from_arrays([pa.array([at], batch.column(key).type), pa.array([digest.hexdigest()])], [key, "digest"])

        for batch in batches:
            for k, n, line in zip(*(batch.column(c).to_pylist() for c in (key, "section", "line")), strict=True):
                if digest is None or k != at:
                    if digest is not None:
                        yield out(batch)
                    at, section, digest = k, -1, hashlib.sha256()
                while section < n:
                    section, started = section + 1, False
                    digest.update(heads[section].encode())
                digest.update(((between if started else "") + line).encode())
                started = True
        if digest is not None:
            yield out(batch)

    sorted_ = rows.repartition(key).sortWithinPartitions(key, "section", "first", "second").select(key, "section", "line")
    return sorted_.mapInArrow(run, f"{key} {kind}, digest string")


def with_community_ids(found: DataFrame, most: int = DIGESTED) -> DataFrame:
    """found (node, community) with `community_id`, the digest of O-08 over the members as text in order. A community
    of more than `most` members is dealt over blocks by a hash of the member; its id is the digest of the
    blocks' digests in order, so that no task digests a whole large community. Ids join back to written sides."""
    sizes = materialise(found.groupBy("community").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")), "sizes")
    rows = found.join(growing(sizes), "community").select("community", "blocks", F.col("node").cast("string").alias("member"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    parts = materialise(_digests(dealt, ["community", "blocks", "block"], "member"), "digests")
    one = parts.where("blocks = 1").select("community", "digest")
    several = parts.where("blocks > 1").select("community", F.concat_ws(":", F.lpad(F.col("block").cast("string"), 10, "0"), "digest").alias("member"))
    several = _digests(several, ["community"], "member")
    ids = materialise(one.union(several).select("community", F.concat(F.lit("comm_"), F.substring("digest", 1, 12)).alias("community_id")), "ids")
    return found.join(growing(ids), "community").select("node", "community", "community_id")
