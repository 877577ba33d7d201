"""Where to look for what governs a change: seeds of the changed places, their surroundings, and search queries.

For each change set: its units in fair turns of the files; for each unit the entities it changed, or those of its file
where none is known; the first edges at them, calls before reads and writes; the entities at the ends, changed ones
first; and for each channel the terms to search with. Equal texts of a channel are one query with the seeds of all.
Everything a bound leaves out is told, with the bound.

All is joins, ranks and limits over tables of all change sets together; a change set is bounded by the limits once its
units are chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X

from .pruning import computed
from .records import bounded_terms
from .steps import materialise


#: Ids of a row that tells what was left out around a seed.
PART = 1024


@dataclass(frozen=True)
class Limits:
    per_file: int = 8
    seeds: int = 64
    edges: int = 12
    entities: int = 24
    terms: int = 64
    term_chars: int = 96
    chars: int = 1600
    queries: int = 96


def _nth(key: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order))


@dataclass(frozen=True)
class Found:
    """What lies around the units: full (ctx, delta, path, nth, before, after, symbols, names, entities, edges, resolved)
    and, so far, what bounds left out."""

    full: DataFrame
    omitted: list[DataFrame]


def around(deltas: DataFrame, entities: DataFrame, mapped: DataFrame, edges: DataFrame, limits: Limits = Limits()) -> Found:  # noqa: B008
    """What lies around the units of built(); its tables are told there."""
    left_out = []
    omit = lambda rows, code, item: left_out.append(rows.select("ctx", F.lit(code).alias("code"), item.alias("item")))
    pair = lambda *names: F.concat_ws("/", *names)

    in_file = _nth(["ctx", "path"], "place", "delta")
    omit(deltas.select("ctx", "delta", "path", "place").withColumn("turn", in_file).where(F.col("turn") > limits.per_file), "PER_FILE_LIMIT", F.col("delta"))
    fair = deltas.withColumn("turn", in_file).where(F.col("turn") <= limits.per_file).withColumn("nth", _nth(["ctx"], "turn", "path"))
    fair = materialise(fair, "units")
    omit(fair.where(F.col("nth") > limits.seeds), "SEED_LIMIT", F.col("delta"))
    seeds = fair.where(F.col("nth") <= limits.seeds).drop("turn")

    # An entity comes with the seeds that it is a candidate of, at most all of its change set.
    changed = mapped.join(seeds.select("ctx", "delta"), ["ctx", "delta"], "left_semi").groupBy("ctx", "entity").agg(F.collect_set("delta").alias("changed"))
    known = materialise(entities.select("ctx", "entity", "name", "path", "distance").join(changed, ["ctx", "entity"], "left"), "known")
    resolved = known.select("ctx", F.explode("changed").alias("delta")).distinct()
    unmapped = seeds.select("ctx", "delta", "path").join(resolved, ["ctx", "delta"], "left_anti")
    unmapped = materialise(unmapped.groupBy("ctx", "path").agg(F.collect_list(F.struct("delta")).alias("of_file")), "unmapped")
    omit(unmapped.select("ctx", F.inline("of_file")), "UNMAPPED_UNIT", F.col("delta"))
    known = known.join(unmapped, ["ctx", "path"], "left")

    none = F.array().cast("array<string>")
    end = F.struct("entity", "name", "distance")
    whose = F.array_distinct(F.concat(F.coalesce("changed", none), F.coalesce(F.col("of_file.delta"), none)))
    side = lambda to: known.select("ctx", F.col("entity").alias(to), end.alias(f"{to}_is"), whose.alias(f"{to}_of"))
    met = edges.select("ctx", "edge", "src", "dst", "rel").distinct().join(side("src"), ["ctx", "src"]).join(side("dst"), ["ctx", "dst"])
    met = met.select("*", F.explode(F.array_distinct(F.concat("src_of", "dst_of"))).alias("delta"))
    place = F.when(F.col("rel") == "CALLS", 0).when(F.col("rel").isin("READS_FROM", "WRITES_TO"), 1).otherwise(2)
    told = lambda of, own: F.struct(of["distance"].alias("distance"), of["entity"].alias("entity"), of["name"].alias("name"), own.alias("own"))
    ends = F.array(*[told(F.col(f"{to}_is"), F.exists(f"{to}_of", lambda x: x.eqNullSafe(F.col("delta")))) for to in ("src", "dst")])
    rows = lambda df, edge, order, id_, ends, sure: df.select("ctx", "delta", F.lit(edge).alias("edge"), order.alias("order"), id_.alias("id"), ends.alias("ends"), sure.alias("sure"))
    own = known.withColumn("delta", F.explode(whose))
    near = rows(own, False, F.col("distance"), F.col("entity"), F.array(told(end, F.lit(True))), F.coalesce(F.array_contains("changed", F.col("delta")), F.lit(False)))
    near = near.union(rows(met, True, place, F.col("edge"), ends, F.lit(False)))
    # Dealt once: rows are put in order and gathered where they then lie. The lists of a seed are bounded by its limits, and what
    # is left out stands in further rows of at most so many ids as a part holds.
    near = near.repartition("ctx", "delta").withColumn("nth", _nth(["ctx", "delta", "edge"], "order", "id"))
    is_edge, fits = F.col("edge"), F.col("nth") <= F.when(F.col("edge"), limits.edges).otherwise(limits.entities)
    near = near.withColumn("part", F.when(fits, 0).otherwise(1 + F.floor(F.col("nth") / PART)))
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.struct("nth", "id", "ends"))))
    over = lambda which: F.collect_list(F.when(which & ~fits, F.col("id")))
    lists = near.groupBy("ctx", "delta", "part").agg(listed(is_edge & fits).alias("first"), listed(~is_edge & fits).alias("own"), over(is_edge).alias("over_edges"), over(~is_edge).alias("over_entities"), F.bool_or("sure").alias("resolved"))
    # Candidates come before what the edges add.
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["distance"].alias("distance"), x["entity"].alias("entity"), x["name"].alias("name")))
    flat = lambda of: F.flatten(F.transform(of, lambda x: x["ends"]))
    added = F.array_sort(F.array_distinct(bare(F.filter(flat("first"), lambda x: ~x["own"]))))
    lists = computed(lists, ids=F.concat(bare(flat("own")), added))
    lists = computed(lists, held=F.slice("ids", 1, limits.entities))
    lists = computed(lists, entities=F.transform("held", lambda x: x["entity"]))
    stays = lambda x: F.col("delta").isNotNull() & F.forall(x["ends"], lambda e: F.array_contains("entities", e["entity"]))
    ids_of = lambda xs: F.transform(xs, lambda x: x["id"])
    lists = lists.select(
        "ctx",
        "delta",
        "part",
        "resolved",
        F.transform("held", lambda x: x["name"]).alias("names"),
        F.array_sort("entities").alias("entities"),
        F.array_sort(ids_of(F.filter("first", stays))).alias("edges"),
        F.concat("over_entities", F.transform(F.filter("ids", lambda x, i: i >= limits.entities), lambda x: x["entity"])).alias("no_entities"),
        F.concat("over_edges", ids_of(F.filter("first", lambda x: ~stays(x)))).alias("no_edges"),
    )
    lists = materialise(lists, "lists")
    for code, column in (("ENTITY_LIMIT", "no_entities"), ("NEIGHBOR_LIMIT", "no_edges")):
        omit(lists.select("ctx", "delta", F.explode(column).alias("id")), code, pair("delta", "id"))
    full = seeds.join(lists.where("part = 0").drop("part", "no_entities", "no_edges"), ["ctx", "delta"], "left")
    return Found(full, left_out)


def seeds_of(found: Found) -> DataFrame:
    """The seeds of built(), without the work for its queries."""
    none = F.array().cast("array<string>")
    return found.full.select("ctx", "delta", "path", F.when(F.col("resolved"), "RESOLVED").otherwise("FILE_FALLBACK").alias("mapping"), F.coalesce("entities", none).alias("entities"), F.coalesce("edges", none).alias("edges"))


def built(deltas: DataFrame, entities: DataFrame, mapped: DataFrame, edges: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(seeds, queries, omitted) of deltas (ctx, delta, path, place, before, after, symbols), entities (ctx, entity, name,
    path, distance), mapped (ctx, delta, entity) for what a unit changed, and edges (ctx, edge, src, dst, rel).

    Seeds: (ctx, delta, path, mapping, entities, edges), the last two being sorted ids. Queries: (ctx, channel, text, seeds,
    nth), seeds being how many share it. Omitted: (ctx, code, item), item naming what was left out."""
    found = around(deltas, entities, mapped, edges, limits)
    full, left_out = found.full, list(found.omitted)
    omit = lambda rows, code, item: left_out.append(rows.select("ctx", F.lit(code).alias("code"), item.alias("item")))
    pair = lambda *names: F.concat_ws("/", *names)
    none = F.array().cast("array<string>")
    source = F.concat_ws("\n", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    shown = lambda a: F.filter(a, lambda x: F.trim(x) != "")
    spelt = lambda a: X.identifier_terms(F.concat_ws(" ", a))
    rows = computed(full, source=source, exact=shown(F.concat(F.coalesce("symbols", none), F.coalesce("names", none))))
    rows = computed(rows, told=X.identifier_terms(F.col("source")), literals=shown(X.quoted_literals(F.col("source"))), exact_terms=spelt(F.col("exact")), path_terms=X.identifier_terms(F.col("path")))
    path = shown(F.array("path"))
    views = {"CODE": F.concat("exact", path, "exact_terms", "path_terms", "told", "literals"), "RECORDS": F.concat("literals", "exact", "exact_terms", "told", path, "path_terms")}
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.array_distinct(v).alias("terms")) for c, v in views.items()])).alias("v")
    rows = rows.select("ctx", "delta", "path", "nth", asked).select("ctx", "delta", "path", "nth", "v.channel", "v.terms")
    rows = computed(rows, kept=bounded_terms(F.col("terms"), limits.term_chars, limits.terms, limits.chars))
    text = F.when(F.size("kept") > 0, F.array_join("kept", " ")).otherwise(F.substring("path", 1, limits.chars))
    rows = materialise(rows.select("ctx", "delta", "nth", "channel", text.alias("text"), (F.size("kept") < F.size("terms")).alias("cut")), "views")
    omit(rows.where("cut"), "QUERY_TEXT_LIMIT", pair("channel", "delta"))
    merged = rows.groupBy("ctx", "channel", "text").agg(F.count("*").alias("seeds"), F.min("nth").alias("first"))
    merged = materialise(merged.withColumn("nth", _nth(["ctx"], "channel", "first")), "queries")
    omit(merged.where(F.col("nth") > limits.queries), "QUERY_LIMIT", pair("channel", F.sha2("text", 256)))

    omitted = left_out[0]
    for more in left_out[1:]:
        omitted = omitted.unionByName(more)
    return seeds_of(found), merged.where(F.col("nth") <= limits.queries).select("ctx", "channel", "text", "seeds", "nth"), omitted
