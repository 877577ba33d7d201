"""From signals to evidence: what a hit leads to, what a source covers, what stays within bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges that tell where something is said, not how things depend on each other.
PROVENANCE = ("ASSERTS", "TARGETS", "MENTIONS", "MEMBER_OF")


def architectural(edges: DataFrame) -> DataFrame:
    """Edges (src, rel, dst) that are no provenance."""
    return edges.where(~F.col("rel").isin(*PROVENANCE))


def in_scope(rows: DataFrame, column: str, scope: object | None) -> DataFrame:
    """rows of one scope, or all rows where no scope is asked for."""
    return rows if scope is None else rows.where(F.col(column) == scope)


def present(rows: DataFrame, status: str, pending: DataFrame, key: str) -> DataFrame:
    """rows that are neither deleted nor wait for a deletion (pending has the key)."""
    return rows.where(F.col(status) != "DELETED").join(pending.select(key).distinct(), key, "left_anti")


def signalled(entity_hits: DataFrame, community_hits: DataFrame, members: DataFrame, provenance: DataFrame, most: int) -> DataFrame:
    """(chunk, channels, best_rank, signals): chunks that entity hits (id, rank) and community hits lead to, by
    members (entity, community) and provenance (chunk, entity); more channels first, then the best rank."""
    hits = entity_hits.select(F.col("id").alias("entity"), F.lit("entity").alias("channel"), "id", "rank")
    joined = members.join(community_hits.withColumnRenamed("id", "community"), "community")
    hits = hits.unionByName(joined.select("entity", F.lit("community").alias("channel"), F.col("community").alias("id"), "rank"))
    signals = provenance.select("chunk", "entity").distinct().join(hits, "entity").select("chunk", "channel", "id", "rank").distinct()
    found = signals.groupBy("chunk").agg(F.countDistinct("channel").alias("channels"), F.min("rank").alias("best_rank"), F.count("*").alias("signals"))
    return found.orderBy(F.desc("channels"), "best_rank", "chunk").limit(most)


def declaring(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` chunks (chunk, text) that mention (chunk, entity) an entity (entity, name), those that
    declare one first."""
    declares = F.lit(False)
    for before, after in (("def ", "("), ("class ", ""), ("function ", "(")):
        declares = declares | F.col("text").contains(F.concat(F.lit(before), "name", F.lit(after)))
    rows = chunks.join(mentions, "chunk").join(entities, "entity")
    hint = rows.groupBy("chunk").agg(F.min(F.when(declares, 0).otherwise(1)).alias("hint"))
    return chunks.drop("text").join(hint, "chunk").orderBy("hint", *order).limit(most)


def owners_after(owned: DataFrame, key: str, owner: str, leaving: DataFrame) -> DataFrame:
    """(key, owner, action) of what a leaving owner held: it goes to the smallest owner that is left, or is
    deleted where none is. owned has a row per key and owner, and `primary` where the owner is the first."""
    stays = owned.join(leaving.select(F.col(owner).alias("_gone")).distinct(), F.col(owner) == F.col("_gone"), "left")
    found = stays.groupBy(key).agg(F.min(F.when(F.col("_gone").isNull(), F.col(owner))).alias("next"), F.bool_or(F.col("_gone").isNotNull()).alias("touched"), F.bool_or(F.col("_gone").isNotNull() & F.col("primary")).alias("moved"))
    action = F.when(F.col("next").isNull(), "DELETE").when(F.col("moved"), "TRANSFER").otherwise("KEEP")
    return found.where("touched").select(key, F.col("next").alias(owner), action.alias("action"))


def current(jobs: DataFrame, states: DataFrame, *key: str) -> DataFrame:
    """The jobs whose whole key, base and head revisions too, is the state now observed."""
    return jobs.join(states.select(*key).distinct(), list(key), "left_semi")


def preferred(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the first in the order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def covered(units: DataFrame, observed: DataFrame, key: str, role: str, roles: tuple[str, ...], good: Column) -> DataFrame:
    """units (key) with `covered`: whether every role has an observation that is good."""
    seen = observed.where(good).where(F.col(role).isin(*roles)).groupBy(key).agg(F.countDistinct(role).alias("_roles"))
    return units.join(seen, key, "left").withColumn("covered", F.coalesce(F.col("_roles") == len(roles), F.lit(False))).drop("_roles")


def strongest(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The `most` strongest rows of each group; a later row evicts the weakest one held, so what is kept does
    not depend on the order in which rows come. `omitted` counts the others of the group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = rows.withColumn("_nth", nth)
    left = kept.groupBy(group).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return kept.where(F.col("_nth") <= most).drop("_nth").join(left, group)


def disposition(impact: Column, attribution: Column, applies: Column, unsure: Column, eligible: Column, reviewed: Column, verdict: Column) -> Column:
    """What becomes of a finding. An impact or advice is advisory, an old violation is told as such, a resolved
    one is advisory; what is unsure or lacks sources needs review; and of an eligible finding an accepted
    review decides: SUPPORTED makes a conflict of it, REFUTED closes it."""
    first = F.when(impact, "ADVISORY").when((attribution == "PRE_EXISTING") & applies, "PRE_EXISTING").when(attribution.isin("RESOLVED", "UNCHANGED") & applies, "ADVISORY").otherwise("NEEDS_REVIEW")
    decided = eligible & reviewed
    return F.when(decided & (verdict == "SUPPORTED"), "SUPPORTED_CONFLICT").when(decided & (verdict == "REFUTED"), "REFUTED").when(unsure, "NEEDS_REVIEW").otherwise(first)


def review_accepted(verdict: Column, core_missing: Column, attribution: Column, authority: Column, unchanged: Column) -> Column:
    """A review counts if no core fact is missing and the witness is unchanged: a refutation as it is, support
    only of what is introduced or worsened and where the rule has authority."""
    return ~core_missing & unchanged & ((verdict == "REFUTED") | ((verdict == "SUPPORTED") & attribution.isin("INTRODUCED", "WORSENED") & authority))


def candidate_eligible(impact: Column, approved: Column, covered_: Column, attribution: Column, applies: Column, mandatory: Column, adr: Column) -> Column:
    """A finding may go to review if it is no mere impact, its rule is approved and its sources are complete,
    the change brought it about, and the rule applies; one of a decision record must be mandatory as well."""
    return ~impact & approved & covered_ & attribution.isin("INTRODUCED", "WORSENED") & applies & (~adr | mandatory)


def unresolved(scopes: Column, basis: Column, uncertain: Column, open_targets: Column, bases: Column) -> Column:
    """Whether an applicability is left open: no, unknown or other scopes, no explicit basis, uncertainty, or
    targets that are open or not explicit."""
    return (F.size(scopes) == 0) | F.arrays_overlap(scopes, F.array(F.lit("unknown"), F.lit("other"))) | (basis != "explicit") | uncertain | open_targets | F.exists(bases, lambda b: b != "explicit")


def first_units(rules: DataFrame, groups: DataFrame, order: list, most: int) -> DataFrame:
    """(place, rule, group, overflow): the first `most` of all pairs of a rule (rule), in order, and a group (group),
    rule by rule. Only the pairs that are wanted are made: a place tells its rule and group by division, and only
    the rules and groups that can be reached are numbered."""
    n, rules_n = groups.count(), rules.count()
    rules = rules.orderBy("rule").limit(most).withColumn("nth", F.row_number().over(Window.orderBy("rule")))
    if n == 0:
        return rules.sparkSession.createDataFrame([], "place long, rule string, group string, overflow long")
    head = groups.orderBy(*order).limit(most)
    head = head.select("group", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("g"))
    places = rules.sparkSession.range(min(most, n * rules_n)).select(F.col("id").alias("place"), F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("g"))
    found = places.join(rules.select("rule", (F.col("nth") - 1).cast("long").alias("r")), "r").join(head, "g")
    return found.select("place", F.col("rule").cast("string").alias("rule"), F.col("group").cast("string").alias("group"), F.lit(max(0, n * rules_n - most)).cast("long").alias("overflow"))


def pruned(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """The rows of each group that stay when rows are dropped in order until the group fits its budget."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = rows.groupBy(group).agg(F.sum(size).alias("_total"))
    return rows.withColumn("_before", before).join(total, group).where(F.col("_total") - F.col("_before") <= budget).drop("_before", "_total")


def settled_size(base: Column, rounds: int = 16) -> Column:
    """The size of a text that tells its own size: base and the digits of the size, found by trying again."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0).cast("long"), lambda acc, _: F.greatest(acc, base + F.length(acc.cast("string"))))


def challenges(items: DataFrame, plan: str, key: str, evidence: str, size: str, capacity: int, most: int = 16, probes: int = 8) -> DataFrame:
    """(plan, key, bin): each finding of a plan (bounded: a plan has a few hundred) in the bin with which it
    shares most evidence, of the `probes` best with room; else in a new one. One above the capacity has none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        bins: list[list] = []  # rows, cost, evidence
        placed = []
        for cost, found in zip(group[size], group[evidence], strict=True):
            mine = set(found)
            if cost > capacity:
                placed.append(None)
                continue
            open_ = [i for i, b in enumerate(bins) if b[0] < most]
            tried = sorted(open_, key=lambda i: (-len(mine & bins[i][2]), i))[:probes]
            into = next((i for i in tried if bins[i][1] + cost <= capacity), None)
            if into is None:
                into = len(bins)
                bins.append([0, 0, set()])
            bins[into] = [bins[into][0] + 1, bins[into][1] + cost, bins[into][2] | mine]
            placed.append(into)
        return pd.DataFrame({plan: group[plan], key: group[key], "bin": pd.array(placed, "Int64")})

    kind = lambda c: items.schema[c].dataType.simpleString()
    return items.select(plan, key, evidence, size).groupBy(plan).applyInPandas(run, f"{plan} {kind(plan)}, {key} {kind(key)}, bin long")


def freshness(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of every key of an index and of the rows it was built of: FRESH, STALE, MISSING or EXTRA."""
    both = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_here")), key, "full")
    state = F.when(F.col("_here").isNull(), "EXTRA").when(F.col("_old").isNull(), "MISSING").when(F.col("_old") == F.col("_new"), "FRESH").otherwise("STALE")
    return both.select(key, state.alias("state"))
