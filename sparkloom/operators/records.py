"""Records that meet other records: merged properties, unique matches, reserved places, publication
intents, reconciliation and integrity checks. All are combinable aggregates or equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import capped


def first_non_empty(props: DataFrame, key: str, name: str, value: str, seq: str) -> DataFrame:
    """(key, name, value): the first value by seq that is neither null nor empty; a blank one counts."""
    return props.where(F.col(value) != "").groupBy(key, name).agg(F.min_by(value, seq).alias(value))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(a, b, n, kinds) per unordered pair of ends; loops and missing ends are left out."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def associated(chunks: DataFrame, key: str, *tables: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """chunks with aggregates of each table by the same key: every table is reduced to one row a key
    before it is joined, so tables never multiply each other's rows."""
    return reduce(lambda out, t: out.join(t[0].groupBy(key).agg(*[c.alias(n) for n, c in t[1].items()]), key, "left"), tables, chunks)


def by_alias(asked: DataFrame, known: DataFrame, aliases: list[Column], key: str) -> DataFrame:
    """(key, identifier) of the asked identifiers that are one of a known row's aliases."""
    names = known.select(key, F.explode(F.array_distinct(F.array(*aliases))).alias("identifier")).where("identifier IS NOT NULL")
    return names.join(asked.select("identifier").distinct(), "identifier").select(key, "identifier").distinct()


def unique_match(rows: DataFrame, targets: DataFrame, key: str, kind: str) -> DataFrame:
    """rows with target and state: FOUND if exactly one target has the key, and of the same kind."""
    one = targets.groupBy(key).agg(F.count("*").alias("_n"), F.min("target").alias("_target"), F.min(kind).alias("_kind"))
    good = F.coalesce((F.col("_n") == 1) & (F.col("_kind") == F.col(kind)), F.lit(False))
    out = rows.join(one, key, "left")
    return out.select(*rows.columns, F.when(good, F.col("_target")).alias("target"), F.when(good, "FOUND").otherwise("NOT_FOUND").alias("state"))


def both_resolved(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidates (src_key, dst_key) with the ids that entities (key, id) give them; unknown ends are null."""
    out = candidates
    for end in ("src", "dst"):
        out = out.join(entities.select(F.col("key").alias(f"{end}_key"), F.col("id").alias(end)), f"{end}_key", "left")
    return out


def with_reserved(rows: DataFrame, kind: str, item: str, linked: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each kind; if all of them are linked, the best unlinked row takes the last
    place. At most `most` + 1 rows a kind meet in the last step."""
    head = capped(rows, kind, order, most).drop("nth")
    free = capped(rows.where(~F.col(linked)), kind, order, 1).drop("nth")
    both = head.unionByName(free).dropDuplicates([kind, item])
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    first = F.min(F.when(~F.col(linked), F.col("_place"))).over(Window.partitionBy(kind))
    both = both.withColumn("_place", place).withColumn("_free", F.coalesce(first, F.lit(0)))
    kept = both.where((F.col("_place") < most) | ((F.col("_place") == most) & (F.col("_free") <= most)) | ((F.col("_place") > most) & (F.col("_place") == F.col("_free"))))
    return kept.withColumn("place", F.least("_place", F.lit(most))).drop("_place", "_free")


def bounded_terms(terms: Column, longest: int = 96, most: int = 64, chars: int = 1600) -> Column:
    """Distinct terms in order while they fit, with a space between any two counted: longer ones and those
    that don't fit are skipped, they don't end the list; blank ones are no terms."""
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc, term):
        size = F.length(term) + F.when(F.size(acc["out"]) > 0, 1).otherwise(0)
        fits = (F.size(acc["out"]) < most) & (acc["held"] + size <= chars)
        return F.struct((acc["held"] + F.when(fits, size).otherwise(0)).alias("held"), F.when(fits, F.concat(acc["out"], F.array(term))).otherwise(acc["out"]).alias("out"))

    def chosen(short):
        # Where the first ones fit together, none is skipped.
        head = F.slice(short, 1, most)
        return F.when(F.length(F.array_join(head, " ")) <= chars, head).otherwise(F.aggregate(short, start, step)["out"])

    short = F.filter(F.array_distinct(terms), lambda term: (F.trim(term) != "") & (F.length(term) <= longest))
    return F.transform(F.array(short), chosen)[0]


def intents(events: DataFrame, key: str, rank: Column, identity: Column, at: Column) -> DataFrame:
    """(key, intent, version): an intent only ever rises (1 queued, 2 in progress, 3 completed). Its version
    counts the rises, and every new identity of a completed one after the first. A rank counts if it came
    before every higher one: no ordered pass is needed. Of completed rows, one counts where the identity
    differs from the completed row before it."""
    rows = events.select(key, rank.alias("_rank"), identity.alias("_identity"), at.alias("_at")).where("_rank IS NOT NULL")
    first = [F.min(F.when(F.col("_rank") == r, F.col("_at"))).alias(f"t{r}") for r in (1, 2, 3)]
    found = rows.groupBy(key).agg(*first, F.max("_rank").alias("intent"))
    in_order = Window.partitionBy(key).orderBy("_at")
    done = rows.where("_rank = 3").withColumn("_before", F.lag("_identity").over(in_order)).withColumn("_nth", F.row_number().over(in_order))
    done = done.where("_nth = 1 OR NOT _before <=> _identity")
    finals = done.groupBy(key).agg(F.count("*").alias("finals"))
    later = {1: F.least("t2", "t3"), 2: F.col("t3"), 3: F.lit(None)}
    rises = [F.when(F.col(f"t{r}").isNotNull() & (later[r].isNull() | (F.col(f"t{r}") < later[r])), 1).otherwise(0) for r in (1, 2)]
    return found.join(finals, key, "left").select(key, "intent", (rises[0] + rises[1] + F.coalesce("finals", F.lit(0))).cast("int").alias("version"))


def reconciled(updates: DataFrame, deleted: DataFrame, key: list[str], value: str, at: Column) -> DataFrame:
    """The newest value of each key; older updates lose, and a deletion is for good."""
    newest = updates.groupBy(*key).agg(F.max_by(value, at).alias(value))
    return newest.join(deleted.select(*key).distinct(), key, "left_anti")


def pending(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What is still to be done: rows whose key and content hash no finished row has."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def violations(**checks: DataFrame) -> DataFrame:
    """(check, violations): the number of rows each check finds; zero rows are reported as well."""
    counted = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, rows in checks.items()]
    return reduce(DataFrame.union, counted)
