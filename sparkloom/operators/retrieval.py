"""Lexical and vector scoring, rank fusion, fair selection and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import gram_hashes
from .steps import growing, materialise, spread

K1, B, RRF_K = 1.2, 0.75, 60


def term_lists(texts: DataFrame, key: str, identifiers: Column, terms: Callable[[Column], Column]) -> DataFrame:
    """(key, terms) per occurrence of an identifier: its search terms. A key without identifiers has one row without
    any. Words are split where they stand, as nearly all are one plain term; none leaves its text for that."""
    words = spread(texts).select(key, F.explode_outer(identifiers).alias("word"))
    return words.select(key, F.when(F.col("word").isNull(), F.array().cast("array<string>")).otherwise(terms(F.col("word"))).alias("terms"))


def corpus_stats(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row (n_docs, avg_len, n_terms) of term_lists()."""
    counts = materialise(counts, "terms")
    sizes = counts.groupBy(key).agg(F.sum(F.size("terms")).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    terms = counts.select(F.explode("terms").alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return sizes.crossJoin(terms)  # one row each


#: Parts are summed as whole numbers of this size, so that a sum does not depend on its order.
GRAIN = 10**14


def bm25(counts: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of all matches; counts (doc_id, terms) of term_lists(), questions
    (query_id, term). Only terms that a question holds leave their document."""
    counts = materialise(counts, "terms")
    wanted = questions.select("query_id", "term").distinct()
    sizes = counts.groupBy("doc_id").agg(F.sum(F.size("terms")).alias("len"))
    stats = sizes.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg"))
    hits = counts.select("doc_id", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    hits = materialise(hits.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # By document from here on, so that the scores of a document add up where its parts are.
    parts = hits.join(df, "term").join(growing(sizes), "doc_id").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    parts = parts.select("doc_id", "term", F.round(part * GRAIN).cast("long").alias("part"))
    return parts.join(wanted, "term").groupBy("query_id", "doc_id").agg((F.sum("part") / F.lit(float(GRAIN))).alias("score")).where("score > 0")


def ranked(scores: DataFrame, group: str, item: str, most: int | None = None, score: str = "score") -> DataFrame:
    """1-based positions by falling score, ties by item."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    out = scores.withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= most) if most else out


#: Vectors in a block of queries and of candidates.
BLOCK = 4096


def _unit_blocks(rows: DataFrame, count: int) -> DataFrame:
    """(dim, block, ids, vs): unit vectors in blocks, one row each; a zero or incomplete vector is in none."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v, np.float64) if v and None not in v else np.zeros(1)
                size = np.linalg.norm(x)
                if np.isfinite(size) and size > 0:
                    kept.append((i, len(x), (x / size).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in kept], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["id", "dim", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vs = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary())], ["dim", "block", "ids", "vs"])

        for batch in batches:
            for dim, block, i, v in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "id", "v")), strict=True):
                if (dim, block) != key:
                    if ids:
                        yield out()
                    key, ids, vs = (dim, block), [], []
                ids.append(i)
                vs.append(v)
        if ids:
            yield out()

    units = rows.mapInArrow(unit, "id long, dim int, v binary")
    dealt = units.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // BLOCK)))).cast("int"))
    dealt = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block").select("dim", "block", "id", "v")
    return materialise(dealt.mapInArrow(join, "dim int, block int, ids binary, vs binary"), "vectors")


def most_similar(rows: DataFrame, asked: Column, most: int, digits: int = 9) -> DataFrame:
    """(query_id, item, score) by cosine: for each asked row of (id, v) the `most` best other rows, as far as a
    block of candidates can tell; scores are rounded to `digits` before they are ranked, ties go to the
    smaller id. Every block of queries meets every block of candidates once."""
    n, asked_n = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    c = _unit_blocks(rows, n)
    q = _unit_blocks(rows.where(asked), asked_n)
    q = q.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // BLOCK) - 1)))).alias("q_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, ci, cv, dim in zip(*(batch.column(k).to_pylist() for k in ("q_ids", "q_vs", "ids", "vs", "dim")), strict=True):
                qi, ci = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                order = np.argsort(ci)
                ci, cv = ci[order], np.frombuffer(cv).reshape(-1, dim)[order]
                qv = np.frombuffer(qv).reshape(-1, dim)
                for a in range(0, len(qi), 256):
                    score = np.round(qv[a : a + 256] @ cv.T, digits) + 0.0
                    score[qi[a : a + 256, None] == ci[None, :]] = -2.0
                    best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                    value = np.take_along_axis(score, best, axis=1)
                    keep = value > -2
                    ids = np.repeat(qi[a : a + 256], keep.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ci[best][keep]), pa.array(value[keep])], ["query_id", "item", "score"])

    met = q.join(c, (F.col("q_dim") == F.col("dim")) & (F.col("q_block") == F.col("block")))
    return met.select("q_ids", "q_vs", "ids", "vs", "dim").mapInArrow(run, "query_id long, item long, score double")


def fused(channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, item, channel, position): one vote per channel."""
    best = channels.groupBy("query_id", "item", "channel").agg(F.min("position").alias("best"))
    votes = F.aggregate(F.array_sort(F.collect_list(F.struct("channel", (1.0 / (k + F.col("best"))).alias("x")))), F.lit(0.0), lambda a, s: a + s["x"])
    return best.groupBy("query_id", "item").agg(votes.alias("rrf"), F.min("best").alias("min_rank"), F.count("*").cast("int").alias("n_channels"))


def round_robin(rows: DataFrame, group: str, order: list, most: int, per_group: int | None = None, item: str | None = None) -> DataFrame:
    """Interleave the groups: first of each, then second of each, up to `most` rows. An item that stands in
    several groups is kept where its turn comes first."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    out = rows.withColumn("turn", turn)
    # A group's first `most` rows hold as many different items, so a later turn is never reached.
    out = out.where(F.col("turn") <= min(per_group or most, most))
    if item:
        first = F.row_number().over(Window.partitionBy(item).orderBy("turn", group))
        out = out.withColumn("_first", first).where("_first = 1").drop("_first")
    out = out.orderBy("turn", group, *order).limit(most)  # bounded before it is numbered
    return out.withColumn("place", F.row_number().over(Window.orderBy("turn", group, *order)))


def quotas(present: DataFrame, kind: str, reserved: str, most: int) -> DataFrame:
    """How many places each of two kinds gets: half, rounded up, for the reserved kind while the other is
    present; what one does not use goes to the other. present has (kind, n)."""
    n = present.agg(F.coalesce(F.sum(F.when(F.col(kind) == reserved, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col(kind) != reserved, F.col("n"))), F.lit(0)).alias("b"))
    half = -(-most // 2)
    first = F.when(F.col("b") > 0, F.least("a", F.greatest(F.lit(half), most - F.col("b")))).otherwise(F.least("a", F.lit(most)))
    return n.select(first.alias("reserved"), F.least(F.col("b"), most - first).alias("others"))


def capped(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most)


def ranking_metrics(found: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Recall at each k, reciprocal rank of the first hit, and nDCG per query. found (query_id, item,
    position), relevant (query_id, item). The ideal gain is over min(relevant, found)."""
    hits = found.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    gain = F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("position") + 1.0)).otherwise(0.0))
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("position") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks], F.min(F.when(F.col("hit") == 1, F.col("position"))).alias("first"), gain.alias("dcg"))
    per = per.join(relevant.groupBy("query_id").agg(F.count("*").alias("total")), "query_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "total").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return per.select("query_id", *[F.round(F.col(f"h{k}") / F.col("total"), 6).alias(f"recall_{k}") for k in ks], F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


#: What each reason to look at a requirement is worth.
REASONS = {"ENTITY_TARGET": 100, "SCOPE_ENTITY_TARGET": 80, "NEIGHBOR_TARGET": 25, "COMMUNITY_SCOPE": 70, "REPOSITORY_SCOPE": 65, "CONDITIONAL_SCOPE": 60, "ADR_MENTION": 50}


def discovery(entity: Column, scope_entity: Column, near: Column, community: Column, repository: Column, condition: Column, mention: Column, words: Column, literals: Column) -> tuple[Column, Column]:
    """(score, reasons) of a requirement. A scope's entity counts only where no target is one, a neighbour only
    where neither is; shared words give up to 20, shared literals 5 each up to 20."""
    holds = {"ENTITY_TARGET": entity, "SCOPE_ENTITY_TARGET": scope_entity, "NEIGHBOR_TARGET": near & ~entity, "COMMUNITY_SCOPE": community, "REPOSITORY_SCOPE": repository, "CONDITIONAL_SCOPE": condition, "ADR_MENTION": mention}
    counts = holds | {"SCOPE_ENTITY_TARGET": scope_entity & ~entity, "NEIGHBOR_TARGET": near & ~entity & ~scope_entity}
    score = F.least(words, F.lit(20)) + F.least(5 * literals, F.lit(20))
    for name, worth in REASONS.items():
        score = score + F.when(counts[name], worth).otherwise(0)
    holds = holds | {"LEXICAL_FALLBACK": words > 0, "CHANGED_LITERAL": literals > 0}
    return score.cast("int"), F.array_compact(F.array(*[F.when(test, name) for name, test in holds.items()]))


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) of all docs (doc_id, text) that hold a passage (item_id, passage) as it stands. A
    passage meets only documents that have the rarest of its inner words, those between two spaces; what is
    left is compared as a whole. Passages without an inner word, of one or two words, are looked up among the byte strings
    of their length; an empty one is in every document."""
    parts = F.split("passage", " ")
    inner = passages.select("item_id", "passage", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))).alias("inner"))
    wanted = inner.select("item_id", F.explode(F.array_distinct("inner")).alias("word"))
    said = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    said = materialise(said, "said")
    df = said.groupBy("word").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = said.join(rarest, "word").select("item_id", "doc_id")
    found = pairs.join(passages, "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    short = materialise(inner.where("size(inner) = 0 AND passage IS NOT NULL").select("item_id", "passage"), "short")
    lengths = [r["n"] for r in short.select(F.octet_length("passage").alias("n")).distinct().where("n > 0").collect()]  # lengths of two words

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                for n in lengths:
                    hashes = np.unique(gram_hashes(data, n))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(hashes), pa.int64()), pa.array(np.full(len(hashes), n, np.int32)), pa.array(hashes)], ["key", "n", "f"])

    if lengths:
        asked = short.where("passage <> ''").select("item_id", "passage", F.octet_length("passage").alias("n"))
        own = asked.select("item_id", "passage").mapInArrow(strings, "key long, n int, f long").withColumnRenamed("key", "item_id").join(asked, ["item_id", "n"])
        own = materialise(own, "asked")
        held = docs.select("doc_id", "text").mapInArrow(strings, "key long, n int, f long").withColumnRenamed("key", "doc_id").join(own, ["n", "f"])
        held = held.select("item_id", "doc_id", "passage").distinct().join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("passage")))
        found = found.union(held.select("item_id", "doc_id"))
    empty = short.where("passage = ''").select("item_id")
    return found.union(docs.where("text IS NOT NULL").select("doc_id").crossJoin(empty).select("item_id", "doc_id"))
