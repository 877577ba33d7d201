import collections
import hashlib
import random

from pyspark.sql import functions as F
from sparkloom.functions import text as X
from sparkloom.operators import discovery
from sparkloom.operators.discovery import Limits


def made(rng, ctx):
    files = ["a.py", "b.md", "c/d.go"]
    words = ["getUser", "save_all", "HTTPServer", "x", "total", "'literal one'", '"two"', "", "véé"]
    text = lambda: rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(5)))])
    deltas = [(ctx, f"d{i}", rng.choice(files), rng.randrange(20), text(), text(), rng.choice([None, [], ["f"], ["g", "Cls.m"]])) for i in range(rng.randrange(1, 9))]
    entities = [(ctx, f"n{i}", rng.choice(["Store", "readRows", "Gate"]) + str(i), rng.choice(files), rng.randrange(3)) for i in range(7)]
    mapped = sorted({(ctx, rng.choice(deltas)[1], f"n{rng.randrange(9)}") for _ in range(5)})
    edges = [(ctx, f"e{i}", f"n{rng.randrange(8)}", f"n{rng.randrange(7)}", rng.choice(["CALLS", "READS_FROM", "WRITES_TO", "USES"])) for i in range(12)]
    return deltas, entities, mapped, edges


def terms_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    return {r.t: (r.i, r.q) for r in rows.select("t", X.identifier_terms(F.col("t")).alias("i"), X.quoted_literals(F.col("t")).alias("q")).collect()}


def plain(found, limits, terms):
    """One change set, unit by unit."""
    deltas, entities, mapped, edges = found
    omitted, queues = [], collections.defaultdict(list)
    for d in sorted(deltas, key=lambda d: (d[2], d[3], d[1])):
        queues[d[2]].append(d)
    for rows in queues.values():
        omitted += [("PER_FILE_LIMIT", d[1]) for d in rows[limits.per_file :]]
    ordered = [rows[i] for i in range(limits.per_file) for _, rows in sorted(queues.items()) if i < len(rows)]
    omitted += [("SEED_LIMIT", d[1]) for d in ordered[limits.seeds :]]
    by = {e[1]: e for e in entities}
    good = [e for e in edges if e[2] in by and e[3] in by]
    seeds, equal = [], {}
    for _, delta, path, _, before, after, symbols in ordered[: limits.seeds]:
        primary = {m[2] for m in mapped if m[1] == delta and m[2] in by}
        own = primary or {i for i, e in by.items() if e[3] == path}
        if not primary:
            omitted.append(("UNMAPPED_UNIT", delta))
        near = sorted((e for e in good if {e[2], e[3]} & own), key=lambda e: (e[4] != "CALLS", e[4] not in ("READS_FROM", "WRITES_TO"), e[1]))
        omitted += [("NEIGHBOR_LIMIT", f"{delta}/{e[1]}") for e in near[limits.edges :]]
        near = near[: limits.edges]
        ids = sorted(own | {x for e in near for x in e[2:4]}, key=lambda i: (i not in primary, i not in own, by[i][4], i))
        omitted += [("ENTITY_LIMIT", f"{delta}/{i}") for i in ids[limits.entities :]]
        ids = ids[: limits.entities]
        kept = [e for e in near if e[2] in ids and e[3] in ids]
        omitted += [("NEIGHBOR_LIMIT", f"{delta}/{e[1]}") for e in near if e not in kept]
        seeds.append((delta, path, "RESOLVED" if primary else "FILE_FALLBACK", sorted(ids), sorted(e[1] for e in kept)))
        source = f"{before or ''}\n{after or ''}"
        exact = [*(symbols or []), *(by[i][2] for i in ids)]
        spelt = lambda a: terms[" ".join(a)][0]
        for channel, all_ in (("CODE", [*exact, path, *spelt([*exact, path]), *terms[source][0], *terms[source][1]]), ("RECORDS", [*terms[source][1], *exact, *spelt(exact), *terms[source][0], path, *spelt([path])])):
            unique = list(dict.fromkeys(t for t in all_ if t.strip()))
            chosen, size = [], 0
            for t in unique:
                more = len(t) + bool(chosen)
                if len(t) <= limits.term_chars and len(chosen) < limits.terms and size + more <= limits.chars:
                    chosen.append(t)
                    size += more
            if len(chosen) < len(unique):
                omitted.append(("QUERY_TEXT_LIMIT", f"{channel}/{delta}"))
            equal.setdefault((channel, " ".join(chosen) or path[: limits.chars]), []).append(delta)
    queries = [(c, t, len(equal[c, t])) for c in ("CODE", "RECORDS") for k, t in equal if k == c]
    omitted += [("QUERY_LIMIT", f"{c}/{hashlib.sha256(t.encode()).hexdigest()}") for c, t, _ in queries[limits.queries :]]
    return seeds, [(*q, n) for n, q in enumerate(queries[: limits.queries], 1)], sorted(omitted)


def needed(found):
    out = {""}
    for deltas, entities, *_ in found:
        names = {e[1]: e[2] for e in entities}
        for d in deltas:
            out |= {f"{d[4] or ''}\n{d[5] or ''}", d[2]}
        out |= set(names.values())
    return out


def test_discovery_equals_plain_loop(spark):
    rng = random.Random(9)
    contexts = {f"c{i}": made(rng, f"c{i}") for i in range(12)}
    schemas = ("ctx string, delta string, path string, place int, before string, after string, symbols array<string>", "ctx string, entity string, name string, path string, distance int", "ctx string, delta string, entity string", "ctx string, edge string, src string, dst string, rel string")
    frames = [spark.createDataFrame([r for c in contexts.values() for r in c[k]], s).repartition(2) for k, s in enumerate(schemas)]

    class Terms(dict):
        """Identifier terms, asked of the column functions, which have tests of their own."""

        def __missing__(self, text):
            self |= terms_of(spark, {text})
            return self[text]

    terms = Terms(terms_of(spark, needed(contexts.values())))
    for limits in (Limits(), Limits(per_file=2, seeds=4, edges=2, entities=3, terms=4, term_chars=8, chars=30, queries=5)):
        seeds, queries, omitted = discovery.built(*frames, limits)
        got = {c: ([], [], []) for c in contexts}
        for r in seeds.collect():
            got[r.ctx][0].append((r.delta, r.path, r.mapping, r.entities, r.edges))
        for r in sorted(queries.collect(), key=lambda r: r.nth):
            got[r.ctx][1].append((r.channel, r.text, r.seeds, r.nth))
        for r in omitted.collect():
            got[r.ctx][2].append((r.code, r.item))
        for c, found in contexts.items():
            want = plain(found, limits, terms)
            assert sorted(got[c][0]) == sorted(want[0]), c
            assert got[c][1] == want[1], c
            assert sorted(got[c][2]) == want[2], c


def test_seeds_alone_write_no_queries(spark, monkeypatch):
    """Seeds don't ask for the terms of every text."""
    rng, written = random.Random(4), []
    schemas = ("ctx string, delta string, path string, place int, before string, after string, symbols array<string>", "ctx string, entity string, name string, path string, distance int", "ctx string, delta string, entity string", "ctx string, edge string, src string, dst string, rel string")
    frames = [spark.createDataFrame(r, s) for r, s in zip(made(rng, "c"), schemas, strict=True)]
    keep = discovery.materialise
    monkeypatch.setattr(discovery, "materialise", lambda df, name: written.append(name) or keep(df, name))
    seeds = sorted(map(tuple, discovery.seeds_of(discovery.around(*frames)).collect()))
    assert "views" not in written and "queries" not in written
    assert seeds == sorted(map(tuple, discovery.built(*frames)[0].collect()))


def test_a_text_is_split_into_terms_once(spark, monkeypatch):
    """Both channels take the terms of a text, of the names and of the path from one pass over each."""
    rng, plans = random.Random(4), {}
    schemas = ("ctx string, delta string, path string, place int, before string, after string, symbols array<string>", "ctx string, entity string, name string, path string, distance int", "ctx string, delta string, entity string", "ctx string, edge string, src string, dst string, rel string")
    frames = [spark.createDataFrame(r, s) for r, s in zip(made(rng, "c"), schemas, strict=True)]
    keep = discovery.materialise
    monkeypatch.setattr(discovery, "materialise", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, name))
    discovery.built(*frames)
    assert plans["views"].count("regexp_extract_all(") == 4


def test_what_lies_around_a_seed_is_dealt_once(spark, monkeypatch):
    """Candidates and edges of a seed are gathered where they are put in order: no table with a row for each is written, and
    those that bounds leave out stand in rows of bounded size, all of them."""
    n = 2500
    frames = [
        spark.createDataFrame([("c", "d", "f.py", 1, None, "x", None)], "ctx string, delta string, path string, place int, before string, after string, symbols array<string>"),
        spark.range(n).selectExpr("'c' AS ctx", "concat('n', lpad(id, 5, '0')) AS entity", "concat('N', id) AS name", "'f.py' AS path", "1 AS distance"),
        spark.createDataFrame([], "ctx string, delta string, entity string"),
        spark.range(n - 1).selectExpr("'c' AS ctx", "concat('e', lpad(id, 5, '0')) AS edge", "concat('n', lpad(id, 5, '0')) AS src", "concat('n', lpad(id + 1, 5, '0')) AS dst", "'USES' AS rel"),
    ]
    written, keep = {}, discovery.materialise
    monkeypatch.setattr(discovery, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    found = discovery.around(*frames, Limits(edges=30))
    assert sum(df.count() for name, df in written.items() if name != "known") < 10
    assert all(len(r.no_entities) <= discovery.PART + 60 and len(r.no_edges) <= discovery.PART + 30 for r in written["lists"].collect())
    got = collections.Counter()
    for rows in found.omitted:
        got.update((r.code, r.item) for r in rows.collect())
    want = [("UNMAPPED_UNIT", "d")] + [("ENTITY_LIMIT", f"d/n{i:05}") for i in range(24, n)] + [("NEIGHBOR_LIMIT", f"d/e{i:05}") for i in range(23, n - 1)]
    assert got == collections.Counter(want)
    seed = discovery.seeds_of(found).first()
    assert seed.mapping == "FILE_FALLBACK" and seed.entities == [f"n{i:05}" for i in range(24)] and seed.edges == [f"e{i:05}" for i in range(23)]
